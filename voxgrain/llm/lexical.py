"""Ranked lexical search with block-max pruning.

The index has a row for each block of up to ``BLOCK_DOCS`` documents that lie side by side. A block holds its distinct terms, as hashes, and of each
of them the number of documents, the largest frequency and the shortest document (its maxima); and, as forward lists, the terms and frequencies of
each document. A term's impact rises with its frequency and falls with the document's length, so what it adds to a score in a block is at most
the impact of its maxima, whatever the mean length in the collection is: an index stays right when others are put beside it.

A set of queries is answered in three passes over the index, and none over the texts:

1. document frequencies of the queries' terms, which give their weights;
2. from maxima alone, a bound for each block and query. The ``HEAD`` blocks with the highest bounds of each query are scored, and the
   k-th best score found there is where the threshold starts;
3. each task takes its blocks, those of a batch with the highest bounds first, and scores the forward lists of each for the queries whose bounds are not
   below the threshold, which rises on the way. It hands on k documents a query at most; a ranking by query picks the best of them.

A task holds the scores of one block at a time and reads blocks where Arrow has them. Index files have small row groups, and batches to Python are of ``SENT`` rows while
an index is made or asked; so what a task holds depends on neither the table nor its partitions.

Bounds equal to the threshold are scored, as equal scores are ranked by doc_id; so results are those of scoring everything.

Queries are broadcast in blocks of about ``QUERY_CHARS`` characters, one block after the other. Terms are compared by 64-bit hashes: of 10**4 query
terms and 10**9 terms of a corpus, two share one with a chance of 10**-6.

Defined results: null and empty texts have no terms and are never found; an item without terms has no rows. Rows of ``documents`` that are equal
are ranked one by one. Items with the same id and text are one item; the same id with another text is ranked by itself. A null doc_id ranks
behind all others of its score. Empty tables give an empty result. Whole texts count, and extra columns pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, table
from .shingles import word_hashes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP, HEAD, BLOCK_DOCS, BLOCK_CHARS, QUERY_CHARS = 10, 2, 128, 1 << 22, 8_000_000
#: Rows in a batch to Python, documents or blocks, and bytes in a row group of the index.
SENT, ROW_GROUP = 16, 1 << 23
INDEX = "ids array<long>, n binary, starts binary, at binary, tf binary, terms binary, df binary, max_tf binary, min_n binary, holders long, total long"
FOUND = "item int, doc_id long, score long"
_BETWEEN = b" \x00 "
#: Bytes that part terms become spaces, and A-Z become a-z.
_TABLE = bytes(0x20 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c | 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))
_MARK = word_hashes(b"\x00")[0]


def terms_of(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts in order, and the text that each belongs to."""
    found = word_hashes(_BETWEEN.join((t or "").encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts))
    ends = found == _MARK
    return found[~ends], np.cumsum(ends)[~ends]


def _block(ids: list, texts: list) -> dict:
    hashes, of = terms_of(texts)
    n = np.bincount(of, minlength=len(ids)).astype(np.int64)
    terms, local = np.unique(hashes, return_inverse=True)
    size = max(1, len(terms))
    entries, tf = np.unique(of * size + local, return_counts=True)
    doc, at = entries // size, entries % size
    max_tf, min_n = np.zeros(len(terms), np.int32), np.full(len(terms), np.iinfo(np.int64).max)
    np.maximum.at(max_tf, at, tf.astype(np.int32))
    np.minimum.at(min_n, at, n[doc])
    parts = {"n": n, "starts": np.searchsorted(doc, np.arange(len(ids) + 1)), "at": at.astype(np.int32), "tf": tf.astype(np.int32), "terms": terms, "df": np.bincount(at, minlength=len(terms)).astype(np.int32), "max_tf": max_tf, "min_n": min_n}
    return {"ids": ids, **{k: v.tobytes() for k, v in parts.items()}, "holders": int((n > 0).sum()), "total": int(n.sum())}


def _indexer(block_docs: int):
    names = [x.split()[0] for x in INDEX.split(", ")]
    schema = pa.schema([(c, pa.list_(pa.int64()) if c == "ids" else pa.int64() if c in ("holders", "total") else pa.binary()) for c in names])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids.append(i)
                texts.append(t.as_py())
                chars += len(texts[-1] or "")
                if len(ids) == block_docs or chars >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist([_block(ids, texts)], schema)
                    ids, texts, chars = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_block(ids, texts)], schema)

    return index


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs begun in here send Python ``SENT`` rows at once at most: by default only 10,000 rows or 64 MB end a batch, of which a task holds several copies."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(SENT if int(was) <= 0 else min(SENT, int(was))))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of ``batches``, binary values as views of Arrow's memory."""
    for batch in batches:
        binary = [pa.types.is_binary(kind) or pa.types.is_large_binary(kind) for kind in batch.schema.types]
        for i in range(batch.num_rows):
            yield {c: values[i].as_buffer() if raw else values[i].as_py() for c, values, raw in zip(batch.schema.names, batch.columns, binary)}


def build_index(docs: DataFrame, text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The index of ``docs`` (doc_id and ``text``), written: a row for each block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_indexer(block_docs), INDEX)
    stage = Stage(docs.sparkSession, "lexical")
    with _small_batches(docs.sparkSession):
        return stage.put(rows.withColumn("block", F.monotonically_increasing_id()), "index", row_group=ROW_GROUP)


class Queries:
    """A block of queries: their terms in order of hash, and of each query its terms' places there, with repeats."""

    def __init__(self, texts: Sequence[str | None]):
        hashes, of = terms_of(texts)
        self.terms, place = np.unique(hashes, return_inverse=True)
        entries, self.times = np.unique(of * max(1, len(self.terms)) + place, return_counts=True)
        self.place, owner = entries % max(1, len(self.terms)), entries // max(1, len(self.terms))
        self.items, self.starts = np.unique(owner, return_index=True)  # items without terms are left out
        self.ends = np.append(self.starts[1:], len(entries))
        self.weights, self.documents, self.total = np.zeros(len(self.terms), np.int64), 0, 0

    def weigh(self, documents: int, total: int, df: dict[int, int]) -> None:
        self.documents, self.total = documents, total
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(self.terms))], np.int64)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``terms`` are terms of queries, and their places among these."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        mine = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.empty(0, int)
        return mine, at[mine]

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """The length norm m of documents of n terms; in whole numbers of any size, as 75 n N may pass 64 bits."""
        distinct, back = np.unique(n, return_inverse=True)
        return np.array([25 + 75 * x * self.documents // self.total for x in distinct.tolist()], np.int64)[back]

    @staticmethod
    def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def bounds(self, terms: np.ndarray, max_tf: np.ndarray, min_n: np.ndarray) -> np.ndarray:
        """What no document of a block exceeds, for each query."""
        mine, place = self.find(terms)
        most = np.zeros(len(self.terms), np.int64)
        if len(mine):
            most[place] = self.weights[place] * self.impact(max_tf[mine], self.lengths(min_n[mine]))
        return np.add.reduceat(most[self.place] * self.times, self.starts)


class _Scores:
    """What each term of a query adds to each document of a block."""

    def __init__(self, queries: Queries, row: dict):
        self.queries, self.ids = queries, row["ids"]
        n, starts = np.frombuffer(row["n"], np.int64), np.frombuffer(row["starts"], np.int64)
        mine, place = queries.find(np.frombuffer(row["terms"], np.uint64))
        column = np.full(len(row["terms"]) // 8, -1)
        column[mine] = np.arange(len(mine))
        at, tf = column[np.frombuffer(row["at"], np.int32)], np.frombuffer(row["tf"], np.int32)
        doc = np.repeat(np.arange(len(n)), np.diff(starts))
        held = at >= 0
        at, tf, doc = at[held], tf[held], doc[held]
        order = np.argsort(at, kind="stable")
        self.doc, self.added = doc[order], (queries.weights[place[at]] * queries.impact(tf, queries.lengths(n)[doc]))[order]
        self.begin = np.searchsorted(at[order], np.arange(len(mine) + 2))  # terms that the block doesn't hold are the last list, which is empty
        self.column = np.full(len(queries.terms), len(mine))
        self.column[place] = np.arange(len(mine))

    def of(self, query: int) -> np.ndarray:
        q = self.queries
        mine = slice(q.starts[query], q.ends[query])
        lists = self.column[q.place[mine]]
        sizes = self.begin[lists + 1] - self.begin[lists]
        at = np.repeat(self.begin[lists] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.doc[at], self.added[at] * np.repeat(q.times[mine], sizes))
        return out


class _Best:
    """The best documents of each query so far, and the score from which on another one can be among them."""

    def __init__(self, least: np.ndarray, top: int):
        self.top, self.least = top, np.maximum(least, 1)
        self.kept: list[list] = [[] for _ in least]

    def add(self, query: int, ids: list, scores: np.ndarray) -> None:
        new = np.flatnonzero(scores >= self.least[query])
        if len(new) > self.top:  # of equal scores smaller ids come first, so all of the last score stay
            new = new[scores[new] >= np.partition(scores[new], -self.top)[-self.top]]
        if len(new):
            rows = self.kept[query] + [(-int(scores[k]), ids[k] is None, ids[k] or 0) for k in new.tolist()]
            self.kept[query] = sorted(rows)[: self.top]
            if len(self.kept[query]) == self.top:
                self.least[query] = max(self.least[query], -self.kept[query][-1][0])

    def rows(self, items: np.ndarray) -> pd.DataFrame:
        rows = [(int(i), None if nameless else x, -s) for i, kept in zip(items, self.kept) for s, nameless, x in kept]
        return pd.DataFrame({"item": np.array([r[0] for r in rows], np.int32), "doc_id": pd.array([r[1] for r in rows], "Int64"), "score": np.array([r[2] for r in rows], np.int64)})


def _bounds(queries: Queries, rows: Iterable[dict]) -> np.ndarray:
    return np.array([queries.bounds(np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["max_tf"], np.int32), np.frombuffer(r["min_n"], np.int64)) for r in rows])


def _frequencies(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, df = sent.value, np.zeros(len(sent.value.terms), np.int64)
        for r in _rows(batches):
            mine, place = queries.find(np.frombuffer(r["terms"], np.uint64))
            df[place] += np.frombuffer(r["df"], np.int32)[mine]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"place": pa.array(held, pa.int64()), "df": pa.array(df[held], pa.int64())})

    return count


def _heads(sent, head: int):
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best, blocks = np.zeros((0, len(queries.items)), np.int64), np.zeros((0, len(queries.items)), np.int64)
        for batch in batches:
            found = _bounds(queries, _rows([batch.select(["terms", "max_tf", "min_n"])]))
            best = np.concatenate([best, found])
            blocks = np.concatenate([blocks, np.repeat(batch["block"].to_numpy()[:, None], best.shape[1], 1)])
            order = np.argsort(-best, axis=0, kind="stable")[:head]
            best, blocks = np.take_along_axis(best, order, 0), np.take_along_axis(blocks, order, 0)
        at = np.flatnonzero(best > 0)
        yield pa.RecordBatch.from_pydict({"query": pa.array(at % max(1, best.shape[1]), pa.int32()), "block": pa.array(blocks.ravel()[at], pa.int64()), "bound": pa.array(best.ravel()[at], pa.int64())})

    return bound


def _score_heads(sent, top: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best = _Best(np.zeros(len(queries.items), np.int64), top)
        for row in _rows(batches):
            scores = _Scores(queries, row)
            for q in row["queries"]:
                best.add(q, row["ids"], scores.of(q))
        yield pa.RecordBatch.from_pandas(best.rows(np.arange(len(queries.items))), preserve_index=False)

    return score


def _search(sent, least, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best = _Best(least.value.copy(), top)
        for batch in batches:
            rows = list(_rows([batch]))
            bounds = _bounds(queries, rows)
            for b in np.argsort(-bounds.max(axis=1), kind="stable").tolist() if rows else ():
                due = np.flatnonzero(bounds[b] >= best.least).tolist()
                scores = _Scores(queries, rows[b]) if due else None
                for q in due:
                    best.add(q, rows[b]["ids"], scores.of(q))
        yield pa.RecordBatch.from_pandas(best.rows(queries.items), preserve_index=False)

    return search


def _first(rows: DataFrame, by: str, top: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= top)


def _answer(index: DataFrame, texts: list[str], documents: int, total: int, top: int, head: int) -> DataFrame:
    """item (a place in ``texts``), rank, doc_id, score."""
    spark = index.sparkSession
    context, queries = spark.sparkContext, Queries(texts)
    if not len(queries.terms) or not documents:
        return spark.createDataFrame([], "item int, rank int, doc_id long, score long")
    sent = context.broadcast(queries)
    df = index.select("terms", "df").mapInArrow(_frequencies(sent), "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
    queries.weigh(documents, total, {r["place"]: r["df"] for r in df.collect()})  # a row for each term of the queries at most
    sent.destroy()
    sent = context.broadcast(queries)
    heads = index.select("terms", "max_tf", "min_n", "block").mapInArrow(_heads(sent, head), "query int, block long, bound long")
    heads = _first(heads, "query", head, F.desc("bound"), "block").groupBy(F.col("block").alias("head")).agg(F.collect_list("query").alias("queries"))
    scored = index.join(F.broadcast(heads), F.col("block") == F.col("head")).select("ids", "n", "starts", "at", "tf", "terms", "queries").mapInArrow(_score_heads(sent, top), FOUND)
    kth = _first(scored, "item", top, F.desc("score")).filter(F.col("rank") == top)
    least = np.zeros(len(queries.items), np.int64)
    for r in kth.select("item", "score").collect():  # a row for each query at most
        least[r["item"]] = r["score"]
    found = index.select("ids", "n", "starts", "at", "tf", "terms", "max_tf", "min_n").mapInArrow(_search(sent, context.broadcast(least), top), FOUND)
    return _first(found, "item", top, F.desc("score"), F.asc_nulls_last("doc_id")).select("item", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, top: int = TOP, head: int = HEAD, query_chars: int = QUERY_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each row of ``items`` (item_id, text), best first."""
    with _small_batches(index.sparkSession):
        return _search_in_blocks(index, items, top, head, query_chars)


def _search_in_blocks(index: DataFrame, items: DataFrame, top: int, head: int, query_chars: int) -> DataFrame:
    spark, stage = index.sparkSession, Stage(index.sparkSession, "search")
    size = index.agg(F.sum("holders").alias("n"), F.sum("total").alias("l")).first()
    items = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // query_chars) or 1
    out = []
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect() if n > 1 else items.collect()
        part = sorted(part, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(part)], f"of int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _answer(index, [r["text"] for r in part], size["n"] or 0, size["l"] or 0, top, head)
        out.append(stage.put(found.join(F.broadcast(names), F.col("item") == F.col("of")).select("item_id", "rank", "doc_id", "score"), f"found-{b}"))
    return reduce(DataFrame.unionByName, out)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') as terms from documents),
size as (select count(*) as docs, sum(len(terms))::bigint as total from docs where len(terms) > 0),
lengths as (select r, doc_id, 100 - 75 + (75 * len(terms) * (select docs from size)) // (select total from size) as m from docs where len(terms) > 0),
tfs as (select r, term, count(*) as tf from (select r, unnest(terms) as term from docs) group by r, term),
items as (select row_number() over () as q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') as terms from (select distinct item_id, text from benchmark)),
asked as (select q, term, count(*) as times from (select q, unnest(terms) as term from items) group by q, term),
weights as (
  select term, floor(1000 * ln((2 * (select docs from size) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tfs where term in (select term from asked) group by term),
scores as (
  select q, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join weights using (term) join tfs using (term) join lengths using (r) group by q, r),
ranked as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as rank from scores join lengths using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked join items using (q) where rank <= 10"""

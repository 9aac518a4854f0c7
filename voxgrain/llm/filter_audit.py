"""How filters interact: what each filter removes, repeats or alone catches, in every order of the filters, by part of the corpus.

A document's failures are a bit mask, one bit a filter. Where the masks of a part are counted, every order of the filters can be
read off the counts: at a step go the documents whose mask has the step's bit and none of the bits before it. The counts add up
over parts and machines, and no text is looked at again for another order.

The filter of duplicates compares documents: one fails if its whole text is that of any smaller doc_id in the table.

1. Rows are range-sorted by a 64-bit fingerprint of the text and doc_id, and within a range by fingerprint, full text and doc_id,
   so that copies lie side by side, smallest id first, and a large group of copies is spread over as many ranges as it fills. Texts
   move once; the bounds of the ranges are made of fingerprints and ids only.
2. Each range compares rows with their predecessors, batch by batch. A row is a copy if the run that it lies in began with a smaller id.
3. Only rows that begin a run in the first fingerprint of a range can't be judged there: the run may have begun in an earlier range.
   Each range publishes the runs of its first and its last fingerprint (SHA-256 of the text, smallest id); the smallest id over all ranges
   settles those rows. Texts that share a fingerprint are told apart everywhere.
4. Masks are counted by doc_id and part, joined to the labels, and summed by part and mask: 2**n counters a part. These meet a table of all
   orders, whose size is fixed by the number of filters.

Defined results: null text is empty, null source the part of the empty string. Rows with equal doc_id and text are not copies of each other. A null
doc_id is smaller than none and larger than none: such rows are copies of nothing, and nothing is a copy of them. Where several labels have one
doc_id, a document is good or toxic if any says so; labels other than 0 and 1, or null, count as 0. An empty table gives an empty result. Extra
columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Stage, table


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


#: When a text fails, by the filter's letter.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda text: F.size(_words(text)) < 50,
    "B": lambda text: 100 * F.size(F.array_distinct(_words(text))) < 65 * F.size(_words(text)),
    "C": lambda text: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text),
    "D": lambda text: text.rlike("[#$%&*|]"),
}
DUPLICATES = "E"
_MARKED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("text_key", pa.binary()), ("is_edge", pa.bool_())])


def _key(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


class _Runs:
    """Rows of one range in order, batch by batch: which are copies, which an earlier range decides, and the runs at the edges."""

    def __init__(self, bit: int):
        self.bit = bit
        self.head = None  # the first fingerprint
        self.last = (None, "", 0)  # fingerprint, text and smallest id of the run that the rows so far end with
        self.tail: list[tuple[int, bytes]] = []  # smallest id and key of the runs of the latest fingerprint

    def push(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nameless = batch.filter(pc.is_null(batch["doc_id"]))
        yield _marked(nameless["doc_id"], nameless["part"], nameless["mask"])
        batch = batch.filter(pc.is_valid(batch["doc_id"]))
        n, prints, texts, ids, mask = batch.num_rows, batch["fp"].to_numpy(), batch["text"], batch["doc_id"].to_numpy(), batch["mask"].to_numpy()
        if not n:
            return
        self.head = prints[0] if self.head is None else self.head
        same = np.zeros(n, bool)
        near = np.flatnonzero(prints[1:] == prints[:-1]) + 1
        same[near] = pc.equal(texts.take(pa.array(near)), texts.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        same[0] = self.last[0] == prints[0] and self.last[1] == texts[0].as_py()
        starts = np.flatnonzero(~same)
        least = np.concatenate([[self.last[2]], ids[starts]])[np.cumsum(~same)]
        begins = (prints == self.head) & (ids == least)  # smaller ids of the same text may lie in an earlier range
        keys = [_key(texts[i].as_py()) if b else None for i, b in enumerate(begins.tolist())]
        yield _marked(batch["doc_id"], batch["part"], pa.array(np.where(ids > least, mask | self.bit, mask)), pa.array(keys, pa.binary()))

        def runs(fingerprint: int) -> list[tuple[int, bytes]]:
            return [(int(ids[i]), _key(texts[i].as_py())) for i in starts[prints[starts] == fingerprint].tolist()]

        if self.last[0] != prints[-1]:
            self.tail = []
        if prints[-1] != self.head:
            self.tail += runs(prints[-1])
        self.last = (prints[-1], texts[n - 1].as_py(), int(least[-1]))
        yield self._edges(runs(self.head))

    def finish(self) -> pa.RecordBatch:
        return self._edges(self.tail)

    @staticmethod
    def _edges(runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(runs)
        return _marked(pa.array([i for i, _ in runs], pa.int64()), pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int32)), pa.array([k for _, k in runs], pa.binary()), True)


def _marked(ids: pa.Array, part: pa.Array, mask: pa.Array, keys: pa.Array | None = None, edge: bool = False) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([ids, part, mask.cast(pa.int32()), pa.nulls(n, pa.binary()) if keys is None else keys, pa.array(np.full(n, edge))], schema=_MARKED)


def failures(docs: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, mask of each row of ``docs``: bit k for the k-th filter, the next one for copies of smaller ids."""
    bit = 1 << len(filters)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(bit)
        for batch in batches:
            yield from runs.push(batch)
        yield runs.finish()

    whole, named = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{part}`"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.cast("string").alias("part"), whole.alias("text"), F.xxhash64(whole).alias("fp"))
    rows = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    mask = sum((f(F.col("text")).cast("int") * (1 << k) for k, f in enumerate(filters.values())), F.lit(0))
    stage = Stage(docs.sparkSession, "audit")
    marked = stage.put(rows.select("doc_id", "part", mask.alias("mask"), "fp", "text").mapInArrow(mark, "doc_id long, part string, mask int, text_key binary, is_edge boolean"), "marked")
    first = marked.filter("is_edge").groupBy(F.col("text_key").alias("edge_key")).agg(F.min("doc_id").alias("first_id"))
    own = marked.filter("not is_edge")
    settled = own.filter("text_key is not null").join(first, F.col("text_key") == F.col("edge_key"))
    settled = settled.select("doc_id", "part", F.when(F.col("doc_id") > F.col("first_id"), F.col("mask").bitwiseOR(bit)).otherwise(F.col("mask")).alias("mask"))
    return own.filter("text_key is null").select("doc_id", "part", "mask").unionByName(settled)


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive counts of documents (doc_id, part, mask), with those that ``labels`` call good and toxic."""
    said = labels.select(F.col("doc_id").alias("of"), F.expr("coalesce(quality = 1, false)").cast("int").alias("q"), F.expr("coalesce(toxic = 1, false)").cast("int").alias("t"))
    said = said.groupBy("of").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    rows = failed.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(said, F.col("doc_id") == F.col("of"), "left")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(name) for c, name in (("q", "good"), ("t", "toxic"))])


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """For each order of the letters, step and mask: whether documents of that mask are kept, removed, and so on.

    A document that fails k filters is removed by each of them in one k-th of the orders, which is ``share``.
    """
    rows = []
    for order in map("".join, permutations(letters)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            for mask in range(1 << len(letters)):
                fails, gone = bool(mask & bit), bool(mask & before)
                share = factorial(len(letters)) // mask.bit_count() if fails else 0
                rows.append((order, step, mask, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == bit), share))
            before |= bit
    return spark.createDataFrame(pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), *[pa.int32()] * 2, *[pa.int64()] * 5])], ["filter_order", "step", "of_mask", "is_kept", "is_removed", "is_redundant", "is_unique", "share"]
    ))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step."""
    counts = counters(failures(docs, filters, text, part), labels)
    steps = F.broadcast(orders(docs.sparkSession, "".join(filters) + DUPLICATES))
    sums = {"kept": "n * is_kept", "removed": "n * is_removed", "redundant": "n * is_redundant", "unique_fails": "n * is_unique", "good_lost": "good * is_removed", "toxic_lost": "toxic * is_removed", "shapley": "n * share"}
    return counts.join(steps, F.col("mask") == F.col("of_mask")).groupBy("part", "filter_order", "step").agg(*[F.expr(f"sum({x})").alias(name) for name, x in sums.items()])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as words from documents),
first as (select text, min(doc_id) as first_id from d group by text),
said as (select doc_id, max((coalesce(quality, 0) = 1)::int) as q, max((coalesce(toxic, 0) = 1)::int) as t from labels group by doc_id),
failed as (
  select part, coalesce(q, 0) as q, coalesce(t, 0) as t,
    case when len(words) < 50 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end
    || case when 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) then 'C' else '' end
    || case when regexp_matches(d.text, '[#$%&*|]') then 'D' else '' end || case when d.doc_id > first_id then 'E' else '' end as fails
  from d join first on d.text = first.text left join said on d.doc_id = said.doc_id),
counted as (select part, fails, count(*) as n, sum(q) as good, sum(t) as toxic from failed group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (select o, s, substr(o, s, 1) as l, substr(o, 1, s - 1) as earlier from orders, (select unnest(range(1, 6)) as s)),
hits as (select o, s, l, c.*, contains(fails, l) as hit, regexp_matches(fails, '[0' || earlier || ']') as gone from steps, counted c),
sums as (
  select part, o, s, l, sum(n) filter (where not gone and not hit) as kept, sum(n) filter (where hit and not gone) as removed, sum(n) filter (where hit and gone) as redundant,
    sum(n) filter (where fails = l) as unique_fails, sum(good) filter (where hit and not gone) as good_lost, sum(toxic) filter (where hit and not gone) as toxic_lost
  from hits group by part, o, s, l)
select part, o as filter_order, s::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, l), 0)::bigint as shapley
from sums"""

"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Benchmark items and documents are sequences of words (lower case, ASCII punctuation removed). A document meets an item
only through a seed, a run of ``MIN_MATCH`` words that both hold; a document without seeds costs one lookup of its rolling
hashes. For each pair that shares seeds, tiling marks the longest match of unmarked words first, then the next,
down to ``MIN_MATCH`` words; tiles never overlap. The search length is found by halving: windows of Karp-Rabin hashes match at
every length up to the longest match. The share of the item's words under tiles is its coverage, which
no reordering of passages lowers. Documents that cover an item to ``COVERAGE`` or more are contaminated. An item whose words
under shared seeds are too few to reach that share, or to be covered most, is not tiled.

Benchmarks are sent to the executors in blocks of about ``BLOCK_WORDS`` words; a larger benchmark takes one pass over
the documents for each block, one after the other, and what the passes find is joined by a hash of the text.

Defined results: null or empty text is clean; an item with fewer than ``MIN_MATCH`` words, or null text, is evidence against
no document; an empty benchmark leaves all clean. Among equally covered items the first by id is named. Repeated rows are
judged alike; repeated items count once each. Whole texts are compared.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, fresh, table
from .shingles import grams, word_hashes

MIN_MATCH, COVERAGE, BLOCK_WORDS = 5, 0.5, 2_000_000
JUDGED = "item_id long, coverage double, n_items int"
_PUNCTUATION = string.punctuation.encode()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    return word_hashes((text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION))


class _Rolling:
    """Karp-Rabin hashes of every window of any length over one sequence."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, _BASE), out=powers[1:])
        self.back = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, _INVERSE), out=self.back[1:])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers[:n], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.back[:n] if n > 0 else np.empty(0, np.uint64)


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows without a marked word."""
    count = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(count[length:] == count[:-length]) if len(count) > length else np.empty(0, int)


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), none overlapping another, longest first."""
    if min(len(item), len(doc)) < least:
        return []
    rolling_i, rolling_d = _Rolling(item), _Rolling(doc)
    marked_i, marked_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the unmarked windows of either side that the other side has, too."""
        at_i, at_d = _free(marked_i, length), _free(marked_d, length)
        of_i, of_d = rolling_i.windows(length)[at_i], rolling_d.windows(length)[at_d]
        in_d, in_i = np.isin(of_i, of_d), np.isin(of_d, of_i)
        return at_i[in_d], of_i[in_d], at_d[in_i], of_d[in_i]

    tiles, most = [], min(len(item), len(doc))
    while most >= least:
        # The search length runs to the longest match there is: where windows of one length match, shorter ones do.
        low, high = least - 1, most
        while low < high:
            middle = least if low < least else (low + high + 1) // 2
            low, high = (middle, high) if len(shared(middle)[0]) else (low, middle - 1)
        if low < least:
            break
        at_i, of_i, at_d, of_d = shared(low)
        where = defaultdict(list)
        for i, h in zip(at_i[::-1].tolist(), of_i[::-1].tolist()):
            where[h].append(i)
        done = 0  # words of the document before this one are marked or passed
        for d, h in zip(at_d.tolist(), of_d.tolist()):
            starts = where[h]
            while starts and marked_i[starts[-1] : starts[-1] + low].any():
                starts.pop()  # marks only grow
            if d >= done and starts and (item[starts[-1] : starts[-1] + low] == doc[d : d + low]).all():
                i, done = starts.pop(), d + low
                tiles.append((i, d, low))
                marked_i[i : i + low] = marked_d[d : d + low] = True
        most = low - 1
    return tiles


class Benchmark:
    """A block of items with the index of their seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words_of(t)) for i, t in items]
        pairs = [(grams(w, MIN_MATCH), k) for k, (_, w) in enumerate(self.items)]
        seeds = np.concatenate([g for g, _ in pairs]) if pairs else np.empty(0, np.uint64)
        owner = np.concatenate([np.full(len(g), k) for g, k in pairs]) if pairs else np.empty(0, int)
        place = np.concatenate([np.arange(len(g)) for g, _ in pairs]) if pairs else np.empty(0, int)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]
        self.lengths = np.array([len(w) for _, w in self.items], int)

    def _bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of these runs of seeds, and the share of each item's words that lie under them: no coverage is larger."""
        at = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
        order = np.lexsort((self.place[at], self.owner[at]))
        owner, place = self.owner[at][order], self.place[at][order]
        same = owner[1:] == owner[:-1]
        words = np.full(len(owner), MIN_MATCH)
        words[:-1][same] = np.minimum(MIN_MATCH, np.diff(place)[same])
        items, starts = np.unique(owner, return_index=True)
        return items, np.add.reduceat(words, starts) / self.lengths[items]

    def judge(self, text: str | None) -> tuple[int | None, float, int]:
        """The item covered most, its coverage, and the number of items covered to ``COVERAGE``."""
        words = words_of(text)
        found = grams(words, MIN_MATCH)
        if not len(found) or not len(self.seeds):
            return None, 0.0, 0
        at = np.searchsorted(self.seeds, found)
        hit = self.seeds[np.minimum(at, len(self.seeds) - 1)] == found
        if not hit.any():
            return None, 0.0, 0
        shared = np.unique(found[hit])
        low, high = np.searchsorted(self.seeds, shared, "left"), np.searchsorted(self.seeds, shared, "right")
        items, bounds = self._bounds(low, high)
        # Only words under some seed can be matched; others, in one stretch, count as one word that matches nothing.
        under = np.zeros(len(words), bool)
        for k in range(MIN_MATCH):
            under[k : k + len(hit)] |= hit
        cut = ~under
        keep = under | (cut & ~np.concatenate([[False], cut[:-1]]))
        short = np.where(cut, np.uint64(0), words)[keep]
        best, covers, n = -1, 0.0, 0
        for at in np.lexsort((items, -bounds)):  # the largest bound first, of equal ones the first item
            k, bound = int(items[at]), bounds[at]
            if bound < COVERAGE and (bound < covers or bound == covers and k > best):
                continue
            item = self.items[k][1]
            covered = sum(x for *_, x in tile(item, short)) / len(item)
            n += covered >= COVERAGE
            if covered > covers or covered == covers and covered > 0 and k < best:
                best, covers = k, covered
        return self.items[best][0] if best >= 0 else None, covers, n


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of blocks of about ``block_words`` words, and the items of each; one is collected when it is asked for."""
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // (4 * block_words))

    def block(b: int) -> list[tuple[int, str]]:
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        return sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0], x[1]))

    return n, map(block, range(n))


def _judge(sent):
    @F.pandas_udf(JUDGED)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        block = Benchmark(sent.value)
        for texts in batches:
            rows = [block.judge(t) for t in texts]
            yield pd.DataFrame({"item_id": pd.array([r[0] for r in rows], "Int64"), "coverage": [r[1] for r in rows], "n_items": np.array([r[2] for r in rows], "int32")})

    # Judged where it stands, and once: a filter on it must not be moved below the joins that may lie before.
    return judge.asNondeterministic()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, into: str = "leak") -> DataFrame:
    """``docs`` with a struct column ``into``, in place of any of that name: item_id (the most covered), coverage, n_items (covered to COVERAGE)."""
    context, source = docs.sparkSession.sparkContext, F.col(f"`{text}`")
    n, blocks = _blocks(benchmark, block_words)
    none = F.expr("named_struct('item_id', cast(null as long), 'coverage', 0D, 'n_items', 0)")
    if n <= 1:
        return docs.withColumn(into, _judge(context.broadcast(next(blocks)))(source) if n else none)
    # A judgement depends on the text only. Each pass keeps those of the few texts that meet an item of its block.
    stage, passes = Stage(docs.sparkSession, "leaks"), []
    for k, items in enumerate(blocks):
        sent = context.broadcast(items)
        judged = docs.select(F.xxhash64(source, F.length(source)).alias("key"), _judge(sent)(source).alias("j")).filter(F.col("j.coverage") > 0)
        passes.append(stage.put(judged.select("key", "j.*").distinct(), f"block-{k}"))
        sent.destroy()
    found = reduce(DataFrame.unionByName, passes)
    order = F.struct((-F.col("coverage")).alias("less"), F.col("item_id").isNull().alias("nameless"), "item_id", "coverage")
    found = found.groupBy("key").agg(F.min(order).alias("best"), F.sum("n_items").cast("int").alias("n_items"))
    key, other, leak = fresh(docs, "key", "other", "leak")
    found = found.select(F.col("key").alias(other), F.struct("best.item_id", "best.coverage", "n_items").alias(leak))
    joined = docs.withColumn(key, F.xxhash64(source, F.length(source))).join(found, F.col(key) == F.col(other), "left").withColumn(leak, F.coalesce(leak, none))
    return joined.select(*[f"`{c}`" for c in docs.columns if c.lower() != into.lower()], F.col(leak).alias(into))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", (F.col("leak.n_items") > 0).alias("contaminated"), "leak.item_id", "leak.coverage", "leak.n_items")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item.

    Null and empty texts stay; all stay where the benchmark is empty; repeated rows are judged alike; other columns pass through.
    """
    into = fresh(docs, "leak")[0]
    return contamination(docs, benchmark, into=into).filter(F.col(f"{into}.n_items") == 0).drop(into)

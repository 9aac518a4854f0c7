"""Exact n-gram Jaccard self-join with set relations: which texts link, and the components that their links make.

A document is the set of its distinct ``K``-word shingles; two link at a Jaccard similarity of ``PERCENT`` / 100 or more. No link
between different sets is missed, and no group of alike sets is ever listed pair by pair:

1. Sets. Documents with one set are one class from here on. A sketch counts shingles by hash bucket.
2. Heads. Sets that agree in two min-hashes meet, in ``BANDS`` places each, and only the first and the last there are compared with the
   others: a few pairs for each set, however large a group of alike sets is. This finds most links; it needn't find all.
3. Index. A set's tokens are ordered by (count of the token's bucket, token), rare ones first. Sets that link share one of their
   first n - ceil(0.8 n) + 1 tokens, so only these are indexed: entries (token, set, n, position). What the sketch shows to be a
   frequent token is dealt to several lists by a hash of the set; lists have bounded length.
4. Skipping by position. A list is sorted by set size; an entry stays only if the sizes and positions of it and another leave
   room for a link. Lists of more than ``WIDE`` entries are kept as they are; no blocks are skipped.
5. Answers from similar sets. A set that links to a head takes part from now on through that head: 1 - Jaccard is a
   metric, so with x at distance d(x, h) of its head h and y at d(y, g) of g, d(x, y) >= d(h, g) - d(x, h) - d(y, g). Lists whose
   entries are in one component are done. Elsewhere the heads (a set without a head is its own) of entries of different components
   are compared once, long lists block against block: a link joins the components; a distance beyond what the bound leaves open
   settles all pairs behind it. Where it leaves some open, each set behind the head with fewer of them is compared with the
   other head, and its intersections with the sets behind that one are derived from this answer: a set x stands there as what it
   has and what it lacks of its head h, so |x & y| = |h & y| + |(x - h) & y| - |(h - x) & y|. The sets behind a head are kept in blocks by
   distance from it, blocks are skipped by the bound, and the first link of a set in a block ends the search there.
6. Components of the links by propagation of the least label, with pointer jumping, as joins of staged tables.

Only links that can join two components are computed; those implied inside a component are not counted.

Defined results: null, empty and blank texts have an empty set, link with nothing, and are components of their own; fewer than K words
make one shingle. Repeated rows and rows that share a doc_id are one class or linked as their texts are. A component is named by its smallest
non-null doc_id. Whole texts count; sets compare by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import Stage, fresh, table
from .shingles import mix, shingle_set, shingle_sets, words_of

K, PERCENT = 5, 80
#: Buckets of the sketch, and entries of a list beyond which a frequent token is dealt to more lists.
BUCKETS, LIST = 1 << 20, 4096
#: In lists of more entries than this none is dropped before heads are compared.
WIDE = 64
#: Roots of a list, or sets behind a root, that are compared as one block.
BLOCK = 256
#: The distance from a root, 0 to 1, in so many rings; a ring is dealt to blocks by hash.
RINGS = 50
#: Bits of the filter that tells which documents' sets a later step needs, at most (16 MB).
FILTER_BITS = 1 << 27
BLOCK_ROWS = 1 << 17

SETS = "doc_id long, fp long, n int, bands array<long>, bucket_counts binary"
ENTRIES = "token long, salt int, fp long, n int, pos int, dealt boolean"
LISTED = "token long, fp long, n int, pos int"
#: Places where alike sets meet, and odd numbers that make their min-hashes.
BANDS = 4
_HASHES = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def _fingerprints(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set of hashes, as a signed integer; sets lie end to end in ``s``, and an empty one has 0."""
    out, held = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes)
    if len(held):
        starts = (np.cumsum(sizes) - sizes)[held]
        total, mask = np.add.reduceat(mix(s), starts), np.bitwise_xor.reduceat(s * np.uint64(0x9E3779B97F4A7C15), starts)
        out[held] = (mix(total) ^ (mix(mask + sizes[held].astype(np.uint64)) << np.uint64(1))).view(np.int64)
    return out


def _fingerprint(s: np.ndarray) -> int:
    return int(_fingerprints(s, np.array([len(s)]))[0])


def _bands(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Pairs of min-hashes of each of the sets that start there in ``s``. Shingles are hashes already, so a product by an odd number puts them in another order."""
    least = mix(np.stack([np.minimum.reduceat(s * m, starts) for m in _HASHES], axis=1))
    return mix(least[:, ::2] * _HASHES[0] + least[:, 1::2] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Class, size and min-hashes of each document and, in a last row, the task's counts of shingles by bucket."""
    counts = np.zeros(BUCKETS, np.uint32)
    for b in batches:
        fps, sizes, bands = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32), [None] * len(b)
        for first, last, s, n in shingle_sets(b["text"].tolist(), K):
            fps[first:last], sizes[first:last] = _fingerprints(s, n), n
            held = np.flatnonzero(n)
            if len(held):
                for i, found in zip((first + held).tolist(), _bands(s, (np.cumsum(n) - n)[held])):
                    bands[i] = found
            np.add.at(counts, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fps, "n": sizes, "bands": bands, "bucket_counts": None})
    yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "fp": [0], "n": np.array([-1], "int32"), "bands": [None], "bucket_counts": [counts.tobytes()]})


def _sum_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.uint64)
    for b in batches:
        for raw in b["bucket_counts"]:
            total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * BUCKETS else np.uint64)
    yield pd.DataFrame({"bucket_counts": [total.tobytes()]})


def _sketch(rows: DataFrame) -> np.ndarray:
    """The counts of all tasks, added up on the executors; the driver adds what 8 tasks have left."""
    for width in (64, 8):
        rows = rows.select("bucket_counts").repartition(width).mapInPandas(_sum_counts, "bucket_counts binary")
    total = np.zeros(BUCKETS, np.uint64)
    for r in rows.toLocalIterator():
        total += np.frombuffer(r["bucket_counts"], np.uint64)
    return np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)


def _prefix(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _index(sent, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sent.value.astype(np.int64)
        usual = counts.mean() + 6 * np.sqrt(counts.mean() + 1)
        deals = (1 + np.maximum(0, counts - usual) // most).astype(np.uint64)
        seen: set[int] = set()
        out, size = [], 0

        def frame():
            token, fp, n, pos, salt, dealt = (np.concatenate(x) for x in zip(*out))
            return pd.DataFrame({"token": token.view(np.int64), "salt": salt.astype(np.int32), "fp": fp, "n": n.astype(np.int32), "pos": pos.astype(np.int32), "dealt": dealt})

        for _, _, s, sizes in (found for b in batches for found in shingle_sets(b["text"].tolist(), K)):
            fps, bucket, new, orders = _fingerprints(s, sizes), (s & np.uint64(BUCKETS - 1)).astype(np.int64), [], []
            # A set's shingles are in order, so count and place say (count, shingle).
            ranked, start = counts[bucket].astype(np.uint64) << np.uint64(32), 0
            for i, (fp, n) in enumerate(zip(fps.tolist(), sizes.tolist())):
                if n and fp not in seen:
                    seen.add(fp)
                    order = ranked[start : start + n] | np.arange(n, dtype=np.uint64)
                    order.sort()
                    new.append(i)
                    orders.append(start + (order[: _prefix(n)] & np.uint64(2**32 - 1)).astype(np.int64))
                start += n
            if not new:
                continue
            order, p = np.concatenate(orders), np.array([len(x) for x in orders])
            deal, fp = deals[bucket[order]], np.repeat(fps[new], p)
            pos = np.arange(len(order)) - np.repeat(np.cumsum(p) - p, p)
            out.append((s[order], fp, np.repeat(sizes[new], p), pos, (fp & (2**63 - 1)).astype(np.uint64) % deal, deal > 1))
            size += len(order)
            if size >= BLOCK_ROWS:
                yield frame()
                out, size = [], 0
        if size:
            yield frame()

    return run


def _lists(wide: int):
    """Streams sorted lists and keeps the entries that may link with another of their list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            token, salt = b["token"].to_numpy(), b["salt"].to_numpy()
            others = np.flatnonzero((token != token[-1]) | (salt != salt[-1]))
            cut = others[-1] + 1 if len(others) else 0
            rest = b.iloc[cut:]
            if cut:
                yield _fitting(b.iloc[:cut], wide)
        if rest is not None and len(rest):
            yield _fitting(rest, wide)

    return run


def _room(n: np.ndarray, pos: np.ndarray, n2: np.ndarray, pos2: np.ndarray) -> np.ndarray:
    """Whether sets that first meet at these positions can still link."""
    return np.minimum(n - pos, n2 - pos2) * (100 + PERCENT) >= PERCENT * (n + n2)


def _fitting(b: pd.DataFrame, wide: int) -> pd.DataFrame:
    """Entries of whole lists whose sizes and positions leave room for a link; rows are sorted by list, set size, set.

    Lists that were dealt out, or have more than ``wide`` entries, are kept as they are.
    """
    token, salt, fp, n, pos, dealt = (b[c].to_numpy() for c in ("token", "salt", "fp", "n", "pos", "dealt"))
    new = np.ones(len(b), bool)
    new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
    keep = new.copy()  # one entry of a class, however many tasks have sent it
    keep[1:] |= fp[1:] != fp[:-1]
    token, fp, n, pos, dealt, new = (x[keep] for x in (token, fp, n.astype(np.int64), pos.astype(np.int64), dealt, new))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    which = np.repeat(starts, sizes)
    fits = dealt | np.repeat(sizes > wide, sizes)
    for k in range(1, min(int(sizes.max()), wide)):
        x, y = slice(0, -k), slice(k, None)
        meet = (which[x] == which[y]) & (100 * n[x] >= PERCENT * n[y]) & _room(n[x], pos[x], n[y], pos[y])
        fits[x] |= meet
        fits[y] |= meet
    return pd.DataFrame({"token": token, "fp": fp, "n": n.astype(np.int32), "pos": pos.astype(np.int32)})[fits]


def _bits(n: int) -> int:
    return int(min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length())))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def _filter_of(ids: DataFrame, n: int) -> np.ndarray:
    """A bit filter of the ``fp`` of ``ids``, of bounded size; its false positives cost time and are dropped by a join."""
    bits = _bits(n)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(bits, bool)
        for b in batches:
            seen[_places(b["fp"].to_numpy(), bits)] = True
        yield pd.DataFrame({"marks": [np.packbits(seen).tobytes()]})

    found = np.zeros(bits // 8, np.uint8)
    for r in ids.select("fp").repartition(8).mapInPandas(mark, "marks binary").toLocalIterator():
        found |= np.frombuffer(r["marks"], np.uint8)
    return found


def _sets_of(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """fp, s: the sets of the classes ``wanted`` (fp), made anew from the texts."""
    bits, sent = _bits(n), texts.sparkSession.sparkContext.broadcast(_filter_of(wanted, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marked = np.unpackbits(sent.value).astype(bool)
        seen: set[int] = set()
        for b in batches:
            fps, sets = [], []
            for _, _, s, sizes in shingle_sets(b["text"].tolist(), K):
                found, ends = _fingerprints(s, sizes), np.cumsum(sizes)
                for i in np.flatnonzero((sizes > 0) & marked[_places(found, bits)].all(axis=0)).tolist():
                    fp = int(found[i])
                    if fp not in seen:
                        seen.add(fp)
                        fps.append(fp)
                        sets.append(s[ends[i] - sizes[i] : ends[i]].view(np.int64))
            if fps:
                yield pd.DataFrame({"fp": fps, "s": sets})

    sets = texts.select("text").mapInPandas(run, "fp long, s array<long>")
    # Tasks that hold copies of one class send its set once each; any of them will do.
    return sets.join(wanted.select(F.col("fp").alias("wanted_fp")), F.col("fp") == F.col("wanted_fp"), "left_semi").dropDuplicates(["fp"])


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``shared`` and ``united``: the sizes of intersection and union."""
    right = sets.select(F.col("fp").alias("fb"), F.col("s").alias("sb"))
    left = sets.select(F.col("fp").alias("fa"), F.col("s").alias("sa"))
    both = pairs.join(right, F.col("b") == F.col("fb")).drop("fb").join(left, F.col("a") == F.col("fa")).drop("fa")
    both = both.select(*pairs.columns, F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return both.withColumn("united", F.col("na") + F.col("nb") - F.col("shared")).drop("na", "nb")


def _linked() -> Column:
    return 100 * F.col("shared") >= PERCENT * F.col("united")


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """node, label: the least node of the component of each node of ``links`` (a, b). Staged round by round."""
    edges = stage.put(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = stage.put(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        # Each node takes the least label among its neighbours and itself, then that label's own label.
        seen = edges.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label").unionByName(labels)
        least = stage.put(seen.groupBy("node").agg(F.min("label").alias("label")), f"{name}-{turn}-least")
        jump = least.select(F.col("node").alias("at"), F.col("label").alias("to"))
        new = stage.put(least.join(jump, F.col("label") == F.col("at")).select("node", F.least("label", "to").alias("label")), f"{name}-{turn}")
        old = labels.select(F.col("node").alias("was"), F.col("label").alias("old"))
        changed = not new.join(old, F.col("node") == F.col("was")).filter(F.col("label") != F.col("old")).isEmpty()
        stage.drop(f"{name}-{turn}-least")
        labels = new
        if not changed:
            return labels


def _cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams lists of (token, i, j, side, comp, root, low, high, pos, far), sorted by token, i, j and low: pairs of roots of different components.

    low and high bound the sizes of the sets behind a root, pos is their least position, far their largest distance from it.
    A list with i < j holds two blocks of a longer one, told apart by side; only pairs across them count.
    """
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        token, i, j = (b[c].to_numpy() for c in ("token", "i", "j"))
        others = np.flatnonzero((token != token[-1]) | (i != i[-1]) | (j != j[-1]))
        cut = others[-1] + 1 if len(others) else 0
        rest = b.iloc[cut:]
        if cut:
            yield from _meetings(b.iloc[:cut])
    if rest is not None and len(rest):
        yield from _meetings(rest)


def _meetings(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    token, first, second, side, comp, root, far = (b[c].to_numpy() for c in ("token", "i", "j", "side", "comp", "root", "far"))
    low, high, pos = (b[c].to_numpy().astype(np.int64) for c in ("low", "high", "pos"))
    new = (token[1:] != token[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    starts = np.flatnonzero(np.append(True, new))
    several = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
    ends = np.append(starts[1:], len(token))
    out, size = [], 0
    for start, end in zip(starts[several].tolist(), ends[several].tolist()):
        halves = first[start] != second[start]
        for j in range(start + 1, end):
            meet = (comp[start:j] != comp[j]) & (100 * high[start:j] >= PERCENT * low[j])
            if halves:
                meet &= side[start:j] != side[j]
            i = start + np.flatnonzero(meet)
            i = i[np.minimum(high[i] - pos[i], high[j] - pos[j]) * (100 + PERCENT) >= PERCENT * (low[i] + low[j])]
            if len(i):
                out.append((np.minimum(root[i], root[j]), np.maximum(root[i], root[j]), far[i] + far[j]))
                size += len(i)
        if size >= BLOCK_ROWS:
            yield _pairs(out)
            out, size = [], 0
    if size:
        yield _pairs(out)


def _in_blocks(short: DataFrame, block: int) -> DataFrame:
    """``short`` (token, root and others) with i, j, side: a list of more than ``block`` roots is dealt to a list for each two of its blocks."""
    long = short.groupBy(F.col("token").alias("of")).agg(F.count("*").alias("n")).filter(F.col("n") > block)
    dealt = short.join(long, F.col("token") == F.col("of"), "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("root"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*short.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"))


def _pairs(out: list) -> pd.DataFrame:
    a, b, far = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"a": a, "b": b, "far": far}).groupby(["a", "b"], as_index=False)["far"].max()


def _stars(rows: DataFrame, stage: Stage) -> DataFrame:
    """a, b, turn: for each meeting place its least set (turn 1) or its last one (turn 2), and every other set there whose size can link with it."""
    one = rows.groupBy("fp").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    placed = stage.put(one.select("fp", "n", F.explode("bands").alias("place")), "placed")
    ends = placed.groupBy("place").agg(F.min(F.struct("fp", "n")).alias("first"), F.max(F.struct("fp", "n")).alias("last")).filter(F.col("first.fp") < F.col("last.fp"))
    heads = ends.select(F.col("place").alias("at"), F.explode(F.array(F.struct(F.lit(1).alias("turn"), "first.fp", "first.n"), F.struct(F.lit(2).alias("turn"), "last.fp", "last.n"))).alias("head"))
    heads = stage.put(heads.select("at", "head.turn", F.col("head.fp").alias("a"), F.col("head.n").alias("m")), "heads")
    met = placed.join(heads, F.col("place") == F.col("at")).filter((F.col("fp") != F.col("a")) & (100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")))
    return met.groupBy("a", F.col("fp").alias("b")).agg(F.min("turn").alias("turn"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b and others) whose sets are in different components by ``labels`` (node, label)."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(f"n{c}"), F.col("label").alias(f"l{c}")), F.col(c) == F.col(f"n{c}"), "left")
    return pairs.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("na", "nb", "la", "lb")


def classes(docs: DataFrame, stage: Stage, most: int = LIST, wide: int = WIDE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, n) of every row of ``docs`` and (node, label) of every class that links with another."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = stage.put(texts.mapInPandas(_describe, SETS), "classes")
    sent = docs.sparkSession.sparkContext.broadcast(_sketch(described.filter(F.col("n") < 0)))
    rows = described.filter(F.col("n") >= 0).select("doc_id", "fp", "n")
    stars = stage.put(_stars(described.filter(F.col("n") > 0), stage), "stars")

    entries = texts.select("text").mapInPandas(_index(sent, most), ENTRIES)
    listed = stage.put(entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "fp").mapInPandas(_lists(wide), LISTED), "lists")
    wanted = stage.put(listed.select("fp").unionByName(stars.select(F.explode(F.array("a", "b")).alias("fp"))).distinct(), "wanted")
    sets = stage.put(_sets_of(texts, wanted, wanted.count()), "sets")

    one = stage.put(_compare(stars.filter(F.col("turn") == 1).select("a", "b"), sets).filter(_linked()), "links-1")
    labels = components(one, stage, "components-0")
    # The last sets of the places are compared only with those that the first ones have left apart.
    more = stage.put(_compare(_apart(stars.filter(F.col("turn") == 2).select("a", "b"), labels), sets).filter(_linked()), "links-2")
    one = one.unionByName(more)
    labels = components(one, stage, "components-1")
    # The head through which a set takes part from here on: the one that it is most like.
    like = F.col("shared") / F.col("united")
    heads = one.groupBy("b").agg(F.max_by(F.struct("a", (1 - like).alias("far")), F.struct(like, F.col("a"))).alias("h"))
    role = labels.join(heads, F.col("node") == F.col("b"), "left")
    role = stage.put(role.select("node", "label", F.coalesce("h.a", "node").alias("root"), F.coalesce("h.far", F.lit(0.0)).alias("far")), "roles")
    joined = listed.join(role, F.col("fp") == F.col("node"), "left").select(
        "token", "fp", "n", "pos", F.coalesce("label", "fp").alias("comp"), F.coalesce("root", "fp").alias("root"), F.coalesce("far", F.lit(0.0)).alias("far")
    )
    short = joined.groupBy("token", "comp", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("pos"), F.max("far").alias("far"))
    met = _in_blocks(stage.put(short, "short"), block).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "low", "root")
    met = met.mapInPandas(_cross, "a long, b long, far double")
    met = stage.put(met.groupBy("a", "b").agg(F.max("far").alias("far")), "met")
    two = stage.put(_compare(met, sets), "compared")
    links = one.select("a", "b").unionByName(two.filter(_linked()).select("a", "b"))
    labels = components(links, stage, "components-2")
    behind = two.filter(~_linked() & (F.col("far") > 0)).select("a", "b", (1 - F.col("shared") / F.col("united")).alias("apart"), "far")
    behind = stage.put(_apart(behind.filter(F.col("apart") <= _REACH + F.col("far")), labels), "between")
    if behind.isEmpty():
        return rows, labels
    more = _behind(behind, role, sets, stage, block)
    if more.isEmpty():
        return rows, labels
    return rows, components(links.unionByName(more), stage, "components-3")


def _behind(pairs: DataFrame, role: DataFrame, sets: DataFrame, stage: Stage, block: int) -> DataFrame:
    """a, b: links between sets behind the two roots of ``pairs`` (a, b, apart), no more than one for each set and block of the other root."""
    members = role.filter(F.col("node") != F.col("root")).select("root", "node", F.col("far").alias("off"))
    families = stage.put(members.groupBy(F.col("root").alias("of")).agg(F.count("*").alias("size"), F.max("off").alias("most")), "families")
    for c in ("a", "b"):
        pairs = pairs.join(families.select(F.col("of").alias(f"of_{c}"), F.col("size").alias(f"size_{c}"), F.col("most").alias(f"most_{c}")), F.col(c) == F.col(f"of_{c}"), "left")
    # h is the root with more sets behind it, g the other one.
    swap = F.coalesce("size_a", F.lit(0)) < F.coalesce("size_b", F.lit(0))
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    pairs = pairs.select(pick("a", "b", "h"), pick("b", "a", "g"), pick("most_a", "most_b", "most"), "apart")
    pairs = stage.put(pairs.filter(F.col("most").isNotNull()), "pairs")
    # A set y behind g, or g itself, whose bound leaves h or the sets behind it open.
    ys = members.select("root", F.col("node").alias("y"), "off")
    asked = pairs.select("h", F.col("g").alias("y"), "most").unionByName(
        pairs.join(ys, F.col("g") == F.col("root")).filter(F.col("apart") <= _REACH + F.col("most") + F.col("off")).select("h", "y", "most")
    )
    asked = stage.put(_compare(asked.distinct().select(F.col("y").alias("a"), F.col("h").alias("b"), "most"), sets), "asked")
    direct = asked.filter(_linked()).select("a", "b")
    asked = asked.filter(~_linked()).select("a", "b", "shared", (1 - F.col("shared") / F.col("united")).alias("apart"), "most").filter(F.col("apart") <= _REACH + F.col("most"))
    # What is behind h, in blocks by distance: a set as what it has and lacks of h.
    family = members.join(asked.select(F.col("b").alias("asked")).distinct(), F.col("root") == F.col("asked"), "left_semi").withColumn("ring", F.floor(F.col("off") * RINGS).cast("int"))
    rings = family.groupBy(F.col("root").alias("of"), F.col("ring").alias("at")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    family = family.join(rings, (F.col("root") == F.col("of")) & (F.col("ring") == F.col("at")))
    family = family.select("root", "node", "off", (F.col("ring") * F.lit(1 << 40) + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    family = stage.put(family, "family")
    blocks = family.groupBy(F.col("root").alias("of"), "block").agg(F.max("off").alias("reach"))
    own, head = sets.select(F.col("fp").alias("fx"), F.col("s").alias("sx")), sets.select(F.col("fp").alias("fh"), F.col("s").alias("sh"))
    family = family.join(own, F.col("node") == F.col("fx")).join(head, F.col("root") == F.col("fh"))
    family = family.select("root", "block", "node", "off", F.size("sx").alias("n"), F.array_except("sx", "sh").alias("has"), F.array_except("sh", "sx").alias("lacks"))
    tries = asked.join(blocks, F.col("b") == F.col("of")).filter(F.col("apart") <= _REACH + F.col("reach"))
    # Many sets that ask one block are dealt to several tasks, each of which has the block.
    tries = stage.put(tries.select(F.col("b").alias("root"), "block", F.col("a").alias("y"), "shared", "apart"), "tries")
    deals = tries.groupBy("root", "block").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("deals"))
    tries = tries.join(deals, ["root", "block"]).withColumn("deal", F.pmod(F.xxhash64("y"), F.col("deals")).cast("int")).join(sets.withColumnRenamed("s", "sy"), F.col("y") == F.col("fp"))
    family = family.join(deals, ["root", "block"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    keys = ["root", "block", "deal"]
    found = tries.select(*keys, "y", "shared", "apart", "sy").groupBy(*keys).cogroup(family.select(*keys, "node", "off", "n", "has", "lacks").groupBy(*keys))
    return stage.put(found.applyInPandas(_derive, "a long, b long").unionByName(direct), "links-3")


#: How far apart linked sets are at most, with a margin for rounding.
_REACH = 1 - PERCENT / 100 + 1e-9


def _derive(tries: pd.DataFrame, family: pd.DataFrame) -> pd.DataFrame:
    """Each set that asks (y, its set sy, what it shares with the root, its distance) with the first set of a block that it links to, if any."""
    parts = [np.concatenate([np.asarray(x, np.int64) for x in family[c]]) if len(family) else np.empty(0, np.int64) for c in ("has", "lacks")]
    ends = [np.cumsum([0, *map(len, family[c])]) for c in ("has", "lacks")]
    node, off, n = family["node"].to_numpy(), family["off"].to_numpy(), family["n"].to_numpy().astype(np.int64)
    out = []
    for y, shared, apart, sy in zip(tries["y"], tries["shared"], tries["apart"], tries["sy"]):
        s = np.sort(np.asarray(sy, np.int64))
        changes = []
        for part, end in zip(parts, ends):
            held = s[np.minimum(np.searchsorted(s, part), len(s) - 1)] == part
            sums = np.concatenate([[0], np.cumsum(held)])
            changes.append(sums[end[1:]] - sums[end[:-1]])
        both = shared + changes[0] - changes[1]
        linked = np.flatnonzero((apart <= _REACH + off) & (100 * both >= PERCENT * (len(s) + n - both)))
        if len(linked):
            out.append((y, node[linked[0]]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def link_components(docs: DataFrame, most: int = LIST, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    stage = Stage(docs.sparkSession, "sets")
    rows, labels = classes(docs, stage, most, wide, block)
    least = rows.filter(F.col("n") > 0).groupBy("fp").agg(F.min("doc_id").alias("doc"))
    labelled = stage.put(least.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("label", "fp").alias("label")), "labelled")
    least = stage.put(labelled.groupBy("label").agg(F.min("doc").alias("component")).withColumnRenamed("label", "of"), "least")
    named = stage.put(labelled.join(least, F.col("label") == F.col("of")).select(F.col("fp").alias("class"), "component"), "named")
    full = rows.join(named, (F.col("fp") == F.col("class")) & (F.col("n") > 0), "left")
    return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op8_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = rf"""
with words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
shingles as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {K} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {K} + 2), lambda i: array_to_string(w[i:i + {K} - 1], ' '))) end as s
  from words),
sized as (select doc_id, len(s)::bigint as n, s from shingles),
entry as (select doc_id, n, unnest(s) as t from sized),
shared as (
  select x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb, count(*) as k
  from entry x join entry y on x.t = y.t and x.doc_id < y.doc_id and 100 * x.n >= {PERCENT} * y.n and 100 * y.n >= {PERCENT} * x.n
  group by all),
link as (select a, b from shared where 100 * k >= {PERCENT} * (na + nb - k)),
edge as (select a, b from link union all select b, a from link),
reach as (
  with recursive r(a, b) as (select doc_id, doc_id from sized union select r.a, e.b from r join edge e on r.b = e.a)
  select a, min(b) as component_id from r group by a)
select s.doc_id, s.n as n_shingles, r.component_id from sized s join reach r on r.a = s.doc_id
"""


@F.pandas_udf(LongType())
def _class_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda text: _fingerprint(shingle_set(words_of(text), K)), na_action=None).astype(np.int64)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest doc_id, null after all others; then of the least class hash and text.

    Rows with an empty set, null and empty texts among them, all stay, but for those that repeat a doc_id and its text. Other columns pass
    through, whatever their names; an empty table stays empty.
    """
    stage = Stage(docs.sparkSession, "kept")
    id_, lost, class_, at = fresh(docs, "id", "lost", "class", "at")
    rows, labels = classes(docs, stage)
    found = rows.filter(F.col("n") > 0).join(labels, F.col("fp") == F.col("node"), "left")
    found = stage.put(found.select("doc_id", "fp", F.coalesce("label", "fp").alias("label")), "components")
    first = found.groupBy(F.col("label").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("first"))
    other = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("fp") != F.col("first.fp"))
    gone = stage.put(found.join(first, F.col("label") == F.col("of")).filter(other).select(F.col("doc_id").alias(id_), F.col("fp").alias(lost)), "gone")
    # A doc_id that one row has names that row; rows that share one or have none are told apart by their class.
    again = stage.put(rows.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(id_)).count().filter(F.col("count") > 1).select(id_), "again")
    named = docs.filter(F.col("doc_id").isNotNull())
    left = named.join(gone.select(id_).unionByName(again), F.col("doc_id") == F.col(id_), "left_anti")
    if again.isEmpty() and rows.filter(F.col("doc_id").isNull()).isEmpty():
        return left
    shared = named.join(again, F.col("doc_id") == F.col(id_), "left_semi").unionByName(docs.filter(F.col("doc_id").isNull()))
    shared = shared.withColumn(class_, _class_of(F.col("text")))
    shared = shared.join(gone.distinct(), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(class_) == F.col(lost)), "left_anti")
    one = Window.partitionBy("doc_id", class_, F.when(F.col(class_) == 0, F.col("text"))).orderBy("text")
    return left.unionByName(shared.withColumn(at, F.row_number().over(one)).filter(F.col(at) == 1).drop(class_, at))

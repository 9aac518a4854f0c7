"""Exact top-k by inner product with M-trees: paged metric nodes, covering radii, stored parent distances, best-first search.

Components become integers, floor(256 * x). Inner products turn into a metric by one more coordinate: with M the
largest norm, a stored vector v gets sqrt(M*M - |v|*|v|) and a query 0, so that the squared Euclidean distance is
|q|*|q| + M*M - 2 * <q, v> and the nearest rows are those with the highest scores.

The tree's top level is spread over the cluster. A bounded number of pivots (rows picked by a hash of their id) routes every
row to its nearest pivot; the ball of a pivot with more than ``SUBTREE`` rows is cut into rings by distance, and a ring with more
rows than that by a hash, so a vector that fills a third of the table fills many subtrees. A subtree is an M-tree of fixed-size pages in one task, with
covering radius and distance to the parent page stored in every entry. A search has two passes:

1. each query visits one part of its nearest pivot, which gives a first bound on its k-th score;
2. it visits only the other subtrees whose ring lets them hold a row that scores at least that much.

Inside a subtree pages are taken best first; a page is skipped without computing its distance when the
stored parent distances show, by the triangle inequality, that it lies too far. The search ends when the nearest
page left can't reach the k-th score. Scores are computed exactly, in integers; bounds keep a margin for
rounding, and an equal bound is still visited, so ties come out by the smaller id.

Defined results: rows whose vector or id is null, or whose vector holds null or non-finite components, take no part;
vectors of other lengths are padded with zeros; an empty vector scores 0. All rows with the query's id are its own.
Repeated rows are candidates of their own; repeated queries are answered once. Scores are exact whatever the components' size: where sums of
products may leave the integers that doubles hold, the rows in reach are scored in whole numbers. A component or score that no long
holds is an error. Fewer than k candidates give all of them; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, table

K, SCALE = 5, 256
#: Entries of a page, rows of a subtree (the memory of one task), pivots of the top level (the most that is broadcast).
PAGE, SUBTREE, PIVOTS = 512, 8192, 1024
#: Queries that one task answers.
QUERY_BLOCK = 4096
FOUND = "query_id long, vec_id long, score long"


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (integer components) of the rows that take part."""
    x = F.col(f"`{vector}`")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))

    def whole(e: Column) -> Column:
        scaled = e.cast("double") * SCALE
        return F.when(F.abs(scaled) < 2.0**63, F.floor(scaled)).otherwise(F.raise_error(F.lit("a component is too large for a long")).cast("long"))

    fine = df.filter(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return fine.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


#: Up to this squared norm all products and their sums are exact in doubles.
EXACT = 2.0**52


def _matrix(vectors, width: int, kind=np.float64) -> np.ndarray:
    out = np.zeros((len(vectors), width), kind)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """With the extra coordinate; ``most`` is the largest squared norm."""
    return np.hstack([x, np.sqrt(np.maximum(0, most - np.einsum("ij,ij->i", x, x)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


class MTree:
    """An M-tree over lifted vectors, bulk loaded: a page is (pivot, radius, parent distance, child pages or rows)."""

    class Page:
        __slots__ = ("centre", "radius", "to_parent", "children", "rows", "row_to_parent")

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float, page: int = PAGE, whole: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.page = ids[order], x[order], page
        self.whole = None if whole is None else whole[order].astype(object)
        self.lifted = _lifted(self.x, most)
        self.root = self._load(np.arange(len(self.ids)), self.lifted.mean(0) if len(ids) else self.lifted.sum(0), None)

    def _load(self, rows: np.ndarray, centre: np.ndarray, parent: np.ndarray | None) -> MTree.Page:
        p = MTree.Page()
        p.centre = centre
        d = np.sqrt(((self.lifted[rows] - centre) ** 2).sum(1))
        p.radius = float(d.max(initial=0.0))
        p.to_parent = 0.0 if parent is None else float(np.sqrt(((centre - parent) ** 2).sum()))
        p.children, p.rows, p.row_to_parent = [], rows, d
        if len(rows) <= self.page:
            return p
        fan = min(self.page, -(-len(rows) // self.page) * 2)
        picked = self.lifted[rows[np.linspace(0, len(rows) - 1, fan).astype(int)]]
        near = np.concatenate([_distances(self.lifted[part], picked).argmin(1) for part in np.array_split(rows, -(-len(rows) // 8192))])
        groups = [rows[near == g] for g in range(fan)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:  # all alike: no pivot tells them apart
            groups = np.array_split(rows, fan)
        p.children = [self._load(g, self.lifted[g].mean(0), centre) for g in groups]
        p.rows = None
        return p

    def search(self, q: np.ndarray, query_id: int, k: int, most: float, floor: float = -np.inf, whole: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) for ``q`` among rows with another id; rows that score below ``floor`` may be left out.

        ``whole`` is q in whole numbers, for a tree that has its rows so.
        """
        if not len(self.ids):
            return []
        qq = float(q @ q)
        lifted = np.append(q, 0.0)
        slack = 1e-6 * (qq + most) + 1e-3

        def score_at(distance: float) -> float:
            return (qq + most - max(0.0, distance) ** 2) / 2 + slack

        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        low = floor
        d = float(np.sqrt(((lifted - self.root.centre) ** 2).sum()))
        heap = [(max(0.0, d - self.root.radius), 0, d, self.root)]
        n = 0
        while heap:
            bound, _, d, page = heapq.heappop(heap)
            if score_at(bound) < low:
                break
            if page.rows is None:
                # A child is at least |d - its parent distance| away: most need no distance of their own.
                kept = [c for c in page.children if score_at(abs(d - c.to_parent) - c.radius) >= low]
                if kept:
                    for c, dc in zip(kept, np.sqrt(((np.array([c.centre for c in kept]) - lifted) ** 2).sum(1)).tolist()):
                        if score_at(dc - c.radius) >= low:
                            n += 1
                            heapq.heappush(heap, (max(0.0, dc - c.radius), n, dc, c))
                continue
            reach = (qq + most - np.abs(d - page.row_to_parent) ** 2) / 2 + slack
            rows = page.rows[reach >= low]
            scores = self.x[rows] @ q
            for i in np.flatnonzero(scores >= (low if self.whole is None else low - slack)):
                vec_id = int(self.ids[rows[i]])
                if vec_id == query_id:
                    continue
                item = (int(scores[i] if self.whole is None else self.whole[rows[i]] @ whole), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                else:
                    continue
                if len(best) == k:
                    low = max(low, best[0][0])
        return [(s, -i) for s, i in best]


def _answer(k: int, most: float, width: int):
    """Answers one block of the queries that visit a subtree."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            large = most >= EXACT
            tree = MTree(rows["vec_id"].to_numpy(), _matrix(rows["v"], width), most, whole=_matrix(rows["v"], width, np.int64) if large else None)
            whole = _matrix(queries["v"], width, np.int64).astype(object) if large else [None] * len(queries)
            for query_id, q, low, w in zip(queries["query_id"], _matrix(queries["v"], width), queries["low"], whole):
                out += [(query_id, i, s) for s, i in tree.search(q, int(query_id), k, most, low, w)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def top_k(df: DataFrame, queries: DataFrame, k: int = K, subtree: int = SUBTREE, pivots: int = PIVOTS, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``df`` (vec_id, v) for each row of ``queries`` (query_id, v)."""
    spark = df.sparkSession
    stage = Stage(spark, "mtree")
    rows = stage.put(df, "rows")
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    asked = stage.put(queries.dropDuplicates(["query_id", "v"]), "queries")
    stats = rows.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.max(F.size("v")).alias("width")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not stats["n"]:
        return empty
    most, width = float(stats["most"]), max(1, stats["width"], asked.agg(F.max(F.size("v"))).first()[0] or 1)
    n_pivots = max(1, min(pivots, stats["n"] // subtree))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("v").collect()
    centres = _lifted(_matrix([r["v"] for r in picked], width), most)
    sent = spark.sparkContext.broadcast(centres)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _distances(_lifted(_matrix(b["v"], width), most), sent.value)
            near = d.argmin(1)
            yield b.assign(pivot=near.astype("int32"), distance=d[np.arange(len(b)), near])

    routed = stage.put(rows.mapInPandas(route, "vec_id long, v array<long>, pivot int, distance double"), "routed")
    ball = routed.groupBy("pivot").agg(F.ceil(F.count("*") / subtree).alias("rings"), F.max("distance").alias("radius"))
    ball = ball.select(F.col("pivot").alias("of"), "rings", "radius")
    ring = F.least(F.floor(F.col("distance") / F.greatest("radius", F.lit(1e-9)) * F.col("rings")), F.col("rings") - 1).cast("int")
    ringed = stage.put(routed.join(ball, F.col("pivot") == F.col("of")).select("vec_id", "v", "pivot", "distance", ring.alias("ring")), "ringed")
    rings = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / subtree).cast("int").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    rings = sorted(rings.collect(), key=lambda r: (r["pivot"], r["ring"]))  # at most the pivots and two for each subtree's rows
    first = np.cumsum([0, *(r["n"] for r in rings)])
    parts = spark.createDataFrame([(r["pivot"], r["ring"], int(at), r["n"]) for r, at in zip(rings, first)], "of int, at int, first int, n int")
    leaves = ringed.join(parts, (F.col("pivot") == F.col("of")) & (F.col("ring") == F.col("at")))
    leaves = stage.put(leaves.select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("n"))).cast("int").alias("part")), "leaves")
    of_part = np.repeat(np.arange(len(rings)), [r["n"] for r in rings])
    bounds = spark.sparkContext.broadcast((np.array([r["pivot"] for r in rings])[of_part], np.array([r["low"] for r in rings])[of_part], np.array([r["high"] for r in rings])[of_part]))
    answer = _answer(k, most, width)

    def visit(name: str, asked_of: DataFrame) -> DataFrame:
        """The answers of the subtrees (``part``) that queries are sent to, at most ``block`` queries in a task."""
        asked_of = stage.put(asked_of, f"{name}-sent")
        counts = asked_of.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumnRenamed("part", "of")
        left = leaves.join(counts, F.col("part") == F.col("of")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = asked_of.join(counts, F.col("part") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit("block")), F.col("blocks")).cast("int"))
        left, right = left.select("vec_id", "v", "part", "block"), right.select("query_id", "v", "low", "part", "block")
        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(answer, FOUND)

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query how near the rows of each part can be at best, and its home: the part with the least such distance, of equal ones that of the nearest pivot."""
        pivot, low, high = bounds.value
        d = _distances(np.hstack([x, np.zeros((len(x), 1))]), sent.value)[:, pivot]
        near = np.maximum(0, np.maximum(d - high, low - d))
        return near, np.where(near == near.min(1, keepdims=True), d, np.inf).argmin(1)

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """So many queries that a number for each of them and each part fits easily."""
        rows = max(1, (1 << 22) // int(first[-1]))
        return (b.iloc[i : i + rows] for b in batches for i in range(0, len(b), rows))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            yield b.assign(part=nearest(_matrix(b["v"], width))[1].astype("int32"), low=-np.inf)

    sent_rows = "query_id long, v array<long>, part int, low double"
    one = stage.put(visit("first", asked.mapInPandas(home, sent_rows)), "first")
    worst = one.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    low = F.when(F.col("n") >= k, F.col("s")).cast("double")
    known = asked.join(worst, "query_id", "left").select("query_id", "v", F.coalesce(low, F.lit(float("-inf"))).alias("low"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            x = _matrix(b["v"], width)
            near, at_home = nearest(x)
            qq = np.einsum("ij,ij->i", x, x)[:, None]
            reach = (qq + most - near**2) / 2 + 1e-6 * (qq + most) + 1e-3 >= b["low"].to_numpy()[:, None]
            reach[np.arange(len(b)), at_home] = False
            for i in range(len(b)):
                to = np.flatnonzero(reach[i])
                if len(to):
                    r = b.iloc[i]
                    yield pd.DataFrame({"query_id": r["query_id"], "v": [r["v"]] * len(to), "part": to.astype("int32"), "low": r["low"]})

    two = visit("others", known.mapInPandas(others, sent_rows))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return one.unionByName(two).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"))


OP5_SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, coalesce(list_inner_product(q.v, c.v), 0)::bigint as score
  from rows q join rows c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

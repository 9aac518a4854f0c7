import math
import random

import pytest
from pyspark.sql import functions as F

from voxgrain.llm.metric_tree import quantised, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, part string"


def run(spark, rows, k=5, **sizes):
    v = quantised(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA))
    return sorted(tuple(r) for r in top_k(v, v.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), k, **sizes).collect())


def brute(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in fine:
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rnd.gauss(0, 0.3) for c in rnd.choice(centres)]) for i in range(1500)]
    rows = [(i, [float(x) for x in __import__("numpy").float32(v)]) for i, v in rows]
    assert run(spark, rows, subtree=100, pivots=6, block=7) == brute(rows)


def test_large_components_are_exact(spark):
    """Scores far beyond the integers that doubles hold, some of which differ in their last digit only."""
    rnd = random.Random(4)
    rows = [(i, [float(rnd.choice([1, 1, 1e3, 3e5]) * rnd.randint(-9, 9)) + rnd.randrange(256) / 256 for _ in range(3)]) for i in range(300)] + [(400, [1e7, 0.0, 0.0]), (401, [1e7, 1 / 256, 0.0]), (402, [1e7, 2 / 256, 0.0])]
    rows = [(i, [float(x) for x in __import__("numpy").float32(v)]) for i, v in rows]
    assert run(spark, rows, subtree=40, pivots=4) == brute(rows)


def test_copies_and_ties(spark):
    """One vector fills most of the table: many equal scores, many parts of one pivot."""
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(700)] + [(700 + i, [i / 64, 1.0, -0.5]) for i in range(100)]
    assert run(spark, rows, subtree=50, pivots=8) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [3.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="too large for a long"):
        run(spark, [(0, [1e30]), (1, [-1e30]), (2, [1.0])])
    assert run(spark, rows[:1]) == [] and run(spark, []) == [] and run(spark, [(1, [1.0])]) == []

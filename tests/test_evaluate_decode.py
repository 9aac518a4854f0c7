import math
import random

import numpy as np
from pyspark.sql import functions as F

from voxgrain.functions import numeric as N
from voxgrain.operators import decode as D
from voxgrain.operators import evaluate as E


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_distance_and_alignment(spark):
    rnd = random.Random(8)
    pairs = [([rnd.choice("abcdé") for _ in range(rnd.randrange(9))], [rnd.choice("abcdé") for _ in range(rnd.randrange(9))]) for _ in range(300)]
    pairs.append(("the quick brown fox jumps".split(), "the quick red fox jumps over".split()))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    rows = sorted(df.select("i", E.word_distance(a, b).alias("d"), E.error_rate(a, b).alias("w"), E.matched(a, b).alias("m")).collect())
    for r, (x, y) in zip(rows, pairs):
        assert r.d == distance(x, y)
        assert r.w == r.d / len(x) if x else (math.isnan(r.w) if not y else math.isinf(r.w))
        assert sum(r.m.of_a) == sum(r.m.of_b) and [w for w, k in zip(x, r.m.of_a) if k] == [w for w, k in zip(y, r.m.of_b) if k]
    assert rows[-1].d == 2 and rows[-1].w == 0.4


def test_distance_of_many_words(spark):
    x, y = [f"w{i}" for i in range(9000)], [f"v{i}" for i in range(100)] + [f"w{i}" for i in range(0, 9000)]
    df = spark.createDataFrame([(x, y)], "a array<string>, b array<string>")
    assert df.select(E.word_distance(F.col("a"), F.col("b"))).first()[0] == 100


def test_spans(spark):
    a, b = "one two three four five six seven x eight nine ten a b c d".split(), "one two three four five six seven y eight nine ten a b c d".split()
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    r = df.select(E.differing_spans(F.col("a"), F.col("b"), k=3).alias("s"), E.agreement(F.array_join("a", " "), F.array_join("b", " ")).alias("r")).first()
    assert [tuple(s) for s in r.s] == [("seven x", "seven y")] and 0.9 < r.r < 1


def test_separation(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("xy"), rnd.randrange(6) / 2, rnd.random() < 0.4) for _ in range(300)] + [("z", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, s double, low boolean")
    for r in E.separation(df, "s", "low", "g").collect():
        low, high = [[s for g, s, v in rows if g == r.g and v == side] for side in (True, False)]
        if high:
            assert math.isclose(r.auc, sum(1 if x < y else 0.5 * (x == y) for x in low for y in high) / len(low) / len(high))
        else:
            assert math.isnan(r.auc)
    got = {r.g: r for r in E.gate_counts(df, "s", "low", 1.0, "g").collect()}
    assert got["x"].flagged == sum(g == "x" and s < 1 for g, s, _ in rows)


def test_stretches_of_scores(spark):
    """Stretches rise with the score and are of like size, with an outlier, scores of all scales, infinities and NaN."""
    rnd = random.Random(9)
    rows = [("a", s) for s in {rnd.random() for _ in range(20_000)} | {1e300, -1e300}] + [("b", 10.0 ** rnd.uniform(-300, 300)) for _ in range(5000)]
    rows += [("c", s) for s in (float("-inf"), 0.0, 1.0, float("inf"), float("nan"))] + [(None, 1.0)]
    found = E.stretches(spark.createDataFrame(rows, "g string, s double"), "s", ["g"]).collect()
    assert len(found) == len(rows)
    for g in "abc":
        mine = sorted((r for r in found if r.g == g), key=lambda r: (math.isnan(r.s), r.s))
        assert [r.bin_ for r in mine] == sorted(r.bin_ for r in mine)
        sizes = sorted(np.unique([r.bin_ for r in mine], return_counts=True)[1])
        assert g == "c" or len(sizes) > 900 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    ranked = E._below(spark.createDataFrame([(*r, 1) for r in rows], "g string, s double, n int"), "s", "n", ["g"]).collect()
    a = sorted(s for g, s in rows if g == "a")
    assert sorted((r.s, r.below) for r in ranked if r.g == "a") == [(s, k) for k, s in enumerate(a)]


def test_collapse(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 2, 2, 0, 2, 3, 3])], "clip string, frame int, id int")
    assert [r.id for r in D.ctc_collapse(df, "id", 0, ["frame"], "clip").orderBy("frame").collect()] == [2, 2, 3]
    logits = [[1.0 if j == v else 0.0 for j in range(4)] for v in [0, 2, 2, 0, 2, 3, 3]]
    assert spark.createDataFrame([(logits,)], "l array<array<double>>").select(D.ctc_ids(F.col("l"))).first()[0] == [2, 2, 3]


def test_logits(spark):
    df = spark.createDataFrame([([1000.0] * 3,), ([0.0, 10.0, 0.0],), ([1.0, 5.0, 5.0, 2.0],), ([],)], "v array<double>").coalesce(1)
    v = F.col("v")
    rows = df.select(N.argmax_first(v).alias("f"), N.argmax_last(v).alias("l"), N.softmax_at(v, F.lit(0)).alias("p0"), N.softmax_at(v, F.lit(1)).alias("p1"), N.top_two(v).alias("t")).collect()
    assert abs(rows[0].p0 - 1 / 3) < 1e-9 and rows[1].p1 > 0.99 > 0.01 > rows[1].p0
    assert [(r.f, r.l) for r in rows] == [(0, 2), (1, 1), (1, 2), (0, None)] and rows[3].p0 == 0
    assert abs(rows[2].t.p1 - rows[2].t.p2) < 1e-12


def test_words(spark):
    pieces = [("a", 0, " hel", 0.9), ("a", 1, "lo", 0.4), ("a", 2, " there", 0.8), ("b", 0, " phenomenal", 0.97), ("b", 1, ".", 0.31), ("c", 0, " ...", 0.2), ("c", 1, " ", 0.1)]
    df = spark.createDataFrame(pieces, "clip string, pos int, piece string, p double")
    got = sorted((r.clip, r["index"], r.word, r.confidence) for r in D.word_confidences(df, "clip").collect())
    assert got == [("a", 0, "hello", 0.4), ("a", 1, "there", 0.8), ("b", 0, "phenomenal.", 0.97), ("c", 0, "...", 1.0)]
    marked = df.select("clip", "pos", F.regexp_replace("piece", "^ ", "▁").alias("piece"), F.col("p").alias("p1"), (F.col("p") / 2).alias("p2"))
    got = sorted((r.clip, r["index"], r.word, r.p1, round(r.margin, 6)) for r in D.word_margins(marked, "clip").collect())
    assert got == [("a", 0, "hello", 0.4, 0.2), ("a", 1, "there", 0.8, 0.4), ("b", 0, "phenomenal.", 0.97, 0.485)]


def test_transducers(spark):
    script = {0: [(3, 0), (0, 2)], 2: [(0, 1)], 3: [(5, 4)], 7: [(1, 0)] * 12}

    def joint(previous, state, frame):
        at, done = int(frame[0]), state or {}
        n = done.get(at, 0)
        token, skip = script.get(at, [(0, 1)])[min(n, len(script.get(at, [0])) - 1)]
        logits = np.full(11, -1.0)
        logits[token], logits[6 + skip] = 1, 1
        return logits, {**done, at: n + 1}

    frames = np.arange(9.0)[:, None]
    tokens = D.tdt_greedy(frames, joint, width=6, blank=0)
    assert [(i, f) for _, i, f, _ in tokens] == [(3, 0), (5, 3)] + [(1, 7)] * 10
    plain = D.rnnt_greedy(frames, lambda p, s, f: (np.array([0.0, 1.0 if (s or 0) < 13 else -1.0]), (s or 0) + 1), blank=0)
    assert [f for *_, f, _ in plain] == [0] * 10 + [1] * 3
    df = spark.createDataFrame([("x", int(f), [float(f)]) for f in range(9)], "clip_id string, frame int, features array<double>")
    got = D.decode_clips(df.repartition(3), lambda x: D.tdt_greedy(x, joint, width=6, blank=0)).orderBy("pos").collect()
    assert [(r.id, r.frame) for r in got] == [(i, f) for _, i, f, _ in tokens]


def test_times(spark):
    r = spark.sql("select timestamp '2026-09-06 17:19:20' ts").select(
        N.stamp(F.col("ts")).alias("s"), N.parse_stamp(F.lit("2026-09-06T17-19-20Z")).alias("p"), N.parse_stamp(F.lit("2026-09-06")).alias("n"), N.clock(F.lit(600)).alias("c"),
        N.civil_date(F.lit(19782)).alias("d"), N.duration(F.lit(100), F.lit(0)).alias("u"), N.frame_seconds(F.lit(25)).alias("f"), F.col("ts"),
        N.chunk_frames(F.lit('{"encoder":{"chunk_mel_frames":56}}'), F.lit("x-1120ms-config")).alias("c1"), N.chunk_frames(F.lit(None).cast("string"), F.lit("en-0.6b-onnx-1120ms-int4")).alias("c2"),
        N.chunk_frames(F.lit("{"), F.lit("streaming-en-0.6b-int4")).alias("c3"), N.folded(F.lit(10_000), F.lit(16_000)).alias("a"),
    ).first()
    assert (r.s, r.n, r.c, str(r.d), r.u, r.f, r.a) == ("2026-09-06T17-19-20Z", None, "10:00", "2024-02-29", 100.0, 2.0, 6000) and r.p == r.ts and (r.c1, r.c2, r.c3) == (56, 112, 56)

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxgrain.operators import blocks as B
from voxgrain.operators import signal as S

RNG = np.random.default_rng(7)


def cut(clips, seed=0, least=1, most=900):
    """Clips as rows of random lengths, in any order."""
    rnd, rows = np.random.default_rng(seed), []
    for name, x in clips.items():
        at = 0
        while at < len(x):
            n = int(rnd.integers(least, most))
            rows.append((name, at, x[at : at + n].tolist()))
            at += n
        if not len(x):
            rows.append((name, 0, []))
    rnd.shuffle(rows)
    return rows


def frame(spark, clips, **how):
    return spark.createDataFrame(cut(clips, **how), "clip_id string, start long, samples array<float>").repartition(3)


def whole(df):
    """Blocks put together, clip by clip; they have to tile."""
    out = {}
    for r in df.orderBy("clip_id", "start").collect():
        held = out.setdefault(r.clip_id, [])
        assert r.start == len(held)
        held += r.samples
    return out


@pytest.mark.parametrize("kernel", [B.Resampling(44_100, 16_000), B.Resampling(16_000, 44_100), B.Resampling(8000, 8000), B.LogMel(S.htk_filters(4)), B.DecibelMel(S.htk_filters(4))])
def test_what_a_kernel_reads(kernel):
    """``count``, ``first`` and ``end`` agree with what ``run`` looks at: spoiling all other samples changes nothing."""
    n = 3000
    x = RNG.normal(size=n).astype(np.float32)
    want = kernel.run(0, kernel.total(n), x, 0, n)
    assert len(want) == kernel.total(n)
    for k in [0, 1, 2, 3, 5, kernel.total(n) // 2, kernel.total(n) - 1]:
        low, high = kernel.first(k), min(n, kernel.end(k))
        part = kernel.run(k, k + 1, x[low:high], low, n)
        assert np.allclose(part[0], want[k], atol=1e-6)
        assert kernel.count(kernel.end(k)) > k >= kernel.count(kernel.end(k) - 1)
        if kernel.end(k) <= n:
            assert np.allclose(kernel.run(k, k + 1, x[low:high], low, None)[0], want[k], atol=1e-6)


@pytest.mark.parametrize(("source", "target", "size"), [(44_100, 16_000, 700), (16_000, 44_100, 5000), (48_000, 16_000, 1 << 20), (16_000, 16_000, 300)])
def test_resampled_blocks_are_resampled_clips(spark, source, target, size):
    clips = {"a": RNG.normal(size=20_011).astype(np.float32), "b": RNG.normal(size=5).astype(np.float32), "c": np.empty(0, np.float32), "d": RNG.normal(size=6300).astype(np.float32)}
    got = whole(B.resampled(frame(spark, clips), source, target, size))
    for name, x in clips.items():
        want = S.resample_array(x, source, target)
        assert len(got.get(name, [])) == len(want) and np.abs(np.array(got.get(name, [])) - want).max(initial=0) < 1e-6


def test_a_long_clip_spans_tasks(spark):
    """One clip of 10**7 samples, cut on the executors: every segment is alike in size, and equals the whole."""
    n, row = 10_000_000, 50_000
    make = F.pandas_udf(lambda s: s.map(lambda k: np.sin(np.arange(k, k + row, dtype=np.float64) ** 1.01 / 9)), "array<float>")
    rows = spark.range(0, n, row, 8).select(F.lit("a").alias("clip_id"), F.col("id").alias("start"), make("id").alias("samples"))
    found = B.resampled(rows, 44_100, size=1 << 17).withColumn("n", F.size("samples"))
    sizes = [r.n for r in found.select("start", "n").orderBy("start").collect()]
    assert sum(sizes) == int(n / (44_100 / 16_000)) and len(sizes) == 28 and set(sizes[:-1]) == {1 << 17}
    x = np.sin(np.arange(n, dtype=np.float64) ** 1.01 / 9).astype(np.float32)
    for k in (0, 13, 27):
        got = found.filter(F.col("start") == k << 17).first()
        want = S.polyphase(44_100, 16_000).at(got.start, got.start + got.n, x, 0)
        assert np.abs(np.array(got.samples) - want).max() < 1e-6


@pytest.mark.parametrize("size", [3, 16, 1000])
def test_log_mels_of_blocks(spark, size):
    filters = S.htk_filters(20)
    clips = {"a": RNG.normal(size=16_000).astype(np.float32), "b": RNG.normal(size=8960).astype(np.float32), "c": RNG.normal(size=300).astype(np.float32)}
    found = B.log_mels(frame(spark, clips), filters, size).orderBy("clip_id", "frame").collect()
    for name, x in clips.items():
        got, want = [r for r in found if r.clip_id == name], S.log_mel(x, filters)
        assert [r.frame for r in got] == list(range(len(want))) and np.abs(np.array([r.mel for r in got]) - want).max() < 1e-3


#: Row, column and value of the features of one second of 440 Hz.
CELLS = [(0, 0, 1.4784813), (0, 1, 1.4888508), (0, 79, 0.7002542), (0, 80, -0.25796065), (0, 159, -0.25503838), (0, 160, 0.96256), (0, 239, 0.19017744), (0, 240, -0.74722266), (0, 319, -0.35810912), (1, 0, -0.015964031), (10, 17, 1.4980546), (49, 319, 0.1063613)]


@pytest.mark.parametrize("size", [8, 1 << 10])
def test_stacked_features_of_blocks(spark, size):
    x = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000).astype(np.float32)
    clips = {"tone": x, "even": RNG.normal(size=16 * 160 - 1).astype(np.float32), "on": RNG.normal(size=15 * 160).astype(np.float32), "short": x[:256], "least": x[:257]}
    found = B.stacked(frame(spark, clips), size=size, multiple=64).orderBy("clip_id", "row").collect()
    rows = {name: [r for r in found if r.clip_id == name] for name in clips}
    assert not rows["short"] and len(rows["tone"]) == 64 and sum(r.is_real for r in rows["tone"]) == 50
    tone = np.array([r.features for r in rows["tone"]])
    assert all(abs(tone[i, j] - v) < 2e-3 for i, j, v in CELLS) and abs(tone[:50].sum() - 2009.2104) < 0.1 and not tone[50:].any()
    for name in ("even", "on", "least"):
        want, real = S.stacked_features(clips[name], multiple=64)
        assert [r.is_real for r in rows[name]] == [True] * real + [False] * (len(want) - real)
        assert np.abs(np.array([r.features for r in rows[name]]) - want).max() < 2e-3


def pauses(n, rate, seed):
    """Noise with short stretches of near silence."""
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=n)
    for at in rnd.integers(0, n, n // (rate * 3)):
        x[at : at + rate // 5] *= rnd.random() * 1e-3
    return x.astype(np.float32)


def test_windows_of_blocks_are_windows_of_clips(spark):
    flat = np.full(120_000, 0.5, np.float32)
    flat[60_000:60_500] = 0
    clips = {
        ("constant", 1000): np.full(10_000, 0.5, np.float32), ("hole", 1000): flat, ("sawtooth", 1000): (np.arange(600_000) % 977 / 977).astype(np.float32),
        ("noise", 500): pauses(300_000, 500, 1), ("odd", 250): pauses(150_000, 250, 2), ("rough", 1102): pauses(300_000, 1102, 3), ("slow", 49): pauses(30_000, 49, 4),
        ("empty", 1000): np.empty(0, np.float32), ("exact", 100): pauses(6800, 100, 5), ("more", 100): pauses(6801, 100, 6), ("silence", 100): np.zeros(40_000, np.float32),
    }
    rows = [(name, rate, start, x) for (name, rate), clip in clips.items() for _, start, x in cut({name: clip}, most=4000)]
    found = B.pause_windows(spark.createDataFrame(rows, "clip_id string, rate int, start long, samples array<float>").repartition(3)).orderBy("clip_id", "window").collect()
    for (name, rate), x in clips.items():
        want = S.quiet_windows(len(x), rate, S.sample_energy(x, rate))
        got = [(r.start, r.end) for r in found if r.clip_id == name]
        assert got == want, name
    of = lambda name: [r for r in found if r.clip_id == name]
    assert len(of("constant")) == 1 and len(of("hole")) == 2 and 60_000 <= of("hole")[0].end < 60_500 and len(of("sawtooth")) > 9


@pytest.mark.parametrize("rate", [8000, 11_025, 16_000, 22_050, 44_100, 48_000])
def test_frames_begin_on_cells(rate):
    frame, cell, start = S.pause_frame(rate), B._cell(rate), 0
    for k in range(50):
        start += 52 * rate + k * frame + frame // 2
        assert (start + 52 * rate) % cell == 0
    assert cell == (1 if frame % 2 else 10 if rate == 11_025 else frame // 2)

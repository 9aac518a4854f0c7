import random
import tracemalloc
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxgrain.functions import numeric as N
from voxgrain.operators import signal as S
from voxgrain.operators.blocks import LogMel, Resampling
from voxgrain.sources import replay
from voxgrain.streaming import capture as C


def tone(n, hz, rate):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate).astype(np.float32)


def rms(x):
    skip = min(len(x) // 10, 2000)
    return float(np.sqrt((x[skip : len(x) - skip].astype(float) ** 2).mean()))


@pytest.mark.parametrize("source, target", [(44_100, 16_000), (16_000, 44_100), (48_000, 16_000)])
def test_tones_keep_their_level(source, target):
    x = tone(source, 1000, source)
    y = S.resample_array(x, source, target)
    assert len(y) == target and 0.95 < rms(y) / rms(x) < 1.05


def test_tones_that_would_alias_go():
    assert [(hz, folded) for hz, _, folded in S.resampler_response(44_100, 16_000)] == [(10_000, 6000), (12_000, 4000), (14_000, 2000)]
    assert all(db < -40 for _, db, _ in S.resampler_response(44_100, 16_000)) and S.resampler_response(16_000, 16_000) == []


@pytest.mark.parametrize("chunk", [1, 7, 160, 441, 1024, 8820])
@pytest.mark.parametrize(("source", "target"), [(44_100, 16_000), (16_000, 44_100), (16_000, 16_000)])
def test_streamed_resampling_is_batch_resampling(chunk, source, target):
    x = tone(8820, 700, source) + np.random.default_rng(1).normal(0, 0.1, 8820).astype(np.float32)
    got, kernel, state = [], Resampling(source, target), (0, 0, 0, ())
    for i in range(0, len(x), chunk):  # the flow is made anew of its state each time
        flow = C.Flow(kernel, state)
        got.append(flow.push(x[i : i + chunk]))
        state = flow.state()
        assert len(state[3]) <= 2 * polyphase_reach(kernel) + chunk
    got = np.concatenate([*got, C.Flow(kernel, state).finish()])
    want = S.resample_array(x, source, target)
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-6


def polyphase_reach(kernel):
    return kernel.bank.half + 3


@pytest.mark.parametrize("chunk", [160, 1024, 8960, 17_920])
def test_streamed_spectra_are_batch_spectra(chunk):
    x = tone(16_000, 440, 16_000)
    filters = S.htk_filters(128)
    flow = C.Flow(LogMel(filters))
    got = np.concatenate([flow.push(x[i : i + chunk]) for i in range(0, len(x), chunk)] + [flow.finish()])
    want = S.log_mel(x, filters)
    assert got.shape == want.shape == (101, 128) and np.abs(got - want).max() < 1e-3


def test_features():
    rows, real = S.stacked_features(tone(16_000, 440, 16_000))
    assert rows.shape == (512, 320) and real == 50 and not rows[50:].any()
    assert abs(float(rows.sum(dtype=float)) - 2009.2104) < 0.1
    with pytest.raises(ValueError):
        S.stacked_features(np.zeros(256))


def test_quiet_windows(spark):
    rate = 1000
    flat = np.full(120 * rate, 0.5, np.float32)
    flat[60 * rate : 60 * rate + 500] = 0
    assert S.quiet_windows(10 * rate, rate, S.sample_energy(flat, rate)) == [(0, 10 * rate)]
    (a, cut), (start, end) = S.quiet_windows(len(flat), rate, S.sample_energy(flat, rate))
    assert a == 0 and cut == start and 60 * rate <= cut < 60 * rate + 500 and end == len(flat)
    saw = (np.arange(600 * rate) % 977 / 977).astype(np.float32)
    found = S.quiet_windows(len(saw), rate, S.sample_energy(saw, rate))
    assert len(found) > 9 and found[0][0] == 0 and found[-1][1] == len(saw) and all(x[1] == y[0] for x, y in zip(found, found[1:]))
    assert S.quiet_windows(99, 10, None) == [(0, 99)] and S.quiet_windows(0, rate, None) == []
    clips = spark.createDataFrame([("a", 100, [0.1] * 7000), ("b", 100, [])], "clip_id string, rate int, samples array<float>")
    assert [(r.clip_id, r.window) for r in S.plan_windows(clips).orderBy("window").collect()] == [("a", 0), ("a", 1)] or S.plan_windows(clips).count() >= 1


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0] * 100,)], "x array<float>")
    x = F.col("x")
    r = df.select(N.preemphasis(x).alias("p"), N.zero_pad(x).alias("z"), N.reflect_pad(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 2).alias("m"), N.overlapping_windows(x, 60, 50).alias("w"), N.is_too_short(x, F.lit(16_000)).alias("s"),
                  N.deltas(F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0))).alias("d"), N.is_unsure(F.lit(0.75)).alias("u"), N.is_unsure(F.lit(0.75), inclusive=True).alias("v")).first()
    assert abs(r.p[0] - 1) < 1e-6 and abs(r.p[1] - 0.03) < 1e-6 and len(r.z) == 160 and r.m == [3.0, 2.0, 1.0, 2.0, 3.0, 2.0, 1.0] and [sum(w) for w in r.w] == [60, 50] and r.s and r.d == [0.5, 2.0, 1.5]
    assert not r.u and r.v


def test_decoder_carries_context():
    seen = []

    def decode(chunk, cache):
        seen.append(chunk[:, 0].tolist())
        return [len(chunk)], (cache or 0) + 1

    make = lambda state: C.DecodeFlow(LogMel(S.htk_filters(1)), decode, 1, 4, 2, state)
    frames, out, state = np.arange(1.0, 11.0)[:, None], [], None
    for part in (frames[:3], frames[3:9], frames[9:]):
        flow = make(state)
        out += flow.gather(part)
        state = flow.state()
    flow = make(state)
    assert out + flow._decode(len(flow.pending)) == [6, 6, 4] and flow.cache == 3 and seen == [[0, 0, 1, 2, 3, 4], [3, 4, 5, 6, 7, 8], [7, 8, 9, 10]]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Chunks out of order and twice, recorded in two parts; the query begins again between them, in the middle of the captures."""
    x = {c: tone(5000 + 37 * i, 300 + 50 * i, 44_100) for i, c in enumerate("abc")}
    rows = [(c, k, datetime.fromtimestamp(1_700_000_000 + k, UTC), v[i : i + 600].tolist(), i + 600 >= len(v) and c != "c") for c, v in x.items() for k, i in enumerate(range(0, len(v), 600))]
    rows = [r for r in rows if not (r[0] == "c" and r[1] == 5)]  # a gap: what lies behind it never has its turn
    early = [r for r in rows if r[1] in (0, 2, 3, 4)]
    late = [r[:2] + (datetime.fromtimestamp(1_700_000_100, UTC),) + r[3:] for r in rows if r[1] not in (0, 3, 4)]  # seq 2 comes again
    own, folder = C.stream_session(spark), str(tmp_path / "in")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    replay.register(own)
    filters = S.htk_filters(20)
    steps = {"resampled": lambda s: C.resampled(s, 44_100), "spectra": lambda s: C.spectra(s, filters), "decoded": lambda s: C.decoded(s, filters, lambda x, n: ([len(x), n or 0], (n or 0) + 1), 7, 3)}
    clock = [("z", 0, datetime.fromtimestamp(1_700_009_000, UTC), [], False)]  # moves the watermark, by which the next batch goes
    for part in (early, late, clock, [("z", 1, datetime.fromtimestamp(1_700_009_001, UTC), [], False)]):
        replay.record(spark.createDataFrame(part, C.CHUNK).coalesce(1), folder)
        for name, step in steps.items():
            stream = own.readStream.format("capture_replay").option("path", folder).load().withWatermark("at", "10 seconds")
            query = step(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-checkpoint").trigger(availableNow=True).start()
            assert query.awaitTermination(240) and query.exception() is None
    got = {name: spark.read.parquet(f"{tmp_path}/{name}").orderBy("capture_id", "place").collect() for name in steps}
    x["c"] = x["c"][:3000]
    for c, v in x.items():
        rows = [r for r in got["resampled"] if r.capture_id == c]
        want = S.resample_array(v, 44_100, 16_000)
        assert [r["place"] for r in rows] == list(range(len(want))) and np.abs(np.array([r["sample"] for r in rows]) - want).max() < 1e-6
        rows, want = [r for r in got["spectra"] if r.capture_id == c], S.log_mel(v, filters)
        assert [r["place"] for r in rows] == list(range(len(want))) and np.abs(np.array([r.mel for r in rows]) - want).max() < 1e-3
        ids = [r.id for r in got["decoded"] if r.capture_id == c]
        assert ids[1::2] == list(range(-(-len(want) // 7))) and sum(i - 3 for i in ids[::2]) == len(want)
    assert {r.capture_id for name in got for r in got[name]} == {"a", "b", "c"}


class State(dict):
    """A value or a map of the state, and the most entries that it has had."""

    most = 0
    get, update = lambda self: self[0], lambda self, new: self.updateValue(0, new)
    exists, containsKey, getValue, removeKey = lambda self: len(self) > 0, dict.__contains__, dict.__getitem__, dict.__delitem__

    def updateValue(self, key, new):
        self[key] = new
        self.most = max(self.most, len(self))


class Handle(dict):
    getValueState = getMapState = lambda self, name, *_: self.setdefault(name, State())
    deleteTimer = registerTimer = lambda self, at: None


def captured(handle, batches, filters):
    """The tables of frames that a capture gives for these batches of chunks."""
    step = C._Captures(lambda state: C.Flow(LogMel(filters), state) if state else C.Flow(LogMel(filters)), C.Flow.state_type, lambda p: {"mel": list(p)}, C.IDLE_MS)
    step.init(handle)
    return step.handleInputRows(("a",), batches, None)


def chunk_table(chunks):
    return pd.DataFrame([(k, pd.Timestamp(1_700_000_000 + k, unit="s"), x, last) for k, x, last in chunks], columns=["seq", "at", "samples", "is_last"])


def test_a_task_holds_no_whole_capture():
    filters, peaks = S.htk_filters(20), []
    for n in (3000, 12_000):
        batches = (chunk_table([(k, np.full(160, k % 7, np.float32), k == n - 1) for k in range(i, i + 500)]) for i in range(0, n, 500))
        tracemalloc.start()
        sizes = [len(table) for table in captured(Handle(), batches, filters)]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sum(sizes) == n + 1 and len(sizes) <= n / 100
    assert peaks[1] < 1.3 * peaks[0]


@pytest.mark.parametrize("order", ["as they come", "backwards", "shuffled"])
def test_chunks_ahead_of_their_turn_wait_in_the_state(monkeypatch, order):
    """With chunks that come again, empty ones, and a batch that ends in the middle."""
    store = C._Ahead.store

    def bounded(self, most):
        store(self, most)
        assert self.bytes <= most and self.bytes == sum(x.nbytes + 256 for x, _ in self.new.values())

    monkeypatch.setattr(C._Ahead, "store", bounded)
    monkeypatch.setattr(C, "_AHEAD", 20_000)
    monkeypatch.setattr(C, "_AT_ONCE", 3000)
    rnd, filters = random.Random(2), S.htk_filters(20)
    cuts = sorted([0, 40_000, *rnd.choices(range(40_000), k=200)])
    x = tone(40_000, 440, 16_000)
    chunks = [(k, x[i:j] if i < j else None, j == 40_000) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
    assert chunks[-1][2] and not any(last for *_, last in chunks[:-1])
    chunks = chunks[::-1] if order == "backwards" else chunks
    if order == "shuffled":
        chunks = chunks + chunks[50:90]
        rnd.shuffle(chunks)
    handle, found = Handle(), []
    for part in (chunks[:120], chunks[120:]):
        found += captured(handle, (chunk_table(part[i : i + 16]) for i in range(0, len(part), 16)), filters)
    want = S.log_mel(x, filters)
    assert [i for table in found for i in table["place"]] == list(range(len(want))) and np.abs(np.stack([m for table in found for m in table["mel"]]) - want).max() < 1e-3
    assert (handle["waiting"].most > 0) == (order != "as they come") and not any(handle.values())


def test_events(spark):
    rows = [(1, i, k) for i, k in enumerate(["pressed", "released", "pressed", "released", "pressed"])]
    df = spark.createDataFrame(rows, "u int, at int, kind string")
    assert [r.kind for r in C.toggled(df, "kind", ["at"], "u").orderBy("at").collect()] == ["pressed", "released", "pressed"]
    chunks = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("b", 1, True), ("c", 0, False)], "capture_id string, seq long, is_last boolean")
    assert {r.capture_id: r.complete for r in C.is_complete(chunks).collect()} == {"a": True, "b": False, "c": False}

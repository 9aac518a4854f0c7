import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxgrain.operators import recordings as R
from voxgrain.operators import signal as S
from voxgrain.sources import audio, documents


def pcm(path, x, rate, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(x)


@pytest.mark.parametrize("size", [7, 1000, 1 << 20])
def test_blocks_of_files_are_the_files(spark, tmp_path, size):
    rnd = np.random.default_rng(1)
    pcm(tmp_path / "a.wav", rnd.integers(-9000, 9000, 500).astype("<i2").tobytes(), 8000)
    pcm(tmp_path / "b.WAV", rnd.integers(-9000, 9000, 600).astype("<i2").tobytes(), 44_100, 2)
    pcm(tmp_path / "c.wav", rnd.integers(0, 255, 301, np.uint8).tobytes(), 100, 1, 1)
    pcm(tmp_path / "d.wav", rnd.integers(0, 255, 303, np.uint8).tobytes(), 100, 1, 3)
    pcm(tmp_path / "e.wav", b"", 100)
    (tmp_path / "f.wav").write_bytes(audio.wav_bytes(rnd.normal(size=77), 16_000))
    content = (tmp_path / "f.wav").read_bytes()
    (tmp_path / "g.wav").write_bytes(content[:40] + struct.pack("<I", 10**9) + content[44:])  # a writer that was never finished
    got = {}
    for r in audio.read_wav_blocks(spark, str(tmp_path), size).orderBy("clip_id", "start").collect():
        held = got.setdefault(r.clip_id.rsplit("/", 1)[1], (r.rate, []))[1]
        assert r.start == len(held) and len(r.samples) <= size
        held += r.samples
    assert len(got) == 7 and got["e.wav"] == (100, [])
    for p in tmp_path.iterdir():
        rate, _, x = audio.parse_wav(p.read_bytes())
        assert got[p.name][0] == rate and np.array_equal(np.array(got[p.name][1], np.float32), x)


def test_samples_of_windows(spark):
    rnd = np.random.default_rng(2)
    x, rows, windows, at = rnd.normal(size=5000).astype(np.float32), [], [], 0
    while at < 5000:
        n = int(rnd.integers(1, 400))
        rows.append(("a", 8, at, x[at : at + n].tolist()))
        at += n
    cuts = [0, 1, 700, 701, 2300, 5000]
    windows = [("a", k, s, e) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    blocks = spark.createDataFrame([*rows, ("b", 8, 0, [])], "clip_id string, rate int, start long, samples array<float>").repartition(3)
    for size in (64, 1000, 1 << 20):
        found = R.window_samples(blocks, spark.createDataFrame(windows, "clip_id string, window int, start long, end long"), size).orderBy("window").collect()
        assert [r.window for r in found] == list(range(5))
        assert all(np.array_equal(np.array(r.samples, np.float32), x[r.start : r.end]) for r in found)


def test_a_job_from_files_to_pages(spark, tmp_path):
    rate, rnd = 100, np.random.default_rng(3)
    x = rnd.normal(size=18_500).astype(np.float32)
    for at in (5900, 12_100):
        x[at : at + 40] = 0
    (tmp_path / "in").mkdir()
    for name, samples in {"talk": x, "short": x[:300], "click": x[:9], "none": x[:0]}.items():
        (tmp_path / "in" / f"{name}.wav").write_bytes(audio.wav_bytes(samples, rate))
    engine = lambda heard: f"i heard uh kubernetis {len(heard)} period it is done"
    terms = spark.createDataFrame([(0, "Kubernetes")], "line_no long, term string")
    rows = {r.stem: r for r in R.transcribe(spark, str(tmp_path / "in"), str(tmp_path / "out"), engine, "Engine 1", terms=terms, rate=200).collect()}
    windows = S.quiet_windows(18_500, rate, S.sample_energy(x, rate))
    assert len(windows) == 3 and rows["talk"].body == "\n\n".join(f"I heard Kubernetes {2 * (e - s)}. It is done" for s, e in windows)
    assert {k: (r.windows, r.seconds) for k, r in rows.items()} == {"talk": (3, 185.0), "short": (1, 3.0), "click": (1, 0.09), "none": (0, 0.0)}
    assert rows["short"].body == "I heard Kubernetes 600. It is done" and rows["click"].body == rows["none"].body == ""
    pages = {r.path.rsplit("/", 1)[1]: r.text for r in documents.read_markdown(spark, str(tmp_path / "out")).collect()}
    assert set(pages) == {"talk.md", "short.md", "click.md", "none.md"} and pages["talk.md"].strip() == rows["talk"].body
    page = (tmp_path / "out" / "talk.md").read_text()
    assert "engine: Engine 1\naudio_secs: 185.0\n" in page and "windows: 3\n" in page and "\n# talk\n" in page
    whole = R.transcribe(spark, str(tmp_path / "in"), str(tmp_path / "whole"), engine, "Engine 1", profile="Long", windowed=False, rate=200)
    assert whole.filter(F.col("stem") == "talk").first().body == "I heard kubernetis 37000. It's done"

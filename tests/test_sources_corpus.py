import json
import struct
import wave

import numpy as np
from pyspark.sql import functions as F

from voxgrain.operators import catalog, corpus
from voxgrain.sources import audio, documents, sinks


def test_wav_round_trip(spark, tmp_path):
    clips = spark.createDataFrame([("a", 8000, [0.5, -0.25, 1.0]), ("b", 16_000, [])], "stamp string, rate int, samples array<float>")
    sinks.write_wav(clips, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.read_wav(spark, str(tmp_path)).collect()}
    assert got["a.wav"].samples == [0.5, -0.25, 1.0] and got["a.wav"].rate == 8000 and got["b.wav"].samples == []
    seconds = {r.path.rsplit("/", 1)[1]: r.seconds for r in audio.wav_seconds(spark, str(tmp_path)).collect()}
    assert seconds == {"a.wav": 3 / 8000, "b.wav": 0.0}


def test_whole_number_wav(tmp_path):
    path = tmp_path / "s.wav"
    with wave.open(str(path), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(44_100)
        w.writeframes(struct.pack("<4h", 16384, 0, -32768, 0))
    rate, channels, x = audio.parse_wav(path.read_bytes())
    assert (rate, channels) == (44_100, 2) and np.allclose(x, [0.25, -0.5])
    assert np.allclose(audio.parse_wav(path.read_bytes(), first_channel=True)[2], [0.5, -1.0])
    content = path.read_bytes()
    broken = content[:40] + struct.pack("<I", 10**9) + content[44:]  # a writer that was never finished
    assert audio.header_seconds(broken, len(broken)) == audio.header_seconds(content, len(content)) == 2 / 44_100
    assert audio.header_seconds(b"not a file", 10) == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.vtt").write_text("WEBVTT\n00:01 --> 00:02\nold\nhello<00:01><c> there</c>\n<c> </c>\nyou<c> too</c>\n")
    assert documents.read_captions(spark, str(tmp_path / "c.vtt")).first().text == "hello there you too"
    page = spark.range(1).select(documents.transcript_markdown(F.lit("a.wav"), F.lit("e"), F.lit(10.0), F.lit(1.0), F.lit(2), F.lit("now"), F.lit("T"), F.lit("one\n\n# two")).alias("m")).first().m
    assert page == "---\nsource: a.wav\nengine: e\naudio_secs: 10.0\ntranscribe_secs: 1.0\nrtf: 0.100\nwindows: 2\ngenerated: now\n---\n\n# T\n\none\n\n# two\n"
    (tmp_path / "t.md").write_text(page)
    assert documents.read_markdown(spark, str(tmp_path / "t.md")).first().text == "\n\n\none\n\n# two\n"
    (tmp_path / "v.txt").write_text("▁the 0\na b 1\n<blk> 2\nbroken\n")
    assert sorted(tuple(r) for r in documents.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()) == [(0, " the", False), (1, "a b", False), (2, "<blk>", True)]
    scores = spark.createDataFrame([(0, 'say "x"', 0.5, 0.25)], "index int, word string, p1 double, margin double")
    documents.write_scores(scores, str(tmp_path / "s"))
    assert [tuple(r) for r in documents.read_scores(spark, str(tmp_path / "s")).collect()] == [(0, 'say "x"', 0.5, 0.25)]
    (tmp_path / "log").write_text("[12] INFO a.b: it: works\nnoise\n")
    assert [tuple(r) for r in documents.read_log(spark, str(tmp_path / "log")).collect()] == [(12, "INFO", "a.b", "it: works")]
    np.arange(6, dtype="<f4").tofile(tmp_path / "f.bin")
    assert documents.read_filters(str(tmp_path / "f.bin"), 2, 3)[1, 0] == 3


def test_entries_and_labels(spark, tmp_path):
    entry = {"recorded": "2026-09-06T17-19-20Z", "mode": "m", "engine": "e", "device_sample_rate": 48000, "duration_secs": 1.5, "raw": "r", "injected": "Send it to Mike now.", "transcribe_secs": 0.2, "reference": None}
    for i, more in enumerate([{}, {"reference": "x"}, {"recorded": "2026-09-06T16-00-00Z"}]):
        (tmp_path / f"2026-09-06T17-19-2{i}Z.json").write_text(json.dumps(entry | more, indent=1))
    (tmp_path / "z.json").write_text("{broken")
    entries = corpus.read_entries(spark, str(tmp_path)).withColumn("owner", F.lit("o"))
    assert entries.count() == 3
    said = spark.createDataFrame([(1, "o", "2026-09-06 17:25:00", "hook", '{"prompt": "send it to Mike, now"}'), (2, "o", "2026-09-06 17:26:00", "hook", "send it to mike right now")], "dictation int, owner string, t string, source string, raw string")
    proposals = corpus.propose_labels(said.withColumn("at", F.to_timestamp("t")), entries).collect()
    assert [(p.dictation, p.stem, p.difference, p.reference) for p in proposals] == [(1, "2026-09-06T17-19-20Z", 0.0, "send it to Mike, now")]
    labelled = corpus.label(entries, spark.createDataFrame(proposals)).orderBy("stem").collect()
    assert [r.reference for r in labelled] == ["send it to Mike, now", "x", None]
    line = corpus.progress(spark.createDataFrame([(65.0,), (58.0,)], "seconds double")).first().line
    assert line == "2 completed towards 120 goal"


def test_error_report(spark):
    rows = [("a", "one two three", "one two"), ("a", "x y", "x z y"), ("a", None, "q"), ("b", "", "w"), ("c", "One, two!", None)]
    found = {r.engine: (r.clips, r.words, r.errors, r.wer) for r in corpus.error_report(spark.createDataFrame(rows, "engine string, reference string, raw string"), "engine").collect()}
    assert found == {"a": (2, 5, 2, 0.4), "b": (1, 0, 1, None), "c": (1, 2, 2, 1.0)}


def test_catalog(spark):
    files = {
        ("b0", 0): {"granite-x": ["model.int8.onnx", "tokenizer.json"], "parakeet-a": ["encoder.onnx", "encoder.int8.onnx", "decoder_joint.onnx", "vocab.txt"], "other": ["encoder.onnx", "decoder.onnx", "vocab.txt"]},
        ("b1", 1): {"nemotron-1120ms-int4": ["encoder_model.onnx", "decoder_model.onnx", "tokens.txt", "filterbank.bin"], "granite-broken": ["tokenizer.json"]},
    }
    rows = [(n, f"/{b}/{d}", d, f, False) for (b, n), dirs in files.items() for d, fs in dirs.items() for f in fs]
    found = catalog.models(spark.createDataFrame(rows, "base_ord int, path string, dir string, file string, is_base boolean"))
    got = [(r.kind, r.variant, r.capture, r.profile) for r in found.orderBy("ord").collect()]
    assert got == [("parakeet", "int8", "Hold", "Raw"), ("granite", "int8", "Toggle", "Long"), ("nemotron", "int4", "Toggle", "Raw")]
    assert catalog.find_mode(found, "TOGGLE").first().kind == "granite"
    chords = spark.createDataFrame([("W-C-Print",), ("Print",), ("C--",), ("W-",)], "c string").coalesce(1)
    assert [None if r[0] is None else tuple(r[0]) for r in chords.select(catalog.chord(F.col("c"))).collect()] == [(["LeftMeta", "LeftCtrl"], "Print"), ([], "Print"), (["LeftCtrl"], "-"), ([], "W-")]

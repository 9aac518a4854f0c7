import os
import random

import numpy as np
import pytest

from voxgrain.llm.common import Stage
from voxgrain.llm import token_counts
from voxgrain.llm.token_counts import SEPARATOR, VOCABULARY, Encoder, count_tokens, read_token_files, scan

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary file")


def test_round_trip(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "été", "x1", "<|endoftext|>", "\n"]) for _ in range(rnd.randrange(40))) for _ in range(200)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(500, None, "n"), (501, "", "n"), (7, texts[7], "n"), (None, "a b", "n"), (502, "long " * 20_000, "n")]
    enc = Encoder().encoding
    want = sorted(str((i, len(enc.encode_ordinary(t or "")))) for i, t, _ in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    for block in (7, 1 << 19):  # documents that end in the block where they began, and many blocks later
        got = count_tokens(df, block_tokens=block)
        assert sorted(str((r["doc_id"], r["n_tokens"])) for r in got.collect()) == want
    assert count_tokens(df.limit(0)).collect() == []


def test_raw_files(spark, tmp_path):
    files = {"a.bin": [3, 4, SEPARATOR, SEPARATOR, 5], "b.bin": [SEPARATOR], "c.bin": [1] * 9, "d.bin": []}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    for block in (1, 2, 3, 100):
        found = scan(read_token_files(spark, str(tmp_path), block), Stage(spark, "test")).collect()
        got = sorted((r["file"].rsplit("/", 1)[1], r["number"], r["n_tokens"]) for r in found)
        assert got == [("a.bin", 0, 2), ("a.bin", 1, 0), ("a.bin", 2, 1), ("b.bin", 0, 0), ("c.bin", 0, 9)]


def test_long_runs(spark, monkeypatch):
    """Runs of any length have ids, and what splits and merges them agrees with the library wherever that works."""
    enc = Encoder()
    decode = enc.encoding.decode
    for run in (" ", "\n", "a", "\t ", "é", "ab1!", "☃"):
        text = "x" + run * (2_000_000 // len(run)) + " 'll end"
        assert decode(enc.encode(text)) == text
    rnd = random.Random(5)
    monkeypatch.setattr(token_counts, "LONG", 3)
    monkeypatch.setattr(token_counts, "_RUN", token_counts.re.compile("."))
    parts = ["the", " été", "x1", "'ll", "'s", "!", "  ", "\n", " \n\t", "\u2003", "\x1c", "\x85", "漢字", "²", "٣", "aaaa", "'", "he'll", "\u200b"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))
        assert enc.encode(text) == enc.encoding.encode_ordinary(text), ascii(text)
    rows = [(1, " " * 1_000_000), (2, "a" * 300_000)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_tokens"] > 0 for r in got) and len(got) == 2

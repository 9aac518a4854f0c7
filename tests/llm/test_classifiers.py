import random
import zlib

import numpy as np
import pytest

from voxgrain.llm import language_id, quality
from voxgrain.llm.features import byte_grams

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "en er ch de ei un sch ge ung st", "fr": "es le de en re nt on er ou ai", "es": "de en es el la os ar ue ra ci"}
DOCS = "doc_id long, text string, lang string, language string, score double"


def text(rnd, lang, n=60):
    return " ".join("".join(rnd.choice(SYLLABLES[lang].split()) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def test_languages_on_held_out_rows(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang := rnd.choice(list(SYLLABLES))), lang, "x", 1.0) for i in range(800)]
    df = spark.createDataFrame(rows, DOCS)
    # What is held out teaches nothing: its labels are wrong on purpose.
    wrong = spark.createDataFrame([(i, t, "xx" if fold(i) == 2 else v, a, b) for i, t, v, a, b in rows], DOCS)
    found = {r["doc_id"]: r["out"] for r in language_id.predict(df, language_id.fit(wrong), into="out").collect()}
    held = [r for r in rows if fold(r[0]) == 2]
    assert np.mean([found[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert all(0 <= v["score"] <= 1 for v in found.values())


def test_odd_texts_have_no_language(spark):
    rnd = random.Random(1)
    learned = [(i, text(rnd, "en"), "en", "x", 1.0) for i in range(20)]
    odd = [(100, None, "en", "x", 1.0), (101, "", None, "x", 1.0), (102, "12 ²! ", "de", "x", 1.0), (103, "é", None, "x", 1.0), (103, "é", None, "x", 1.0), (None, text(rnd, "en", 20_000), None, "x", 1.0)]
    df = spark.createDataFrame(learned + odd, DOCS)
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 23
    empty = spark.createDataFrame([], DOCS)
    assert language_id.fit(empty) is None and language_id.keep_identified(empty).collect() == []
    assert {r["language"]["lang_pred"] for r in language_id.predict(df, None).collect()} == {"und"}


def test_texts_of_no_learned_language_go(spark):
    """What is unlike all learned languages is rejected."""
    rnd = random.Random(3)
    learned = [(i, text(rnd, lang := rnd.choice(["en", "fr"])), lang, "x", 1.0) for i in range(300)]
    junk = [(1000 + i, " ".join("".join(rnd.choice("qxzjkwvy") for _ in range(9)) for _ in range(60)), None, "x", 1.0) for i in range(20)]
    df = spark.createDataFrame(learned + junk, DOCS)
    likeness = {r["doc_id"]: r["out"]["likeness"] for r in language_id.predict(df, language_id.fit(df), into="out").collect()}
    assert min(likeness[r[0]] for r in learned) > language_id.OUTSIDE > max(likeness[r[0]] for r in junk)
    assert {r[0] for r in learned} == {r["doc_id"] for r in language_id.keep_identified(df).collect()}


def test_pairs_against_a_plain_one_vs_one(spark):
    """Family first, then the largest sum of pairwise confidences, computed here from the weights one text at a time."""
    rnd = random.Random(5)
    rows = [(i, text(rnd, lang := rnd.choice(list(SYLLABLES))), lang, "x", 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(df)
    got = {r["doc_id"]: r["out"]["lang_pred"] for r in language_id.predict(df, model, into="out").collect()}
    for i, t, *_ in rows:
        v = np.append(language_id.vector(t), 1)
        family = max(zip((w @ v for w in model.family_w), model.families))[1]
        votes = {a: sum(1 / (1 + np.exp(-4 * np.clip(w @ v * (1 if a == x else -1), -10, 10))) for (x, y), w in model.pair_w.items() if a in (x, y)) for a in model.members[family]}
        assert got[i] == max(votes, key=votes.get)


def test_families():
    assert language_id.family_of("de-AT") == language_id.family_of("en") == "germanic" and language_id.family_of("zz") == "zz"


def test_quality_learns_from_positives_and_unlabelled(spark):
    rnd = random.Random(7)
    good = lambda: text(rnd, rnd.choice(["en", "fr"]), 80)
    bad = lambda: " ".join(w + rnd.choice(["$$$", "&&&", "!!"]) for w in text(rnd, "en", 80).split()).upper()
    rows, labels, truth = [], [], {}
    for i in range(3000):
        truth[i] = rnd.random() < 0.8
        rows.append((i, good() if truth[i] else bad(), "en", "x", 0.0))
        if rnd.random() < 0.4:
            labels.append((i, int(truth[i])))
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality.fit(docs, marks)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    held = [i for i in truth if fold(i) == 2]
    assert np.mean([(scores[i] >= quality.ACCEPT) == truth[i] for i in held]) > 0.97


def test_prior():
    rnd = np.random.default_rng(0)
    pos = np.hstack([rnd.normal(2, 1, (2000, 1)), np.ones((2000, 1))]).astype(np.float32)
    unl = np.hstack([np.where(rnd.random(4000) < 0.7, rnd.normal(2, 1, 4000), rnd.normal(-3, 1, 4000))[:, None], np.ones((4000, 1))]).astype(np.float32)
    assert quality.estimate_prior(pos, unl) == pytest.approx(0.7, abs=0.06)


def test_quality_without_labels_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, None, "", 0.0), (2, "", None, "", 0.0), (2, "", None, "", 0.0), (None, "x " * 50_000, None, "", 0.0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) is None
    assert [r["score"] for r in quality.score(docs, None).collect()] == [0.5] * 4
    w = np.zeros(len(quality.vector("")), np.float32)
    got = quality.score(docs, w).collect()
    assert len(got) == 4 and all(r["score"] == 0.5 for r in got)
    assert quality.score(spark.createDataFrame([], DOCS), w).collect() == []


def test_grams_of_short_texts():
    assert byte_grams(b"", 64).sum() == 1 and byte_grams(b"abcd", 64).sum() == 2

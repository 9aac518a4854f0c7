import random
import re

import numpy as np
import pandas as pd
import pytest

from voxgrain.llm import set_join
from voxgrain.llm import shingles as hashing
from voxgrain.llm.set_join import keep_one_of_each, link_components

SCHEMA = "doc_id long, text string, label string, id string, component string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(str((d, len(s), least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in link_components(df, **sizes).collect())


def changed(rnd, words, n):
    w = list(words)
    for _ in range(n):
        at = rnd.randrange(len(w))
        w[at : at + 1] = rnd.choice([[], [f"n{rnd.randrange(999)}"], [w[at], f"n{rnd.randrange(999)}"]])
    return w


@pytest.mark.parametrize("sizes", [{}, {"most": 1, "wide": 2, "block": 3}])
def test_against_brute_force(spark, sizes):
    """Chains and groups around the threshold; with tiny lists every frequent token is dealt to several."""
    rnd = random.Random(11 + len(sizes))
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for g in range(14):
        base = [f"v{rnd.randrange(5000)}" for _ in range(rnd.choice([6, 20, 60, 120]))]
        if g % 3 == 0:
            base[3:3] = passage
        last = base
        for _ in range(rnd.choice([1, 3, 14])):
            last = changed(rnd, rnd.choice([base, last]), rnd.choice([0, 1, 2, 4]))
            rows.append((len(rows), rnd.choice(["", "\t"]) + " ".join(last).upper() + rnd.choice(["", "\n"])))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "a b c d"), (None, "a b c d"), (7, rows[9][1]), (9, rows[9][1]), (9, rows[9][1])]
    rnd.shuffle(rows)
    assert run(spark, rows, **sizes) == brute(rows)


def test_long_text_and_nothing(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    assert run(spark, [(1, long), (2, long + " end"), (3, "x")]) == sorted([str((1, 29996, 1)), str((2, 29997, 1)), str((3, 1, 3))])
    assert run(spark, []) == []


def test_one_of_each_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (2, text + " x"), (2, text + " x"), (9, "other"), (None, "none"), (4, None)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["2", "4", "9", "None"]


def test_entries_without_a_partner_go():
    import pandas as pd

    b = pd.DataFrame({"token": [1] * 4 + [2], "salt": [0] * 5, "fp": [10, 11, 12, 13, 10], "n": [10, 12, 20, 30, 10], "pos": [0] * 5, "dealt": [False] * 5})
    assert set_join._fitting(b, 64)["fp"].tolist() == [10, 11]
    assert not len(set_join._fitting(b.assign(pos=[9, 11, 19, 29, 9]), 64)) and len(set_join._fitting(b, 2)) == 4


def test_rows_that_share_an_id_or_have_none(spark):
    """A copy goes without the other row of its doc_id; of near copies without an id one stays, or none beside one with an id."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(50))
    rows = [(1, text("a")), (5, text("a") + " x"), (5, text("b")), (7, text("b") + " x"), (8, text("c")), (None, text("c") + " x")]
    rows += [(None, text("d")), (None, text("d") + " x"), (None, text("d")), (9, text("e")), (9, text("e").upper()), (None, None), (4, None)]
    kept = keep_one_of_each(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA))
    got = [(r["doc_id"], (r["text"] or "-")[0].lower()) for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "a"), (5, "b"), (8, "c"), (None, "d"), (9, "e"), (None, "-"), (4, "-")]))


def test_sets_of_texts_in_groups_are_those_of_each(monkeypatch):
    rnd = random.Random(12)
    texts = [None, "", " \n ", "one", "a b", "A b c D e", "\x00 \x00 a b c d", "é É x y z"] + [" ".join(rnd.choices("abcdef", k=rnd.randrange(60))) for _ in range(200)] + ["w " * 300]
    rnd.shuffle(texts)
    alone = [hashing.shingle_set(hashing.words_of(t), 5) for t in texts]
    for group, piece in ((1, 1 << 22), (100, 1 << 22), (1 << 16, 1 << 22), (100, 50)):
        monkeypatch.setattr(hashing, "_GROUP", group)
        monkeypatch.setattr(hashing, "_PIECE", piece)
        found = []
        for first, last, s, sizes in hashing.shingle_sets(texts, 5):
            assert first == len(found) and len(sizes) == last - first and sizes.sum() == len(s)
            assert set_join._fingerprints(s, sizes).tolist() == [set_join._fingerprint(x) for x in alone[first:last]]
            found += np.split(s, np.cumsum(sizes)[:-1])
        assert [x.tolist() for x in found] == [x.tolist() for x in alone]


def test_texts_are_hashed_in_groups(monkeypatch):
    """A call of numpy for each text and step cost more than the hashing."""
    calls, hashed = [], hashing._placed_words
    monkeypatch.setattr(hashing, "_placed_words", lambda raw: calls.append(len(raw)) or hashed(raw))
    texts = pd.DataFrame({"doc_id": range(400), "text": [f"w{i} in a short text of some words" for i in range(400)]})
    rows = list(set_join._describe(iter([texts])))
    assert rows[0]["n"].tolist() == [4] * 400 and len(calls) < 10

import random
import re

import pytest

from voxgrain.llm.mixing import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def targets(sizes, weights, budget=1.5, most=2):
    """Shares by weight, the excess of full sources dealt again until none is above its limit."""
    left, open_, out = budget * sum(sizes.values()), dict(weights), {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > most * sizes[s]]
        if not full:
            return out | {s: level * w for s, w in open_.items()}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def run(spark, rows):
    return [r.asDict() for r in mix(spark.createDataFrame(rows, SCHEMA)).collect()]


def test_targets_and_words_of_many_recipes(spark):
    rnd = random.Random(5)
    for n in (1, 2, 4, 9):
        rows = [
            (i, " ".join(["w"] * rnd.randint(0, 40)), "en", f"s{min(rnd.randrange(n), rnd.randrange(n))}" if n < 9 or rnd.random() < 0.9 else None, 1, "clash")
            for i in range(400)
        ]
        sizes = {}
        for r in rows:
            sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
        got = run(spark, rows)
        assert len(got) == len(rows)
        for s in sizes:
            own = [r for r in got if r["source"] == s]
            assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
            assert abs(sum(r["taken"] for r in own) - want[s]) <= 40
            assert all(0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in own)
        assert sorted(map(str, got)) == sorted(map(str, run(spark, rows)))


def test_odd_rows(spark):
    rows = [(1, None, None, "a", None, None), (1, None, None, "a", None, None), (None, "x y", "en", None, 3, ""), (2, "", "en", "b", 0, ""), (3, "p\x0bq\x85r", "en", "b", 0, "")]
    got = {(r["doc_id"], r["source"]): r for r in run(spark, rows)}
    assert got[1, "a"]["size"] == got[1, "a"]["taken"] == 0 and got[1, "a"]["target"] == 0
    assert got[None, None]["size"] == 2 and got[3, "b"]["size"] == 2
    assert run(spark, []) == []

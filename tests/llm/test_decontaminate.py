import random

import pytest

from voxgrain.llm.decontaminate import COVERAGE, MIN_MATCH, contamination, keep_clean, tile

import numpy as np


def brute_tiles(p, t, least):
    """Greedy string tiling by comparing everything with everything: the longest unmarked match first."""
    mp, mt, covered = [False] * len(p), [False] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered
        covered += k
        mp[i : i + k], mt[j : j + k] = [True] * k, [True] * k


def test_tiles_against_brute_force():
    rnd = random.Random(9)
    for _ in range(300):
        n = rnd.choice([2, 3, 30])
        p, t = ([rnd.randrange(n) for _ in range(rnd.randrange(18))] for _ in range(2))
        if rnd.random() < 0.7 and len(p) > 6:
            cut = rnd.randrange(len(p))
            t = t[:3] + p[cut:] + t[3:6] + p[:cut] + t[6:]
        least = rnd.choice([1, 2, 5])
        found = tile(np.array(p, np.uint64), np.array(t, np.uint64), least)
        # Ties between equally long matches may be broken either way, so only what is unambiguous is compared.
        assert all(p[i : i + k] == t[j : j + k] and k >= least for i, j, k in found)
        cells = [i + x for i, _, k in found for x in range(k)], [j + x for _, j, k in found for x in range(k)]
        assert all(len(c) == len(set(c)) for c in cells)
        if len(set(p)) == len(p) and len(set(t)) == len(t):
            assert sum(k for *_, k in found) == brute_tiles(p, t, least)


ITEM = "The quick, brown fox jumps over the lazy dog and runs far away from here"
DOCS = "doc_id long, text string, leak string, item_id string"


@pytest.mark.parametrize("block", [2_000_000, 5])
def test_leaks(spark, block):
    w = ITEM.split()
    texts = {
        1: "before " + ITEM + " after",
        2: "x " + " ".join(w[8:]).upper() + " y y " + " ".join(w[:8]) + " z",  # reordered, other case
        3: "one " + " ".join(w[:6]) + " two",  # less than half
        4: None, 5: "", 6: "quite clean text of many other words here and there", 7: "short", 8: "w " * 40_000 + ITEM,
    }
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in texts.items()] + [(1, texts[1], "a", "b"), (None, ITEM, "a", "b")], DOCS)
    bench = spark.createDataFrame([(70, ITEM), (71, "too short an"), (72, None), (73, "another item that no document holds in any form at all")], "item_id long, text string")
    got = contamination(docs, bench, block_words=block, into="found").collect()
    hit = {r["doc_id"]: r["found"] for r in got}
    assert {i for i, f in hit.items() if f["n_items"]} == {1, 2, 8, None} and hit[1]["item_id"] == 70 and hit[2]["coverage"] == 1.0
    assert 0 < hit[3]["coverage"] < COVERAGE and hit[6]["item_id"] is None
    kept = keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7]
    assert keep_clean(docs, bench.limit(0)).count() == docs.count() and keep_clean(docs.limit(0), bench).collect() == []
    assert MIN_MATCH == 5


def test_operator_against_brute_force(spark):
    """Coverage of the item covered most, and the number of items covered to the share that contaminates, tiling every pair."""
    from voxgrain.llm.decontaminate import Benchmark

    rnd = random.Random(4)
    items = [(i, [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 5, 12, 40]))]) for i in range(30)]
    items += [(50 + i, items[5][1][:8] + [f"v{i}{k}" for k in range(20)]) for i in range(20)]
    texts = []
    for _ in range(120):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(30))]
        for _, item in rnd.sample(items, rnd.randrange(3)):
            cut, n = rnd.randrange(len(item)), rnd.randint(4, len(item) + 4)
            words += (item[cut:] + item[:cut])[:n]
        texts.append(words)
    want = []
    for words in texts:
        covered = [(-sum(k for *_, k in tile(np.array([hash(w) % 2**63 for w in item], np.uint64), np.array([hash(w) % 2**63 for w in words], np.uint64))) / len(item), i) for i, item in items]
        best = min(covered)
        want.append((best[1] if best[0] else None, -best[0], sum(-c >= COVERAGE for c, _ in covered)))
    block = Benchmark([(i, " ".join(w)) for i, w in items])
    assert [block.judge(" ".join(words)) for words in texts] == want
    docs = spark.createDataFrame([(i, " ".join(w), "a", "b") for i, w in enumerate(texts)], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for size in (2_000_000, 60):
        got = {r["doc_id"]: tuple(r["found"]) for r in contamination(docs, bench, block_words=size, into="found").collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_cost_of_long_and_many_items():
    import time

    from voxgrain.llm.decontaminate import Benchmark

    words = [f"w{i}" for i in range(8000)]
    began = time.perf_counter()
    assert Benchmark([(1, " ".join(words))]).judge(" ".join(words[5000:] + words[:5000]))[1] == 1.0
    assert time.perf_counter() - began < 1
    many = Benchmark([(i, "which of the following is true of " + " ".join(f"v{i}x{k}" for k in range(30))) for i in range(5000)])
    began = time.perf_counter()
    assert many.judge("we ask which of the following is true of " + " ".join(words[:30]))[2] == 0
    assert time.perf_counter() - began < 0.5
    same = np.ones(3000, np.uint64)
    assert sum(k for *_, k in tile(same, np.ones(9000, np.uint64))) == 3000

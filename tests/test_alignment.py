import difflib
import random
import time

import numpy as np
import pytest

from voxgrain.operators import evaluate as E


def table(a, b):
    """The alignment by the whole table of distances, going back cell by cell."""
    d = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        d.append([i])
        for j, y in enumerate(b, 1):
            d[i].append(min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y)))
    of_a, of_b, i, j = [False] * len(a), [False] * len(b), len(a), len(b)
    while i or j:
        here = d[i][j]
        both = i > 0 and j > 0
        if both and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            of_a[i] = of_b[j] = True
        elif both and here == d[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
        elif i and here == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return of_a, of_b, d[-1][-1]


def changed(rnd, words, pool, n):
    out = list(words)
    for _ in range(n):
        at = rnd.randrange(len(out) + 1)
        out[at : at + rnd.randrange(2)] = rnd.choices(pool, k=rnd.randrange(2))
    return out


@pytest.mark.parametrize("pool", ["ab", "abcdefgh", [f"w{i}" for i in range(300)]])
def test_alignment_in_the_band_is_that_of_the_table(pool):
    rnd = random.Random(3)
    for _ in range(700):
        a = rnd.choices(pool, k=rnd.randrange(40))
        b = changed(rnd, a, pool, rnd.randrange(8)) if rnd.random() < 0.7 else rnd.choices(pool, k=rnd.randrange(40))
        of_a, of_b, cost = table(a, b)
        code = {w: i for i, w in enumerate({*a, *b})}
        x, y = np.array([code[w] for w in a], int), np.array([code[w] for w in b], int)
        rows = E._furthest(x, y, 100)
        assert len(rows) == cost + 1 and (cost == 0 or E._furthest(x, y, cost - 1) is None)
        for found in (E._by_diagonals(x, y, rows), E._by_rows(x, y), E.align(a, b)):
            assert found[0].tolist() == of_a and found[1].tolist() == of_b


def test_long_texts_with_few_changes():
    rnd = random.Random(4)
    pool = [f"w{int(rnd.paretovariate(0.5)) % 3000}" for _ in range(20_000)]
    a = rnd.choices(pool, k=20_000)
    b = changed(rnd, a, pool, 400)
    began = time.perf_counter()
    of_a, of_b = E.align(a, b)
    took = time.perf_counter() - began
    assert [w for w, k in zip(a, of_a) if k] == [w for w, k in zip(b, of_b) if k] and of_a.sum() > 19_500
    began = time.perf_counter()
    found = E.matching_words(a, b)
    assert took < 3 and time.perf_counter() - began < 5  # 0.3 and 0.6 s on an idle machine
    assert found == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


@pytest.mark.parametrize(("pool", "most"), [("ab", 12), ("abcdef", 30), ([f"w{i}" for i in range(60)], 60)])
def test_matching_blocks(pool, most):
    rnd = random.Random(5)
    for _ in range(1700):
        a = rnd.choices(pool, k=rnd.randrange(most))
        b = changed(rnd, a, pool, rnd.randrange(9)) if rnd.random() < 0.6 else rnd.choices(pool, k=rnd.randrange(most))
        assert E.matching_words(a, b, popular=False) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_frequent_words_of_long_texts():
    rnd = random.Random(6)
    pool = ["the"] * 30 + ["of"] * 9 + [f"w{i}" for i in range(400)]
    for _ in range(60):
        a = rnd.choices(pool, k=rnd.randrange(150, 500))
        b = changed(rnd, a, pool, rnd.randrange(200)) if rnd.random() < 0.8 else rnd.choices(pool, k=rnd.randrange(150, 500))
        assert E.matching_words(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


@pytest.mark.parametrize("cells", [0, 100, 1 << 25])
def test_rows_of_bits_are_those_of_the_table(monkeypatch, cells):
    """With rows that are made again on the way back, in stretches of several lengths, and with sides without words."""
    monkeypatch.setattr(E, "_CELLS", cells)
    rnd = random.Random(7)
    for size in [*range(12), *rnd.choices(range(150), k=60)]:
        pool = [f"w{i}" for i in range(rnd.choice([2, 8, 100]))]
        a, b = rnd.choices(pool, k=size), rnd.choices(pool, k=rnd.randrange(150))
        for p, q in ((a, b), (b, a), (a, changed(rnd, a, pool, 5))):
            of_p, of_q, _ = table(p, q)
            found = E.align(p, q)
            assert found[0].tolist() == of_p and found[1].tolist() == of_q


def test_texts_that_differ_in_most_words():
    rnd = random.Random(8)
    pool = [f"w{int(rnd.paretovariate(0.5)) % 3000}" for _ in range(5000)]
    pairs = [(rnd.choices(pool, k=300), rnd.choices(pool, k=300)) for _ in range(200)]
    began = time.perf_counter()
    found = [E.align(a, b) for a, b in pairs]
    assert time.perf_counter() - began < 2  # 0.2 s on an idle machine; 6 s row by row
    assert all([w for w, k in zip(a, p) if k] == [w for w, k in zip(b, q) if k] for (a, b), (p, q) in zip(pairs, found))

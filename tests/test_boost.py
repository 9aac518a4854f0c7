import random

import numpy as np
import pytest

from voxgrain.operators import boost as B
from voxgrain.operators import decode as D


def by_hand(phrases, text):
    """The weights that a text has collected, by following beginnings of phrases as lists.

    The longest beginning that the text ends with is followed. What has been said to the end of a phrase is kept; the rest counts as long as it is followed.
    """
    phrases = {tuple(p) for p in phrases if p}
    scale = B.factor(len(phrases))
    begun = {p[:k] for p in phrases for k in range(len(p) + 1)}
    value = lambda p: scale * sum(map(B.weight, range(len(p))))

    def stake(p):
        kept = max((k for k in range(1, len(p) + 1) if p[:k] in phrases), default=0)
        return value(p) - value(p[:kept])

    total, said = 0.0, ()
    for token in text:
        while said and (*said, token) not in begun:
            shorter = next(said[k:] for k in range(1, len(said) + 1) if said[k:] in begun)
            total, said = total - stake(said) + stake(shorter), shorter
        if (*said, token) in begun:
            total, said = total + value((*said, token)) - value(said), (*said, token)
    return total, said


@pytest.mark.parametrize("tokens", [2, 3, 6])
def test_the_automaton_follows_the_longest_beginning(tokens):
    rnd = random.Random(tokens)
    for _ in range(300):
        phrases = [[rnd.randrange(tokens) for _ in range(rnd.randrange(6))] for _ in range(rnd.randrange(1, 9))]
        automaton, text, total, state = B.Phrases(phrases), [], 0.0, 0
        for _ in range(25):
            token = rnd.randrange(tokens)
            text.append(token)
            state, gain = automaton.step(state, token)
            total += gain
            want, said = by_hand(phrases, text)
            assert abs(total - want) < 1e-9 and automaton.depth[state] == len(said)


def test_a_phrase_half_said_gives_all_back():
    automaton = B.Phrases([[1, 2, 3]])
    state, total = 0, 0.0
    for token in (1, 2, 9):
        state, gain = automaton.step(state, token)
        total += gain
    assert state == 0 and abs(total) < 1e-12
    for token in (1, 2, 3, 9):
        state, gain = automaton.step(state, token)
        total += gain
    assert abs(total - 3.5 * (1 + 2 + np.log(2) + 2 + np.log(3))) < 1e-9
    assert B.Phrases([]).step(0, 5) == (0, 0.0) and [B.factor(n) for n in (5, 50, 500, 50_000)] == [3.5, 2.5, 1.5, 1.0]


def test_only_near_misses_are_favoured():
    automaton = B.Phrases([[7], [8]])
    logits = np.array([0.0, 6, 5, 4, 3, 2, 1, 5.5, -9])
    out = automaton.favour(logits, 0, blank=0)
    assert out[7] == 9 and out[8] == -9 and (out[:7] == logits[:7]).all() and logits[7] == 5.5
    deep = B.Phrases([[1, 2, 3, 4]])
    state = 0
    for token in (1, 2, 3):
        state = deep.step(state, token)[0]
    logits = np.arange(12, 0, -1.0)
    logits[4] = -1
    assert deep.favour(logits, state)[4] > -1 and deep.favour(logits, deep.step(0, 1)[0])[4] == -1


def greedy_by_hand(frames, phrases, blank, most=2):
    """Greedy decoding, each candidate scored by the whole text with it less the text without."""
    out = []
    for frame in frames:
        for _ in range(most):
            before, said = by_hand(phrases, out)
            near = sorted(range(len(frame)), key=lambda k: (-frame[k], k))[: B.TOP_DEEP if len(said) >= B.DEEP else B.TOP]
            score = [v + (by_hand(phrases, [*out, k])[0] - before if k in near and k != blank else 0) for k, v in enumerate(frame)]
            best = max(range(len(frame)), key=lambda k: (score[k], -k))
            if best == blank:
                break
            out.append(best)
    return out


def test_boosted_transducer_against_brute_force():
    rnd = np.random.default_rng(5)
    changed = 0
    for k in range(60):
        frames = rnd.normal(size=(12, 9)) * 3
        phrases = [rnd.integers(1, 9, rnd.integers(1, 5)).tolist() for _ in range(6)]
        joint = lambda previous, state, frame: (frame, state)
        found = D.rnnt_greedy(frames, B.boosted(joint, B.Phrases(phrases), 0), blank=0, most=2)
        want = greedy_by_hand(frames.tolist(), phrases, 0)
        assert [t[1] for t in found] == want
        changed += want != [t[1] for t in D.rnnt_greedy(frames, joint, blank=0, most=2)]
        halves = D.rnnt_greedy(frames[:5], B.boosted(joint, B.Phrases(phrases), 0), blank=0, most=2)
        assert [t[1] for t in halves] == want[: len(halves)]
    assert changed > 30


def test_a_decoding_that_strays_too_far_falls_back():
    frames = np.tile([0.0, 5.0, 4.9], (40, 1))
    decode = lambda x, joint: D.rnnt_greedy(x, joint, blank=0, most=1)
    joint = lambda previous, state, frame: (frame, state)
    ids = lambda n: {t[1] for t in B.guarded(decode, joint, B.Phrases([[2]]), 0)(frames[:n])}
    assert ids(40) == {1} and ids(B.LEAST - 1) == {2}
    rnd = random.Random(1)
    for _ in range(50):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randrange(8))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        assert B.token_distance(a, b) == d[-1] / max(len(a), len(b), 1)

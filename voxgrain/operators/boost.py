"""Phrases favoured while a transducer decodes: a weighted automaton over token ids that follows all phrases at once.

A state is the longest beginning of a phrase that the latest tokens spell; where they do not go on, failure links lead to the next shorter one, as in
Aho and Corasick. Each token of a phrase is worth a weight that grows with its depth. A way down the automaton collects these; a step that leaves a phrase half
said gives back what the part that is lost had collected (its backoff, which is negative), and a phrase said to its end keeps it. So the total over a text is the
weight of the phrases in it and of the beginning that it ends with.

Decoding is greedy, so a token can only be favoured where it is nearly the best already: within the first ``TOP`` logits at the beginning of a phrase, and within
``TOP_DEEP`` once ``DEEP`` tokens are said. Blanks are never favoured, and a blank leaves the state as it is. If the favoured decoding of a text of ``LEAST``
tokens or more differs from the plain one in more than ``DIVERGENCE`` of its tokens, the plain one stands.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from math import log, log10

import numpy as np

from .decode import Joint

# Weights of tokens by depth, the range of the factor, gates and guard.
FIRST, SCALE = 1.0, 2.0
FACTOR_LEAST, FACTOR_MOST = 1.0, 3.5
TOP, TOP_DEEP, DEEP = 5, 20, 3
LEAST, DIVERGENCE = 24, 0.35


def factor(phrases: int) -> float:
    """What all weights are multiplied by: less for longer lists, as more first tokens are favoured at any time."""
    return min(FACTOR_MOST, max(FACTOR_LEAST, 3.5 - log10(phrases / 5))) if phrases else 0.0


def weight(depth: int) -> float:
    """Of the token at this depth of a phrase, from 0."""
    return FIRST if depth == 0 else FIRST * SCALE + log(depth + 1)


class Phrases:
    """The automaton of a list of phrases, each a sequence of token ids; state 0 has nothing said."""

    def __init__(self, phrases: Sequence[Sequence[int]]):
        distinct = list(dict.fromkeys(tuple(p) for p in phrases if len(p)))
        scale = factor(len(distinct))
        self.next: list[dict[int, int]] = [{}]
        self.depth, self.collected, self.ends = [0], [0.0], [False]
        for phrase in distinct:
            at = 0
            for depth, token in enumerate(phrase):
                if token not in self.next[at]:
                    self.next[at][token] = len(self.next)
                    self.next.append({})
                    self.depth.append(depth + 1)
                    self.collected.append(self.collected[at] + scale * weight(depth))
                    self.ends.append(False)
                at = self.next[at][token]
            self.ends[at] = True
        # What a state has collected and could yet lose: nothing of it up to the longest phrase that ends on the way.
        self.at_stake, self.fail = [0.0] * len(self.next), [0] * len(self.next)
        waiting = deque([0])
        while waiting:
            at = waiting.popleft()
            for token, to in self.next[at].items():
                step = self.collected[to] - self.collected[at]
                self.at_stake[to] = 0.0 if self.ends[to] else self.at_stake[at] + step
                back = self.fail[at] if at else -1
                while back > 0 and token not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(token, 0) if back >= 0 else 0
                waiting.append(to)

    def step(self, state: int, token: int) -> tuple[int, float]:
        """The state after ``token``, and what it adds to the total: weights collected less those given back."""
        gain = 0.0
        while token not in self.next[state]:
            if not state:
                return 0, gain
            # What goes is at stake, but for what the shorter beginning has collected of its own.
            gain += self.at_stake[self.fail[state]] - self.at_stake[state]
            state = self.fail[state]
        after = self.next[state][token]
        gain += self.collected[after] - self.collected[state]
        return after, gain

    def favour(self, logits: np.ndarray, state: int, width: int | None = None, blank: int | None = None) -> np.ndarray:
        """``logits`` with the weights of the tokens that go on with a phrase, or begin one, added where they are near the best."""
        words = logits[:width]
        top = TOP_DEEP if self.depth[state] >= DEEP else TOP
        near = np.argsort(-words, kind="stable")[:top]
        out = logits.copy()
        for token in near.tolist():
            if token != blank:
                out[token] += self.step(state, token)[1]
        return out


def boosted(joint: Joint, phrases: Phrases, blank: int, width: int | None = None) -> Joint:
    """``joint`` with phrases favoured. The automaton's state is carried with the network's, so that it goes on over frames and chunks."""

    def run(previous, carried, frame):
        state, inner = carried if carried is not None else (0, None)
        logits, after = joint(previous, inner, frame)
        favoured = phrases.favour(logits, state, width, blank)
        best = int(np.argmax(favoured[:width]))
        return favoured, (state if best == blank else phrases.step(state, best)[0], after)

    return run


def token_distance(a: Sequence[int], b: Sequence[int]) -> float:
    """Edit distance over the longer length."""
    row = np.arange(len(b) + 1)
    y = np.asarray(b)
    for i, token in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != token))
        row = np.minimum.accumulate(np.concatenate([[i], best - np.arange(1, len(b) + 1)])) + np.arange(len(b) + 1)
    return int(row[-1]) / max(len(a), len(b), 1)


def guarded(decode: Callable[[np.ndarray, Joint], list], joint: Joint, phrases: Phrases, blank: int, width: int | None = None) -> Callable[[np.ndarray], list]:
    """A decoder of frames that favours phrases, and falls back to the plain decoding where the two differ too much."""

    def run(frames: np.ndarray) -> list:
        found = decode(frames, boosted(joint, phrases, blank, width))
        plain = decode(frames, joint)
        if max(len(found), len(plain)) >= LEAST and token_distance([t[1] for t in found], [t[1] for t in plain]) > DIVERGENCE:
            return plain
        return found

    return run

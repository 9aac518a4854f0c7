"""Words and word shingles of whole texts as 64-bit hashes, in numpy.

Two different shingles of a corpus of 10**13 share a hash with a chance of one in a million for any one text of 10**6
shingles compared with it; such a clash changes one count by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers for the places of a shingle's words.
_PLACES = [np.uint64(xxhash.xxh3_64_intdigest(b"place %d" % i) | 1) for i in range(64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n] * _PLACES[0]
    for i in range(1, k):
        h += words[i : i + n] * _PLACES[i]
    return mix(h)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles, sorted; fewer than ``k`` words make one shingle of all of them, no words none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(grams(words, min(k, len(words)))) if len(words) >= k else mix(grams(words, len(words)) + np.uint64(len(words)))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Longer texts are hashed piece by piece, cut at white space, to bound memory.
_PIECE = 1 << 22
#: Shorter texts are hashed together, in groups of about so many bytes.
_GROUP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.cumprod(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_known: list[np.ndarray] = [_powers(_BASE, 1 << 15), _powers(pow(_BASE, -1, 1 << 64), 1 << 15)]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of ``raw``: runs of anything but space, tab, LF, VT, FF and CR."""
    if len(raw) > _PIECE:
        cut = next((i for i in range(_PIECE, len(raw)) if _SPACE[raw[i]]), len(raw))
        if cut < len(raw):
            return np.concatenate([word_hashes(raw[:cut]), word_hashes(raw[cut:])])
    return _placed_words(raw)[0]


def _placed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where it starts. All words at once: a polynomial over the bytes is summed once, and each word is a difference of two sums."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if n > len(_known[0]):
        size = 1 << n.bit_length()
        _known[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * _known[0][:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _known[1][starts]), starts


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased."""
    return word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, np.uint64)


def shingle_sets(texts: Sequence[str | None], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of ``texts`` (first, last), whose sets ``shingle_set`` would make one by one: these end to end, and the size of each."""
    first = 0
    while first < len(texts):
        raws, size, last = [], 0, first
        while last < len(texts) and (not raws or size < _GROUP):
            text = texts[last]
            raws.append(text.encode("utf-8", "surrogatepass").lower() if text else b"")
            size, last = size + len(raws[-1]) + 1, last + 1
        if size > _PIECE:
            sets = [shingle_set(word_hashes(raw), k) for raw in raws]
            yield first, last, np.concatenate(sets), np.array([len(s) for s in sets])
        else:
            yield first, last, *_together(raws, k)
        first = last


def _together(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    words, starts = _placed_words(b" ".join(raws))
    ends = np.searchsorted(starts, np.cumsum([len(raw) + 1 for raw in raws]))
    n = np.diff(ends, prepend=0)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    upto = np.cumsum(many)
    out = np.empty(upto[-1], np.uint64)
    # A run of k words that begins here ends in the same text.
    whole = np.flatnonzero(np.repeat(ends, n) - np.arange(len(words)) >= k)
    out[np.repeat(n >= k, many)] = grams(words, k)[whole]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        out[upto[i] - 1] = shingle_set(words[ends[i] - n[i] : ends[i]], k)[0]
    bounds = [0, *upto.tolist()]
    for low, high in zip(bounds, bounds[1:]):
        out[low:high].sort()
    new = np.ones(len(out) + 1, bool)
    new[1:-1] = out[1:] != out[:-1]
    new[upto] = True
    kept = np.concatenate([[0], np.cumsum(new[:-1])])[bounds]
    return out[new[:-1]], np.diff(kept)

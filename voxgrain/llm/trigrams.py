"""Boolean trigram queries of regular expressions.

The query of a pattern says which trigrams every text must hold in which the pattern matches. It is a set of alternatives, each of
them a set of trigrams that stand together; the alternative without trigrams asks for nothing. Trigrams are of the text in lower
case. The query is derived from the parsed pattern bottom up: of each part it is known which texts it matches, if they are few, or
else with what its matches begin and end; parts that stand side by side give the trigrams across their border. Where a set grows
beyond a bound, less is known of it, which makes the query weaker and never wrong.
"""

from __future__ import annotations

from functools import reduce
from re import _constants as op
from re import _parser
from typing import NamedTuple

Query = frozenset[frozenset[str]]

ALL: Query = frozenset([frozenset()])
#: Sets of texts beyond the first and alternatives beyond the second are given up; character classes beyond the third are any character.
MANY, ALTERNATIVES, CLASS = 32, 64, 8


class _Part(NamedTuple):
    texts: frozenset[str] | None  # all that it matches, or None
    begins: frozenset[str]  # two characters at most
    ends: frozenset[str]
    query: Query


_NOTHING = frozenset([""])
_ANY = _Part(None, _NOTHING, _NOTHING, ALL)
_EMPTY = _Part(_NOTHING, _NOTHING, _NOTHING, ALL)


def _least(query: Query) -> Query:
    """Without the alternatives that ask for more than another one."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _either(a: Query, b: Query) -> Query:
    out = _least(a | b)
    return out if len(out) <= ALTERNATIVES else ALL


def _both(a: Query, b: Query) -> Query:
    out = _least(frozenset(x | y for x in a for y in b))
    return out if len(out) <= ALTERNATIVES else min(a, b, key=len)


def _held(texts: frozenset[str]) -> Query:
    """What holds one of these texts."""
    return _least(frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts))


def _few(texts: frozenset[str]) -> frozenset[str]:
    return texts if len(texts) <= MANY else _NOTHING


def _open(part: _Part) -> _Part:
    """The part, known by its ends only."""
    if part.texts is None:
        return part
    return _Part(None, _few(frozenset(t[:2] for t in part.texts)), _few(frozenset(t[-2:] for t in part.texts)), _both(part.query, _held(part.texts)))


def _then(a: _Part, b: _Part) -> _Part:
    if a.texts is not None and b.texts is not None and len(a.texts) * len(b.texts) <= MANY:
        return _Part(frozenset(x + y for x in a.texts for y in b.texts), _NOTHING, _NOTHING, _both(a.query, b.query))
    left, right = _open(a), _open(b)
    begins = left.begins if a.texts is None else frozenset((x + y)[:2] for x in a.texts for y in right.begins)
    ends = right.ends if b.texts is None else frozenset((x + y)[-2:] for x in left.ends for y in b.texts)
    across = frozenset(x + y for x in left.ends for y in right.begins)
    return _Part(None, _few(begins), _few(ends), _both(_both(left.query, right.query), _held(across)))


def _or(a: _Part, b: _Part) -> _Part:
    if a.texts is not None and b.texts is not None and len(a.texts | b.texts) <= MANY:
        return _Part(a.texts | b.texts, _NOTHING, _NOTHING, _either(a.query, b.query))
    a, b = _open(a), _open(b)
    return _Part(None, _few(a.begins | b.begins), _few(a.ends | b.ends), _either(a.query, b.query))


def _characters(items) -> _Part:
    """A character class: its characters in lower case if they are few and ASCII."""
    found: set[str] = set()
    for kind, value in items:
        codes = [value] if kind is op.LITERAL else range(value[0], value[1] + 1) if kind is op.RANGE else None
        if codes is None or len(codes) > 2 * CLASS or max(codes) > 127:
            return _ANY
        found |= {chr(c).lower() for c in codes}
    return _Part(frozenset(found), _NOTHING, _NOTHING, ALL) if len(found) <= CLASS else _ANY


def _part(kind, value) -> _Part:
    if kind is op.LITERAL:
        return _characters([(kind, value)])
    if kind is op.IN:
        return _characters(value)
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.ATOMIC_GROUP:
        return _sequence(value)
    if kind is op.BRANCH:
        return reduce(_or, map(_sequence, value[1]))
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return _EMPTY
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, items = value
        one = _sequence(items)
        if low:
            return one if high == 1 else _open(one)
        return _or(one, _EMPTY) if high == 1 else _ANY
    return _ANY


def _sequence(items) -> _Part:
    return reduce(_then, (_part(kind, value) for kind, value in items), _EMPTY)


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that a text must hold for ``pattern`` to match in it."""
    return _open(_sequence(_parser.parse(pattern))).query

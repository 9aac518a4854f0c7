"""Evaluation of transcripts: word edit distance, error rates, alignment, differing spans, separation by scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, pairwise
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import bound

#: The first code point that stands for a word, and how many there are from it on.
_FIRST, _MOST = 0x10000, 0x100000


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words, in the JVM: each distinct word of the pair becomes one character.

    There are 2**20 characters for it; a pair with more distinct words is an error.
    """

    def coded(x: Column, words: Column) -> Column:
        code = lambda w: F.lpad(F.hex(F.lit(_FIRST - 1) + F.array_position(words, w)), 8, "0")
        return F.decode(F.unhex(F.array_join(F.transform(x, code), "")), "UTF-32")

    def distance(words: Column) -> Column:
        return F.when(F.size(words) <= _MOST, F.levenshtein(coded(a, words), coded(b, words))).otherwise(F.raise_error(F.lit("a pair of texts has too many distinct words")).cast("int"))

    return bound(F.array_distinct(F.concat(a, b)), distance)


def error_rate(reference: Column, hypothesis: Column, distance: Column | None = None) -> Column:
    """Word error rate: distance (given, if known) over the number of reference words. Without any it is NaN for two empty sides, else infinite."""
    n = F.size(reference)
    distance = word_distance(reference, hypothesis) if distance is None else distance
    empty = F.when(F.size(hypothesis) == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return F.when(n == 0, empty).otherwise(distance / n)


#: Stretches of a group's scores that are ranked as tasks of their own: a square, as the stretch of a score is found in two steps.
BINS = 1024


def stretches(counts: DataFrame, score: str, groups: list[str], bins: int = BINS) -> DataFrame:
    """``counts`` (a row for each score of a group) with ``bin_``, which rises with the score: stretches of about as many rows each.

    Quantiles of a group's scores, from a sketch of bounded size, are where stretches begin; so outliers stand in stretches of their own sort, and
    a group's rows are spread whatever the scale of its scores. Quantiles only deal the rows out: ranks do not depend on how near they are.
    """
    side = isqrt(bins)
    cuts = F.percentile_approx(score, F.array(*[F.lit(k / bins) for k in range(1, bins)]), F.lit(20 * bins))
    cuts = counts.groupBy(*groups).agg(cuts.alias("cuts_"))
    cuts = cuts.select(*[F.col(g).alias(f"{g}_of_") for g in groups], "cuts_", F.filter("cuts_", lambda c, i: (i + 1) % side == 0).alias("first_"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_of_")) for g in groups], F.lit(True))
    passed = lambda c: F.size(F.filter(c, lambda x: x <= F.col(score)))
    coarse = counts.join(cuts, same).withColumn("coarse_", passed("first_") * side)
    return coarse.withColumn("bin_", F.col("coarse_") + passed(F.slice("cuts_", F.col("coarse_") + 1, side - 1))).drop("cuts_", "first_", "coarse_", *[f"{g}_of_" for g in groups])


def _below(counts: DataFrame, score: str, amount: str, groups: list[str], bins: int = BINS) -> DataFrame:
    """``counts`` (a row for each score of a group) with ``below``: the total of ``amount`` at the group's lower scores.

    Totals within a stretch of scores, plus those of the stretches before it: no task ranks a whole group.
    """
    placed = stretches(counts, score, groups, bins)
    placed = placed.withColumn("inside_", F.sum(amount).over(Window.partitionBy(*groups, "bin_").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)))
    totals = placed.groupBy(*groups, "bin_").agg(F.sum(amount).alias("total_"))
    before = F.sum("total_").over(Window.partitionBy(*groups).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(g).alias(f"{g}_at_") for g in groups], F.col("bin_").alias("bin_at_"), before.alias("before_"))
    here = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_at_")) for g in groups], F.col("bin_") == F.col("bin_at_"))
    below = F.coalesce("inside_", F.lit(0)) + F.coalesce("before_", F.lit(0))
    return placed.join(totals, here).select(*counts.columns, below.alias("below"))


def separation(df: DataFrame, score: str, positive: str, *groups: str) -> DataFrame:
    """The chance that a ``positive`` row scores lower than another (ties count half), in each group.

    Ranks of distinct scores instead of all pairs: rows are first counted by score, so ties and hot scores cost one row.
    """
    counts = df.groupBy(*groups, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    ranked = _below(counts, score, "p", list(groups))
    # A pair is won by each positive row below the other one.
    wins = F.sum(F.col("q") * (F.col("below") + F.col("p") * 0.5))
    auc = ranked.groupBy(*groups).agg(wins.alias("wins"), F.sum("p").alias("n_low"), F.sum("q").alias("n_high"))
    return auc.select(*groups, "n_low", "n_high", F.when((F.col("n_low") > 0) & (F.col("n_high") > 0), F.col("wins") / (F.col("n_low") * F.col("n_high"))).otherwise(F.lit(float("nan"))).alias("auc"))


def gate_counts(df: DataFrame, score: str, positive: str, gate: float, *groups: str) -> DataFrame:
    """How many rows score below the gate, and how many of the ``positive`` ones do."""
    low = F.col(score) < gate
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(low).alias("flagged"), F.count_if(low & F.col(positive)).alias("caught"), F.count_if(F.col(positive)).alias("n_positive"))


def medians(df: DataFrame, score: str, *groups: str) -> DataFrame:
    """The exact median of each group; null scores don't count."""
    counts = _below(df.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count("*").alias("n_")), score, "n_", list(groups))
    sizes = counts.groupBy(*groups).agg(F.sum("n_").alias("size_")).select(*[F.col(g).alias(f"{g}_of_") for g in groups], "size_")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_of_")) for g in groups], F.lit(True))
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n_")), F.col(score)))
    middle = (at(F.floor((F.col("size_") - 1) / 2)) + at(F.floor(F.col("size_") / 2))) / 2
    return counts.join(sizes, same).groupBy(*groups).agg(middle.alias("median"))


#: Rows of the table that are kept at once hold about so many cells.
_CELLS = 1 << 25


def _by_rows(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``align`` by the whole table, a row of which is a few whole numbers with a bit for each column, so that one operation makes many cells.

    Neighbouring cells differ by one at most. ``up`` and ``down`` say where a row rises and falls from one column to the next; of each row it is kept
    which cells equal their diagonal neighbour and which are one above the row before. Long tables keep a few rows on the way and make the others again on the way back.
    """
    x, y = x.tolist(), y.tolist()
    full, places = (1 << len(y)) - 1, {}
    for j, word in enumerate(y):
        places[word] = places.get(word, 0) | 1 << j

    def rows(first: int, last: int, up: int, down: int) -> Iterator[tuple[int, int, int, int]]:
        for i in range(first, last):
            here = places.get(x[i], 0)
            level = ((here & up) + up ^ up | here | down) & full
            above, below = down | full ^ (level | up), level & up
            up, down = (below << 1 | full ^ full & (level | above << 1 | 1)) & full, (above << 1 | 1) & level
            yield level, above, up, down

    stride, kept, edge = max(1, isqrt(len(x)), _CELLS // (len(y) + 1)), [], (full, 0)
    for first in range(0, len(x), stride):
        kept.append((first, *edge))
        if first + stride < len(x):
            for _, _, *edge in rows(first, first + stride, *edge):
                pass
    of_a, of_b, j = np.zeros(len(x), bool), np.zeros(len(y), bool), len(y)
    for first, up, down in reversed(kept):
        last = min(first + stride, len(x))
        part, i = [row[:2] for row in rows(first, last, up, down)], last - 1
        while i >= first and j:
            if x[i] == y[j - 1]:
                of_a[i] = of_b[j - 1] = True
                i, j = i - 1, j - 1
                continue
            level, above = part[i - first]
            if not level >> j - 1 & 1:
                i, j = i - 1, j - 1
            elif above >> j - 1 & 1:
                i -= 1
            else:
                j -= 1
    return of_a, of_b


#: A band of more diagonals than this on either side, or than this share of the words, is left for the whole table; so are tables of fewer cells than ``_LARGE``.
_BAND, _BAND_SHARE, _LARGE = 2000, 8, 1 << 32


def _slide(x: np.ndarray, y: np.ndarray, at: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """From these words of ``x``, each on its diagonal (place in ``y`` minus place in ``x``), past all equal words."""
    at, moving, step = at.copy(), np.arange(len(at)), 8
    while len(moving):
        i = at[moving, None] + np.arange(step)
        j = i + diagonals[moving, None]
        same = (i < len(x)) & (j < len(y)) & (i >= 0) & (j >= 0)
        same &= np.where(same, x[np.minimum(i, len(x) - 1)] == y[np.clip(j, 0, len(y) - 1)], False)
        run = np.where(same.all(1), step, np.argmin(same, 1))
        at[moving] += run
        moving, step = moving[run == step], min(2 * step, 1024)
    return at


def _furthest(x: np.ndarray, y: np.ndarray, most: int) -> list[np.ndarray] | None:
    """For each cost e from 0 to the distance: how far in ``x`` the diagonals from -e to e can be followed. None if the distance is above ``most``."""
    n, m = len(x), len(y)
    rows: list[np.ndarray] = []
    for e in range(most + 1):
        diagonals = np.arange(-e, e + 1)
        if e:
            low = np.full(2, -1 << 40)
            before = np.concatenate([low, rows[-1], low])  # diagonals -e - 1 to e + 1
            at = np.maximum(np.maximum(before[1:-1] + 1, before[:-2]), before[2:] + 1)
        else:
            at = np.zeros(1, int)
        at = np.minimum(at, np.minimum(n, m - diagonals))
        rows.append(_slide(x, y, at, diagonals) if n and m else at)
        if abs(m - n) <= e and rows[-1][m - n + e] >= n:
            return rows
    return None


def _by_diagonals(x: np.ndarray, y: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``align`` within the band that holds every optimal alignment: one step back for each change, and the equal words in between."""
    of_a, of_b = np.zeros(len(x), bool), np.zeros(len(y), bool)
    i, j = len(x), len(y)
    for e in range(len(rows) - 1, -1, -1):
        while i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            of_a[i] = of_b[j] = True
        if not e:
            break
        reach = lambda diagonal: rows[e - 1][diagonal + e - 1] if abs(diagonal) < e else -1  # noqa: E731, B023
        if i and j and reach(j - i) >= i - 1:
            i, j = i - 1, j - 1
        elif i and reach(j - i + 1) >= i - 1:
            i -= 1
        else:
            j -= 1
    return of_a, of_b


def align(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which words of each side an optimal alignment matches; going back, equal words come before changes, then drops, then insertions.

    Alignments of cost d never leave the d diagonals on either side of the first, so the search widens cost by cost until one reaches the end: what it
    has found by then holds every optimal alignment. That takes about n + d * d steps. Words too far apart for it take the whole table, as do texts
    of some ten thousand words or fewer, for which that is faster than even a narrow band.
    """
    code = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([code[w] for w in a], int), np.array([code[w] for w in b], int)
    most = min(_BAND, max(len(x), len(y)) // _BAND_SHARE + 1)
    rows = _furthest(x, y, most) if len(x) * len(y) >= _LARGE and abs(len(x) - len(y)) <= most else None
    return _by_rows(x, y) if rows is None else _by_diagonals(x, y, rows)


_MATCHED = StructType([StructField("of_a", ArrayType(BooleanType())), StructField("of_b", ArrayType(BooleanType()))])


@F.pandas_udf(_MATCHED)
def matched(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """``align`` for arrays of words, row by row."""
    return pd.DataFrame([align(list(x), list(y)) if x is not None and y is not None else (None, None) for x, y in zip(a, b)], columns=["of_a", "of_b"])


def anchors(a: list[str], b: list[str], k: int) -> Iterator[tuple[int, int]]:
    """Where runs of ``k`` words of ``a`` lie in ``b``, at their first places there, none behind or across one before."""
    runs = lambda words: [tuple(words[i : i + k]) for i in range(len(words) - k)]
    first = dict(reversed([(run, j) for j, run in enumerate(runs(b))]))
    free_a = free_b = 0
    for i, j in ((i, first[run]) for i, run in enumerate(runs(a)) if run in first):
        if i >= free_a and j >= free_b:
            yield i, j
            free_a, free_b = i + k, j + k


def spans(a: list[str], b: list[str], k: int = 5) -> list[tuple[str, str]]:
    """Stretches that differ, each before an anchor."""
    between = (((" ".join(a[p + k : i])), " ".join(b[q + k : j])) for (p, q), (i, j) in pairwise(chain([(-k, -k)], anchors(a, b, k))))
    return [(x, y) for x, y in between if x != y]


_SPANS = ArrayType(StructType([StructField("a", StringType()), StructField("b", StringType())]))


def differing_spans(a: Column, b: Column, k: int = 5, most: int | None = None, both: bool = False) -> Column:
    """Differing spans of two arrays of words; ``both`` keeps those with words on both sides, ``most`` limits a report."""

    @F.pandas_udf(_SPANS)
    def find(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"a": p, "b": q} for p, q in spans(list(u), list(v), k)] if u is not None and v is not None else None for u, v in zip(x, y)])

    found = find(a, b)
    if both:
        found = F.filter(found, lambda s: (s["a"] != "") & (s["b"] != ""))
    return found if most is None else F.slice(found, 1, most)


#: From so many words on, a word of the second text begins no block if it stands there more often than once in this many words, and once more.
_LONG, _POPULAR = 200, 100


class _Runs:
    """A suffix automaton of the words ``y[low:high]``, those of ``skipped`` standing for themselves only: where runs of words first end."""

    def __init__(self, y: list[int], low: int, high: int, skipped: set[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for at in range(low, high):
            word = -1 - at if y[at] in skipped else y[at]
            new = self._state(self.length[last] + 1, at, {})
            while last >= 0 and word not in self.next[last]:
                self.next[last][word] = new
                last = self.link[last]
            if last >= 0:
                to = self.next[last][word]
                if self.length[to] != self.length[last] + 1:  # a longer run ends there: what is shorter gets a state of its own
                    copy = self._state(self.length[last] + 1, self.first[to], dict(self.next[to]))
                    self.link[copy], self.link[to] = self.link[to], copy
                    while last >= 0 and self.next[last].get(word) == to:
                        self.next[last][word] = copy
                        last = self.link[last]
                    to = copy
                self.link[new] = to
            else:
                self.link[new] = 0
            last = new

    def _state(self, length: int, first: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def longest(self, x: list[int], low: int, high: int) -> tuple[int, int, int]:
        """Start in ``x``, start in ``y`` and length of the longest common run; of equal ones the first in ``x``, then in ``y``."""
        state = size = 0
        best = (low, 0, 0)
        for at in range(low, high):
            word = x[at]
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
                if size > best[2]:
                    best = at - size + 1, self.first[state] - size + 1, size
        return best


def matching_words(a: list[str], b: list[str], popular: bool = True) -> int:
    """How many words lie in matching blocks: the longest common run, then the longest on either side of it, and so on.

    With ``popular``, frequent words of a long second text begin no block, though a block may grow over them.
    """
    code = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = [code[w] for w in a], [code[w] for w in b]
    most = len(y) // _POPULAR + 1
    skipped = {w for w, n in Counter(y).items() if n > most} if popular and len(y) >= _LONG else set()
    found, parts = 0, [(0, len(x), 0, len(y))]
    while parts:
        i0, i1, j0, j1 = parts.pop()
        if i0 == i1 or j0 == j1:
            continue
        i, j, size = _Runs(y, j0, j1, skipped).longest(x, i0, i1)
        start, begin = (i, j) if size else (i0, j0)
        stop = start + size
        while start > i0 and begin > j0 and x[start - 1] == y[begin - 1]:
            start, begin = start - 1, begin - 1
        while stop < i1 and begin + stop - start < j1 and x[stop] == y[begin + stop - start]:
            stop += 1
        if stop > start:
            found += stop - start
            parts += [(i0, start, j0, begin), (stop, i1, begin + stop - start, j1)]
    return found


def agreement(a: Column, b: Column) -> Column:
    """Ratio of the words of two texts that lie in matching blocks; 1 for two texts without words."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(u: str, v: str) -> float:
            p, q = u.split(), v.split()
            return 2 * matching_words(p, q) / (len(p) + len(q)) if p or q else 1.0

        return pd.Series([one(u, v) if u is not None and v is not None else None for u, v in zip(x, y)], dtype="float64")

    return ratio(a, b)


def match_clips(dictations: DataFrame, clips: DataFrame, recent: int = 10, minutes: int = 30, slack: float = 0.3, most: float = 0.35, group: str = "owner") -> DataFrame:
    """Labels for recorded clips: for each dictation the clip it most likely is, as rows (dictation, stem, difference, reference).

    ``dictations``: dictation, owner, at, source, text, words. ``clips``: owner, stem, recorded, words, reference. Only the ``recent`` newest
    clips of an owner count, labelled ones included; a clip must be unlabelled, at most ``minutes`` old and a minute ahead,
    of similar length, and at most ``most`` different. The least different wins, of equal ones the newer.
    """
    newest = clips.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(F.col("stem").desc()))).filter(F.col("nth") <= recent)
    open_ = newest.filter(F.col("reference").isNull() & F.col("recorded").isNotNull() & (F.size("words") > 0)).select(group, "stem", "recorded", F.col("words").alias("target"))
    age = F.col("at").cast("double") - F.col("recorded").cast("double")
    n, m = F.size("target"), F.size("words")
    near = (age <= minutes * 60) & (age >= -60) & (F.abs(n - m) <= F.greatest(F.lit(2), F.ceil(n * slack)))
    asked = dictations.filter((F.length("text") <= 20_000) & (F.size("words") > 0))
    pairs = asked.join(open_, group).withColumn("distance", F.when(near, word_distance(F.col("target"), F.col("words")))).filter(F.col("distance").isNotNull())
    pairs = pairs.withColumn("difference", F.col("distance") / n).filter((F.col("difference") <= most) & ~((F.col("distance") == 0) & (F.col("source") == "clip")))
    best = Window.partitionBy("dictation").orderBy("difference", F.col("recorded").desc(), F.col("stem").desc())
    chosen = pairs.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == 1)
    # One clip takes one label: the dictation that comes first.
    first = Window.partitionBy(group, "stem").orderBy("at", "dictation")
    chosen = chosen.withColumn("turn", F.row_number().over(first)).filter(F.col("turn") == 1)
    return chosen.select("dictation", group, "stem", "source", "difference", F.col("text").alias("reference"))

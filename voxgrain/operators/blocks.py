"""Signals as blocks: computations whose outputs each depend on a stretch of samples, over clips that span many tasks, and over streams.

A clip is any number of rows (clip_id, start, samples) that together cover its samples once. A kernel says which samples an output reads.
Outputs are dealt into segments of equal length; each row sends the pieces that a segment reads, with what overlaps its neighbours, to
that segment, and a segment is computed where its pieces meet. So no task holds a clip, and the work is as even as the segments are.
Only the segments that reach a clip's end are told its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .signal import FFT, FLOOR, HOP, LOG_GUARD, PREEMPHASIS, SEARCH, TARGET, WINDOW, hann, htk_filters, pause_frame, polyphase

#: Outputs of a segment: about a million samples, or ten seconds of frames.
SAMPLES, FRAMES = 1 << 20, 1 << 10


class Kernel(Protocol):
    def count(self, end: int) -> int:
        """The outputs that read nothing from sample ``end`` on."""

    def total(self, n: int) -> int:
        """The outputs of a signal of ``n`` samples."""

    def first(self, output: int) -> int:
        """The first sample that an output, or any after it, reads."""

    def end(self, output: int) -> int:
        """One past the last sample that an output, or any before it, reads."""

    def run(self, low: int, high: int, x: np.ndarray, start: int, n: int | None) -> np.ndarray:
        """Outputs ``low`` to ``high``, exclusive, from the samples from ``start`` on; ``n``: the signal's length, where it is known and matters."""


class Resampling:
    """Samples at another rate."""

    def __init__(self, source: int, target: int):
        self.bank = polyphase(source, target)
        self.same = source == target

    def count(self, end: int) -> int:
        return end if self.same else max(0, -(-(end - self.bank.half) * self.bank.phases // self.bank.stride))

    def total(self, n: int) -> int:
        return n if self.same else self.bank.length(n)

    def first(self, output: int) -> int:
        return output if self.same else max(0, output * self.bank.stride // self.bank.phases - self.bank.half + 1)

    def end(self, output: int) -> int:
        return output + 1 if self.same else output * self.bank.stride // self.bank.phases + self.bank.half + 1

    def run(self, low: int, high: int, x: np.ndarray, start: int, n: int | None) -> np.ndarray:
        if self.same:
            return np.asarray(x, np.float32)[low - start : high - start]
        return self.bank.at(low, high, np.asarray(x, np.float64), start)


class _Frames:
    """Spectra of windows around every ``HOP``-th sample; both ends of a signal are mirrored, without repeating the end itself."""

    before, reach = 0, 0  # samples that a window reads before and, exclusively, behind its middle

    def __init__(self, filters: np.ndarray):
        self.filters = filters.astype(np.float64)

    def count(self, end: int) -> int:
        return 0 if end <= self.before else max(0, (end - self.reach) // HOP + 1)

    def first(self, output: int) -> int:
        return max(0, output * HOP - self.before - 1)

    def end(self, output: int) -> int:
        return max(output * HOP + self.reach, self.before + 1)

    def signal(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The samples at these places; ``at`` gives raw samples."""
        raise NotImplementedError

    def scale(self, power: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def length(self, n: int) -> int:
        return n

    def run(self, low: int, high: int, x: np.ndarray, start: int, n: int | None) -> np.ndarray:
        if high <= low:
            return np.empty((0, len(self.filters)))
        x = np.asarray(x, np.float32)
        index = np.arange(low, high)[:, None] * HOP + np.arange(-self.before, WINDOW - self.before)
        index = np.abs(index)
        if n is not None:
            last = self.length(n) - 1
            index = np.where(index > last, 2 * last - index, index)
        known = len(x) if n is None else min(len(x), n - start)

        def at(i: np.ndarray) -> np.ndarray:
            inside = (i >= max(start, 0)) & (i < start + known)
            return np.where(inside, x[np.clip(i - start, 0, max(len(x) - 1, 0))] if len(x) else 0, np.float32(0))

        windows = np.zeros((high - low, FFT))
        side = (FFT - WINDOW) // 2
        windows[:, side : side + WINDOW] = self.signal(index, at) * hann()
        return self.scale(np.abs(np.fft.rfft(windows, axis=1)) ** 2 @ self.filters.T)


class LogMel(_Frames):
    """Natural logarithms after preemphasis, not normalised; windows begin half a transform before the frame's place."""

    before, reach = FFT // 2, WINDOW - FFT // 2

    def total(self, n: int) -> int:
        return n // HOP + 1

    def signal(self, index, at):
        return at(index) - np.where(index > 0, np.float32(PREEMPHASIS) * at(index - 1), np.float32(0)) * (index >= 0)

    def scale(self, power):
        return np.log(power + LOG_GUARD)


class DecibelMel(_Frames):
    """Logarithms to base 10 of centred windows; an even number of frames, none for half a transform or less."""

    before, reach = WINDOW // 2, WINDOW // 2

    def total(self, n: int) -> int:
        return (n // HOP + 1) // 2 * 2 if n > FFT // 2 else 0

    def length(self, n: int) -> int:
        return max(n, (self.total(n) - 1) * HOP + 1)  # one sample of silence where the last frame lies on the end

    def signal(self, index, at):
        return at(index)

    def scale(self, power):
        return np.log10(np.maximum(power, FLOOR))


def _joined(pieces: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Pieces that lie side by side as one stretch of samples."""
    pieces = sorted((p for p in pieces if len(p[1])), key=lambda p: p[0])
    return (pieces[0][0], np.concatenate([np.asarray(x, np.float32) for _, x in pieces])) if pieces else (0, np.empty(0, np.float32))


def over_blocks(blocks: DataFrame, kernel: Kernel, size: int, out: str, halo: int = 0) -> DataFrame:
    """clip_id, segment, first, ``values``: outputs of ``kernel`` over ``blocks`` (clip_id, start, samples), in segments of ``size`` outputs.

    ``out`` is the type of an output. With a ``halo``, a segment also has that many outputs of its neighbours on either side; ``first`` is the place of the
    first output in it. Null samples are none. A clip without samples has the outputs of an empty signal.
    """
    clip = f"clip_id {blocks.schema['clip_id'].dataType.simpleString()}"
    pieces, columns = f"{clip}, segment long, start long, samples array<float>, n long", ["clip_id", "segment", "start", "samples", "n"]

    def reads(segment: int) -> tuple[int, int]:
        return kernel.first(max(0, segment * size - halo)), kernel.end((segment + 1) * size + halo - 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for of, start, x in zip(b["clip_id"], b["start"], b["samples"]):
                segment, end = max(0, (kernel.count(int(start)) - halo) // size - 1), start + len(x)
                while reads(segment)[1] <= start:
                    segment += 1
                while (bounds := reads(segment))[0] < end:
                    low, high = max(bounds[0], start), min(bounds[1], end)
                    rows.append((of, segment, low, x[low - start : high - start], None))
                    segment += 1
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The length of a clip, for each segment that reads what lies behind its end."""
        for b in batches:
            rows = []
            for of, n in zip(b["clip_id"], b["n"]):
                segment = max(0, (kernel.count(int(n)) - halo) // size - 1)
                while reads(segment)[1] <= n:
                    segment += 1
                while segment == 0 or reads(segment)[0] < n or segment * size - halo < kernel.total(int(n)):
                    rows.append((of, segment, None, None, n))
                    segment += 1
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    def compute(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        segment, n = int(key[1]), rows["n"].max()
        n = None if pd.isna(n) else int(n)
        low, high = max(0, segment * size - halo), (segment + 1) * size + halo
        high = high if n is None else min(high, kernel.total(n))
        if high <= low:
            return pd.DataFrame({"clip_id": [], "segment": [], "first": [], "values": []}, dtype=object)
        start, x = _joined([(int(s), p) for s, p in zip(rows["start"], rows["samples"]) if p is not None])
        values = kernel.run(low, high, x, start, n)
        return pd.DataFrame({"clip_id": [key[0]], "segment": [segment], "first": [low], "values": [list(values) if values.ndim > 1 else values]})

    rows = blocks.select("clip_id", F.col("start").cast("long").alias("start"), F.coalesce(F.col("samples").cast("array<float>"), F.expr("cast(array() as array<float>)")).alias("samples"))
    lengths = rows.groupBy("clip_id").agg(F.max(F.col("start") + F.size("samples")).alias("n"))
    every = rows.mapInPandas(deal, pieces).unionByName(lengths.mapInPandas(tell, pieces))
    return every.groupBy("clip_id", "segment").applyInPandas(compute, f"{clip}, segment long, first long, values array<{out}>")


def resampled(blocks: DataFrame, source: int, target: int = 16_000, size: int = SAMPLES) -> DataFrame:
    """clip_id, start, samples: ``blocks`` at another rate, as blocks again."""
    return over_blocks(blocks, Resampling(source, target), size, "float").select("clip_id", F.col("first").alias("start"), F.col("values").alias("samples"))


def log_mels(blocks: DataFrame, filters: np.ndarray, size: int = FRAMES) -> DataFrame:
    """clip_id, frame, mel: log-mel frames of ``blocks`` at 16 kHz."""
    found = over_blocks(blocks, LogMel(filters), size, "array<float>")
    return found.select("clip_id", "first", F.posexplode("values").alias("place", "mel")).select("clip_id", (F.col("first") + F.col("place")).alias("frame"), "mel")


def stacked(blocks: DataFrame, bands: int = 80, multiple: int = 512, size: int = FRAMES) -> DataFrame:
    """clip_id, row, features, is_real: features of ``blocks`` at 16 kHz, two frames to a row, padded with rows of zeros to a ``multiple``.

    Two passes: frames and the largest value of each segment; then, clamped to eight below the clip's largest, deltas and pairs. The largest value goes to
    a clip's segments by an equal join on clip and segment, so a long clip is no hot key.
    """
    size += size % 2
    mels = staged(over_blocks(blocks, DecibelMel(htk_filters(bands)), size, "array<double>", halo=1), "mels")
    most = F.array_max(F.transform("values", F.array_max))
    tops = mels.groupBy("clip_id").agg(F.max(most).alias("top"), F.max("segment").alias("last"), F.max(F.col("first") + F.size("values")).alias("n"))
    tops = tops.select("clip_id", "top", "n", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("segment"))

    @F.pandas_udf("array<array<float>>")
    def pairs(values: pd.Series, first: pd.Series, segment: pd.Series, top: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for v, f, s, t, frames in zip(values, first, segment, top, n):
            mel = np.maximum(np.stack(v), t - 8) / 4 + 1
            around = np.concatenate([mel[:1], mel, mel[-1:]])
            both = np.hstack([mel, (around[2:] - around[:-2]) / 2]).astype(np.float32)
            both = both[s * size - f : min((s + 1) * size, frames) - f]  # without the neighbours' frames
            out.append(list(both.reshape(len(both) // 2, -1)))
        return pd.Series(out)

    rows = mels.join(tops, ["clip_id", "segment"]).filter(F.col("segment") * size < F.col("n"))
    rows = rows.select("clip_id", (F.col("segment") * (size // 2)).alias("at"), F.posexplode(pairs("values", "first", "segment", "top", "n")).alias("place", "features"))
    real = rows.select("clip_id", (F.col("at") + F.col("place")).alias("row"), "features", F.lit(True).alias("is_real"))
    silence = F.transform(F.array_repeat(F.lit(0.0), 4 * bands), lambda z: z.cast("float"))
    short = tops.filter("segment = 0").select("clip_id", F.expr("n div 2").alias("n"))
    padding = short.filter(F.col("n") % multiple != 0).select("clip_id", F.explode(F.sequence("n", F.ceil(F.col("n") / multiple) * multiple - 1)).alias("row"))
    return real.unionByName(padding.select("clip_id", "row", silence.alias("features"), F.lit(False).alias("is_real")))


# Windows cut in pauses


def _cell(rate: int) -> int:
    """The length of a cell: frames begin at a multiple of it wherever a window begins. Half a frame at common rates; one sample at 22,050 Hz, whose frames are odd."""
    frame = pause_frame(rate)
    return gcd(frame, frame // 2, int(TARGET * rate) - int(SEARCH * rate)) or 1


def cell_energies(blocks: DataFrame) -> DataFrame:
    """clip_id, rate, start, end, cell, energies: sums of squares of the cells that a row of ``blocks`` (clip_id, rate, start, samples) touches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for clip, rate, start, x in zip(b["clip_id"], b["rate"], b["start"], b["samples"]):
                x, size = np.asarray(x, np.float64), _cell(int(rate))
                cuts = np.flatnonzero(np.diff((start + np.arange(len(x))) // size, prepend=-1))
                rows.append((clip, rate, start, start + len(x), start // size, np.add.reduceat(x**2, cuts) if len(x) else []))
            yield pd.DataFrame(rows, columns=["clip_id", "rate", "start", "end", "cell", "energies"], dtype=object)

    kind = blocks.schema["clip_id"].dataType.simpleString()
    samples = F.coalesce(F.col("samples"), F.expr("cast(array() as array<float>)"))
    rows = blocks.select("clip_id", F.col("rate").cast("int").alias("rate"), F.col("start").cast("long").alias("start"), samples.alias("samples"))
    return rows.mapInPandas(run, f"clip_id {kind}, rate int, start long, end long, cell long, energies array<double>")


class CutSearch:
    """A table function over one clip's energies in order: windows, each cut in the middle of the quietest frame near its target length.

    Where a window begins is known only when the one before is cut, so this is a sequential search; it holds the energies of one search range.
    """

    def __init__(self):
        self.clip, self.rate, self.window, self.start, self.end = None, 0, 0, 0, 0
        self.cell, self.held = 0, np.empty(0)

    def _cuts(self):
        frame, size, target, search = pause_frame(self.rate), _cell(self.rate), int(TARGET * self.rate), int(SEARCH * self.rate)
        while frame and self.end - self.start > target + search:
            low = self.start + target - search
            frames = 2 * search // frame
            cells = self.held[low // size - self.cell :][: frames * frame // size]
            quietest = int(np.argmin(cells.reshape(frames, -1).sum(1)))
            cut = low + quietest * frame + frame // 2
            yield self.clip, self.window, self.start, cut
            self.start, self.window = cut, self.window + 1
        passed = (self.start + target - search) // size - self.cell
        if frame and passed > 0:  # what lies before the next search range
            self.held, self.cell = self.held[passed:], self.cell + passed

    def eval(self, row):
        self.clip, self.rate, self.end = row["clip_id"], row["rate"], row["end"]
        at, new = row["cell"] - self.cell, np.asarray(row["energies"], np.float64)
        if at < 0:
            new, at = new[-at:], 0
        if len(new):
            more = max(0, at + len(new) - len(self.held))
            self.held = np.concatenate([self.held, np.zeros(more)])
            self.held[at : at + len(new)] += new
        yield from self._cuts()

    def terminate(self):
        if self.end > self.start:
            yield self.clip, self.window, self.start, self.end


def pause_windows(blocks: DataFrame) -> DataFrame:
    """clip_id, window, start, end: the windows of clips given as ``blocks`` (clip_id, rate, start, samples), which are read in parallel.

    Only energies, a number for each cell, meet in one place for a clip.
    """
    kind = blocks.schema["clip_id"].dataType.simpleString()
    search = F.udtf(CutSearch, returnType=f"clip_id {kind}, window int, start long, end long")
    return search(cell_energies(blocks).asTable().partitionBy("clip_id").orderBy("start"))

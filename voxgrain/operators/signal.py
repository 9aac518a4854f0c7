"""Signal preparation: band-limited resampling, spectra, and windows cut in pauses. The numpy kernels serve batch and streams alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The resampling filter.
ZERO_CROSSINGS, CUTOFF = 16, 0.45
# Spectra at 16 kHz.
RATE, FFT, WINDOW, HOP = 16_000, 512, 400, 160
PREEMPHASIS, LOG_GUARD, FLOOR = 0.97, 2.0**-24, 1e-10
# Windows of long recordings, in seconds.
TARGET, SEARCH, PAUSE = 60.0, 8.0, 0.020


class Polyphase:
    """The windowed-sinc kernels of a pair of rates: one for each fraction of an input sample that an output can fall on."""

    def __init__(self, source: int, target: int):
        self.step = source / target
        self.stride, self.phases = source // gcd(source, target), target // gcd(source, target)
        cut = CUTOFF * min(source, target) / source
        self.half = ceil(ZERO_CROSSINGS / (2 * cut))
        offset = np.arange(2 * self.half) - self.half + 1 - np.arange(self.phases)[:, None] / self.phases
        angle = np.pi * (offset + self.half) / self.half
        window = np.where(np.abs(offset) <= self.half, 0.42 - 0.5 * np.cos(angle) + 0.08 * np.cos(2 * angle), 0.0)
        kernels = np.sinc(2 * cut * offset) * window
        gains = kernels.sum(1, keepdims=True)
        self.kernels = np.divide(kernels, gains, out=np.zeros_like(kernels), where=np.abs(gains) > np.finfo(float).eps)

    def length(self, n: int) -> int:
        return int(n / self.step)

    def at(self, first: int, last: int, held: np.ndarray, start: int, block: int = 1 << 14) -> np.ndarray:
        """Outputs ``first`` to ``last`` (exclusive) from the input samples ``held``, which begin at input ``start``; all others are silence."""
        out = np.empty(last - first, np.float32)
        taps = np.arange(2 * self.half)
        for low in range(first, last, block):
            centre = np.arange(low, min(low + block, last), dtype=np.int64) * self.stride  # in units of a phase
            base, phase = centre // self.phases, centre % self.phases
            index = base[:, None] - self.half + 1 + taps - start
            inside = (index >= 0) & (index < len(held))
            x = np.where(inside, held[np.clip(index, 0, max(len(held) - 1, 0))] if len(held) else 0.0, 0.0)
            out[low - first : low - first + len(centre)] = np.einsum("ij,ij->i", x, self.kernels[phase])
        return out


@lru_cache(maxsize=32)
def polyphase(source: int, target: int) -> Polyphase:
    return Polyphase(source, target)


def resample_array(x: np.ndarray, source: int, target: int) -> np.ndarray:
    x = np.asarray(x, np.float32)
    if source == target or not len(x):
        return x
    bank = polyphase(source, target)
    return bank.at(0, bank.length(len(x)), x.astype(np.float64), 0)


def resample(samples: Column, rate: Column, target: int = RATE) -> Column:
    """Arrays of samples at their own rates as arrays at one rate."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else resample_array(a, int(s), target) for a, s in zip(x, r)])

    return run(samples, rate)


def resampler_response(source: int, target: int, probes: tuple[float, ...] = (10_000.0, 12_000.0, 14_000.0)) -> list[tuple[float, float, float]]:
    """(tone, decibels left of it, tone it would fold onto) for the tones that alias between these rates."""

    def level(x: np.ndarray) -> float:
        skip = min(len(x) // 10, 2000)
        body = x[skip : len(x) - skip].astype(np.float64)
        return float(np.sqrt((body**2).mean())) if len(body) else 0.0

    out = []
    for hz in probes if source != target else ():
        if target / 2 < hz < source / 2:
            tone = np.sin(2 * np.pi * hz * np.arange(source) / source).astype(np.float32)
            ratio = level(resample_array(tone, source, target)) / max(level(tone), np.finfo(float).eps)
            rest = hz % target
            out.append((hz, 20 * np.log10(max(ratio, 1e-12)), target - rest if rest > target / 2 else rest))
    return out


def hann(n: int = WINDOW) -> np.ndarray:
    """Periodic: its period is the window's length."""
    return (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)).astype(np.float32)


@lru_cache(maxsize=8)
def htk_filters(bands: int = 80, fft: int = FFT, rate: int = RATE) -> np.ndarray:
    """Triangular filters evenly spaced on the HTK mel scale, as (bands, fft // 2 + 1)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    hz = np.arange(fft // 2 + 1) * rate / fft
    rise = (hz - edge[:-2, None]) / np.diff(edge)[:-1, None]
    fall = (edge[2:, None] - hz) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def _power(signal: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Power spectra of windows that begin at ``starts``; each stands in the middle of its transform."""
    out = np.zeros((len(starts), FFT), np.float32)
    side = (FFT - WINDOW) // 2
    index = starts[:, None] + np.arange(WINDOW)
    inside = index < len(signal)
    out[:, side : side + WINDOW] = np.where(inside, signal[np.minimum(index, len(signal) - 1)], 0) * hann()
    return np.abs(np.fft.rfft(out, axis=1)).astype(np.float32) ** 2


def _mirrored(x: np.ndarray, n: int) -> np.ndarray:
    def pick(i):
        return np.where((i >= 0) & (i < len(x)), x[np.clip(i, 0, len(x) - 1)], 0)

    steps = np.arange(1, n + 1)
    return np.concatenate([pick(steps[::-1]), x, pick(len(x) - 1 - steps)]).astype(np.float32)


def stacked_features(audio: np.ndarray, bands: int = 80, multiple: int = 512) -> tuple[np.ndarray, int]:
    """Log-mel and delta features of a clip at 16 kHz, two frames to a row, padded with zero rows; and the number of real rows.

    Windows are centred; logarithms to base 10 are clamped to eight below the clip's largest, then scaled.
    """
    audio = np.asarray(audio, np.float32)
    if len(audio) <= FFT // 2:
        raise ValueError("a clip needs more samples than half a transform")
    frames = (len(audio) // HOP + 1) // 2 * 2
    if not frames:
        raise ValueError("a clip of no frames")
    audio = np.pad(audio, (0, max(0, (frames - 1) * HOP + 1 - len(audio))))
    power = _power(_mirrored(audio, FFT // 2), np.arange(frames) * HOP + (FFT - WINDOW) // 2)
    mel = np.log10(np.maximum(power @ htk_filters(bands).T, FLOOR))
    mel = np.maximum(mel, mel.max() - 8) / 4 + 1
    around = np.pad(mel, ((1, 1), (0, 0)), mode="edge")
    rows = np.hstack([mel, (around[2:] - around[:-2]) / 2]).reshape(frames // 2, 4 * bands)
    return np.pad(rows, ((0, -len(rows) % multiple), (0, 0))).astype(np.float32), frames // 2


def preemphasised(x: np.ndarray, before: float | None = None) -> np.ndarray:
    x = np.asarray(x, np.float32)
    if not len(x):
        return x
    first = x[0] if before is None else x[0] - np.float32(PREEMPHASIS) * np.float32(before)
    return np.concatenate([[first], x[1:] - np.float32(PREEMPHASIS) * x[:-1]]).astype(np.float32)


def log_mel(audio: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """(frames, bands) natural-log mel of a clip at 16 kHz with the filters an export ships; no normalisation."""
    signal = preemphasised(audio)
    if not len(signal):
        signal = np.zeros(1, np.float32)
    power = _power(_mirrored(signal, FFT // 2), np.arange(len(signal) // HOP + 1) * HOP)
    return np.log(power @ filters.T + np.float32(LOG_GUARD))


def features(samples: Column, bands: int = 80, multiple: int = 512) -> Column:
    """struct(rows, n_real) of ``stacked_features``; null where a clip is too short."""

    @F.pandas_udf("rows array<array<float>>, n_real int")
    def run(x: pd.Series) -> pd.DataFrame:
        found = [stacked_features(a, bands, multiple) if a is not None and len(a) > FFT // 2 else (None, None) for a in x]
        return pd.DataFrame({"rows": [None if f is None else list(f) for f, _ in found], "n_real": pd.array([n for _, n in found], "Int32")})

    return run(samples)


def pause_frame(rate: int) -> int:
    """Samples of the frames that a pause is looked for in."""
    return int(rate * PAUSE * 1000) // 1000


def quiet_windows(n: int, rate: int, energy: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Windows (start, end) that tile ``n`` samples, cut in the middle of the quietest frame near each target length.

    ``energy`` takes frame starts and gives their energies. The last window may run on to the end of the search range.
    """
    frame, target, search = pause_frame(rate), int(TARGET * rate), int(SEARCH * rate)
    out, start = [], 0
    while start < n:
        if n - start <= target + search or not frame:
            return [*out, (start, n)]
        at = np.arange(start + target - search, min(start + target + search, n) - frame + 1, frame)
        cut = max(int(at[np.argmin(energy(at))]) + frame // 2, start + 1)
        out.append((start, cut))
        start = cut
    return out


def sample_energy(samples: np.ndarray, rate: int) -> Callable[[np.ndarray], np.ndarray]:
    """Energies of frames of ``samples``: sums of squares."""
    frame = pause_frame(rate)

    def energy(at: np.ndarray) -> np.ndarray:
        return (samples[at[:, None] + np.arange(frame)].astype(np.float64) ** 2).sum(1)

    return energy


def plan_windows(clips: DataFrame) -> DataFrame:
    """clip_id, window, start, end: the windows of ``clips`` (clip_id, rate, samples)."""
    kind = clips.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for clip, rate, samples in zip(b["clip_id"], b["rate"], b["samples"]):
                x = np.asarray([] if samples is None else samples, np.float32)
                out += [(clip, i, s, e) for i, (s, e) in enumerate(quiet_windows(len(x), int(rate), sample_energy(x, int(rate))))]
            yield pd.DataFrame(out, columns=["clip_id", "window", "start", "end"])

    return clips.select("clip_id", "rate", "samples").mapInPandas(run, f"clip_id {kind}, window int, start long, end long")


# Operators on frames as rows


def clamp_clip(frames: DataFrame, value: str, clip: str) -> DataFrame:
    """``value`` clamped to eight below the clip's largest, over four, plus one."""
    top = F.max(value).over(Window.partitionBy(clip))
    return frames.withColumn(value, F.greatest(F.col(value), top - 8) / 4 + 1)


def row_deltas(frames: DataFrame, value: str, order: list[str], *clip: str) -> DataFrame:
    """``frames`` with ``delta``: half the difference of the neighbours in order; an edge is its own neighbour."""
    over = Window.partitionBy(*clip).orderBy(*order)
    here = F.col(value)
    return frames.withColumn("delta", (F.coalesce(F.lead(value).over(over), here) - F.coalesce(F.lag(value).over(over), here)) / 2)


def context_chunks(frames: DataFrame, clip: str, bands: int, chunk: int = 56, context: int = 9) -> DataFrame:
    """clip, chunk, frames: chunks of ``frames`` (clip, frame, mel), each after ``context`` frames of the one before; zeros before the first."""
    number = F.floor(F.col("frame") / chunk)
    home = frames.select(clip, "frame", "mel", number.alias("chunk"))
    carried = frames.filter(F.col("frame") % chunk >= chunk - context).select(clip, "frame", "mel", (number + 1).alias("chunk"))
    last = frames.groupBy(clip).agg(F.max(number).alias("last_"))
    rows = home.unionByName(carried.join(last, clip).filter(F.col("chunk") <= F.col("last_")).drop("last_"))
    mels = F.transform(F.sort_array(F.collect_list(F.struct("frame", "mel"))), lambda x: x["mel"])
    silence = F.transform(F.array_repeat(F.lit(0.0), bands), lambda z: z.cast("float"))
    full = rows.groupBy(clip, "chunk").agg(mels.alias("mels"))
    return full.select(clip, F.col("chunk").cast("int").alias("chunk"), F.when(F.col("chunk") == 0, F.concat(F.array_repeat(silence, context), "mels")).otherwise(F.col("mels")).alias("frames"))

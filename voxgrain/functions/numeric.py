"""Column functions on numbers, times and arrays of floats: clocks, scores of logits, padding and framing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd'T'HH-mm-ss'Z'"
#: Samples a second of what engines read; samples between spectrum frames; spectrum frames of an encoder frame.
RATE, HOP, SUBSAMPLING = 16_000, 160, 8
GATE = 0.75


# Times


def stamp(ts: Column) -> Column:
    """A UTC time as text that may name a file."""
    return F.date_format(ts, STAMP)


def parse_stamp(text: Column) -> Column:
    """The time of a stamp, or null if it is none."""
    shape = r"\A\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z\z"
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(STAMP)))


def civil_date(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def clock(seconds: Column) -> Column:
    """MM:SS; minutes go on beyond 59."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def duration(samples: Column, rate: Column) -> Column:
    return samples / F.greatest(rate, F.lit(1))


def frame_seconds(frame: Column) -> Column:
    return frame * (SUBSAMPLING * HOP / RATE)


def real_time_factor(wall: Column, audio: Column, guard: bool = True) -> Column:
    """Wall time over audio time; guarded against clips of no length as in file reports, unguarded as in benchmarks."""
    return wall / (F.greatest(audio, F.lit(0.001)) if guard else audio)


def chunk_frames(config_json: Column, directory: Column) -> Column:
    """Spectrum frames of a streaming chunk: from the export's config, else from ``<n>ms`` in its name, else 56."""
    of_config = F.get_json_object(config_json, "$.encoder.chunk_mel_frames").try_cast("long")
    parts = F.filter(F.split(directory, "[^A-Za-z0-9]"), lambda p: p.rlike(r"\A\+?[0-9]+ms\z"))
    ms = F.get(F.filter(F.transform(parts, lambda p: F.substring_index(p, "ms", 1).try_cast("long")), lambda n: n >= 10), F.lit(0))
    return F.coalesce(F.when(of_config > 0, of_config), F.floor(ms / 10), F.lit(56))


# Gates


def is_too_short(samples: Column, rate: Column) -> Column:
    """Clips of less than a tenth of a second are not decoded."""
    return F.size(samples) < F.floor(rate / 10)


def is_unsure(confidence: Column, gate: float = GATE, inclusive: bool = False) -> Column:
    """Below the gate, as reports count; ``inclusive`` adds the gate itself, as live flags do."""
    return confidence <= gate if inclusive else confidence < gate


def folded(hz: Column, to_rate: Column) -> Column:
    """Where a tone lands after sampling at ``to_rate``: reflected about half of it."""
    rest = hz % to_rate
    return F.when(rest > to_rate / 2, to_rate - rest).otherwise(rest)


# Scores of an array of logits


def argmax_first(values: Column) -> Column:
    """Position (from 0) of the largest value, the first of equal ones; 0 for an empty array."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)) - 1).otherwise(F.lit(0)).cast("int")


def argmax_last(values: Column) -> Column:
    """Position (from 0) of the largest value, the last of equal ones; null for an empty array."""
    return F.when(F.size(values) > 0, F.size(values) - F.array_position(F.reverse(values), F.array_max(values))).cast("int")


def _exp_sum(values: Column, top: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp((v - top).cast("double")))


def softmax_at(values: Column, index: Column) -> Column:
    """Probability of one position (from 0); 0 where it is outside or the largest value isn't finite."""
    top = F.array_max(values)
    finite = (top < float("inf")) & (top > float("-inf"))
    return F.when(finite & (F.size(values) > 0), F.coalesce(F.try_divide(F.exp((F.get(values, index) - top).cast("double")), _exp_sum(values, top)), F.lit(0.0))).otherwise(F.lit(0.0))


def top_two(values: Column) -> Column:
    """Probabilities p1 and p2 of the winner and the runner-up."""
    top = F.array_max(values)
    second = F.get(F.sort_array(values, asc=False), F.lit(1))
    total = _exp_sum(values, top)
    return F.struct(F.try_divide(F.lit(1.0), total).alias("p1"), F.coalesce(F.try_divide(F.exp((second - top).cast("double")), total), F.lit(0.0)).alias("p2"))


# Arrays of samples


def energy(samples: Column, start: Column, length: Column) -> Column:
    """Sum of squares of ``length`` samples from ``start`` (from 0) on."""
    return F.aggregate(F.slice(samples, start + 1, length), F.lit(0.0), lambda s, v: s + v.cast("double") * v)


def body_rms(samples: Column) -> Column:
    """Root mean square without the edges: a tenth at each end, 2000 samples at most."""
    n = F.size(samples)
    skip = F.least(F.floor(n / 10), F.lit(2000)).cast("int")
    inner = n - 2 * skip
    return F.when(inner > 0, F.sqrt(energy(samples, skip, inner) / inner)).otherwise(F.lit(0.0))


def decibels(ratio: Column) -> Column:
    return F.lit(20.0) * F.log10(F.greatest(ratio, F.lit(1e-12)))


def preemphasis(samples: Column, k: float = 0.97) -> Column:
    """Each sample less ``k`` times the one before it; the first stays."""
    return F.transform(samples, lambda v, i: F.when(i > 0, v - k * F.get(samples, i - 1)).otherwise(v))


def deltas(values: Column) -> Column:
    """Half the difference of the neighbours; an edge is its own neighbour."""
    last = F.size(values) - 1
    return F.transform(values, lambda _, i: (F.get(values, F.least(i + 1, last)) - F.get(values, F.greatest(i - 1, F.lit(0)))) / 2)


def reflect_pad(samples: Column, n: int) -> Column:
    """``n`` samples mirrored at each end, the edge not repeated; 0 where the clip is too short to mirror."""
    size = F.size(samples)
    before = F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda i: F.coalesce(F.get(samples, i), F.lit(0.0)))
    after = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.get(samples, size - 1 - i), F.lit(0.0)))
    return F.concat(before, samples, after)


def zero_pad(samples: Column, multiple: int = 80) -> Column:
    """Zeros at the end, up to a multiple of ``multiple``."""
    short = F.pmod(-F.size(samples), F.lit(multiple))
    return F.concat(samples, F.transform(F.array_repeat(F.lit(0.0), short), lambda z: z.cast("float")))


def overlapping_windows(samples: Column, window: int, stride: int) -> Column:
    """Arrays of ``window`` samples, one every ``stride``, the last filled with zeros."""
    n = F.size(samples)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    zeros = F.transform(F.array_repeat(F.lit(0.0), window), lambda z: z.cast("float"))
    return F.transform(starts, lambda s: F.slice(F.concat(F.slice(samples, s + 1, F.lit(window)), zeros), 1, window))

"""Live captures as streams: resampling, spectra and chunk decoding with state carried from batch to batch, equal to the batch forms.

Rows are (capture_id, seq, at, samples, is_last); ``at`` is when a chunk came, with a watermark on it. A stream has no end of its own, so the last row of
a capture says so. Chunks are taken in the order of ``seq``, whatever order they arrive in. Each capture has three state variables: its place, the samples that
outputs to come still read, and a map of the chunks ahead of their turn. So a batch rewrites little, and a chunk that waits is written once.
What a task holds of a capture does not grow with the batch: outputs are given as chunks come, and beyond 32 MB of chunks ahead of their turn the latest wait in the map.

A capture of which no chunk has come for ``idle_ms``, by the watermark, is finished as if it had ended where the chunks in turn end; chunks behind a gap go with it.
Chunks that come again are passed over, empty ones and null samples are taken, and an idle capture of which no chunk was in turn gives nothing. Queries need the state store of ``stream_session``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from ..operators.blocks import Kernel, LogMel, Resampling
from ..sources.replay import CHUNK  # noqa: F401  the columns of a stream of chunks

IDLE_MS = 60_000
#: Samples that go through a flow at once, and bytes of chunks ahead of their turn that a task holds.
_AT_ONCE, _AHEAD = 1 << 16, 1 << 25
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with state variables, which need a state store that holds several of them."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return own


class Flow:
    """A kernel over a signal that arrives bit by bit: gives the outputs that the samples so far determine, and holds what later ones read."""

    state_type = "start long, end long, done long, held array<float>"

    def __init__(self, kernel: Kernel, state: tuple = (0, 0, 0, ())):
        self.kernel = kernel
        self.start, self.end, self.done = state[:3]
        self.held = np.asarray(state[3], np.float32)

    def state(self) -> tuple:
        return self.start, self.end, self.done, self.held.tolist()

    def push(self, x) -> np.ndarray:
        x = np.asarray(x, np.float32)
        self.held, self.end = np.concatenate([self.held, x]), self.end + len(x)
        return self._give(self.kernel.count(self.end), None)

    def finish(self) -> np.ndarray:
        return self._give(self.kernel.total(self.end), self.end)

    def _give(self, upto: int, n: int | None) -> np.ndarray:
        upto = max(upto, self.done)
        out = self.kernel.run(self.done, upto, self.held, self.start, n)
        self.done = upto
        unread = min(self.kernel.first(upto), self.end)
        self.held, self.start = self.held[max(0, unread - self.start) :], max(self.start, unread)
        return out


class DecodeFlow:
    """Frames of a flow gathered into chunks, each behind the tail of the one before (zeros before the first), and decoded with carried state.

    ``decode``: (chunk with context, cache) -> (ids, cache); the cache begins as None and is the decoder's own.
    """

    state_type = Flow.state_type + ", pending array<float>, tail array<float>, cache binary"

    def __init__(self, kernel: Kernel, decode: Callable, bands: int, chunk: int = 56, context: int = 9, state: tuple | None = None):
        self.frames = Flow(kernel, state[:4]) if state else Flow(kernel)
        self.decode, self.bands, self.chunk, self.context = decode, bands, chunk, context
        pending, tail, cache = state[4:] if state else ((), np.zeros(context * bands), None)
        self.pending, self.tail = np.asarray(pending, np.float32).reshape(-1, bands), np.asarray(tail, np.float32).reshape(-1, bands)
        self.cache = pickle.loads(cache) if cache else None

    def state(self) -> tuple:
        return *self.frames.state(), self.pending.ravel().tolist(), self.tail.ravel().tolist(), pickle.dumps(self.cache)

    def push(self, x) -> list[int]:
        return self.gather(self.frames.push(x))

    def finish(self) -> list[int]:
        found = self.gather(self.frames.finish())
        return found + self._decode(len(self.pending)) if len(self.pending) else found

    def gather(self, frames: np.ndarray) -> list[int]:
        self.pending, found = np.concatenate([self.pending, np.asarray(frames, np.float32)]), []
        while len(self.pending) >= self.chunk:
            found += self._decode(self.chunk)
        return found

    def _decode(self, n: int) -> list[int]:
        seen, self.pending = np.concatenate([self.tail, self.pending[:n]]), self.pending[n:]
        found, self.cache = self.decode(seen, self.cache)
        self.tail = seen[len(seen) - self.context :]
        return list(found)


class _Ahead:
    """Chunks of a capture that are not yet taken: in memory, and those of earlier batches or beyond ``_AHEAD`` bytes in a map of the state."""

    def __init__(self, waiting):
        self.waiting, self.held = waiting, waiting.exists()
        self.new: dict[int, tuple[np.ndarray, bool]] = {}
        self.bytes = 0

    def put(self, seq: int, samples, last: bool) -> None:
        if seq in self.new:
            self._pop(seq)
        # A copy, as rows are views that keep a whole batch.
        self.new[seq] = np.array([] if samples is None else samples, np.float32), last
        self.bytes += self._size(seq)

    def take(self, turn: int) -> list[tuple[np.ndarray, bool]]:
        """The chunks from ``turn`` on that are there, as far as the last one, about ``_AT_ONCE`` samples or a gap."""
        run, n = [], 0
        while n < _AT_ONCE and not (run and run[-1][1]):
            if turn in self.new:
                samples, last = self._pop(turn)
            elif self.held and self.waiting.containsKey((turn,)):
                samples, last = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
            else:
                break
            run.append((np.asarray(samples, np.float32), last))
            turn, n = turn + 1, n + len(samples) + 1
        return run

    def store(self, most: int) -> None:
        """Beyond ``most`` bytes, the latest chunks go to the state, until half of that is left."""
        if self.bytes > most:
            for seq in sorted(self.new, reverse=True):
                if self.bytes <= most // 2:
                    break
                samples, last = self._pop(seq)
                self.waiting.updateValue((seq,), (samples.tolist(), last))
            self.held = True

    def _size(self, seq: int) -> int:
        return self.new[seq][0].nbytes + 256

    def _pop(self, seq: int) -> tuple[np.ndarray, bool]:
        self.bytes -= self._size(seq)
        return self.new.pop(seq)


class _Captures(StatefulProcessor):
    def __init__(self, make: Callable, state_type: str, row: Callable, idle_ms: int):
        self.make, self.state_type, self.row, self.idle_ms = make, state_type, row, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, given long, due long")
        self.flow = handle.getValueState("flow", self.state_type)
        self.waiting = handle.getMapState("waiting", "seq long", "samples array<float>, is_last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn, given, due = self.place.get() if self.place.exists() else (0, 0, -1)
        flow = self.make(self.flow.get()) if self.flow.exists() else self.make(None)
        ahead, latest, ended = _Ahead(self.waiting), -1, False
        for b in rows:
            latest = max([latest, *(int(at.timestamp() * 1000) for at in b["at"])])
            if ended:
                continue
            for seq, samples, last in zip(b["seq"], b["samples"], b["is_last"]):
                if seq >= turn:
                    ahead.put(int(seq), samples, bool(last))
            while not ended and (run := ahead.take(turn)):
                turn, ended = turn + len(run), run[-1][1]
                x = np.concatenate([samples for samples, _ in run])
                for i in range(0, len(x), _AT_ONCE):
                    part = flow.push(x[i : i + _AT_ONCE])
                    yield from self._rows(key, given, part)
                    given += len(part)
            if not ended:
                ahead.store(_AHEAD)
        if ended:
            yield from self._rows(key, given, flow.finish())
        if due >= 0:
            self.handle.deleteTimer(due)
        if ended:
            self._forget()
            return
        ahead.store(0)
        due = max(due, latest + self.idle_ms)
        self.handle.registerTimer(due)
        self.place.update((turn, given, due))
        self.flow.update(flow.state())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn, given, _ = self.place.get()
        if turn:
            yield from self._rows(key, given, self.make(self.flow.get()).finish())
        self._forget()

    def _rows(self, key, given: int, part) -> Iterator[pd.DataFrame]:
        if len(part):
            yield pd.DataFrame({"capture_id": key[0], "place": given + np.arange(len(part)), **self.row(part)})

    def _forget(self) -> None:
        self.place.clear()
        self.flow.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def _run(stream: DataFrame, make: Callable, state_type: str, out: str, row: Callable, idle_ms: int) -> DataFrame:
    captures = stream.select("capture_id", "seq", "at", "samples", "is_last").groupBy("capture_id")
    return captures.transformWithStateInPandas(_Captures(make, state_type, row, idle_ms), f"capture_id string, place long, {out}", "append", "eventTime")


def resampled(stream: DataFrame, source: int, target: int = 16_000, idle_ms: int = IDLE_MS) -> DataFrame:
    """capture_id, place, sample: the samples of a stream of chunks at another rate, equal to resampling each whole capture."""
    kernel = Resampling(source, target)
    return _run(stream, lambda state: Flow(kernel, state) if state else Flow(kernel), Flow.state_type, "sample float", lambda p: {"sample": p}, idle_ms)


def spectra(stream: DataFrame, filters: np.ndarray, idle_ms: int = IDLE_MS) -> DataFrame:
    """capture_id, place, mel: the log-mel frames of a stream of chunks at 16 kHz."""
    kernel = LogMel(filters)
    return _run(stream, lambda state: Flow(kernel, state) if state else Flow(kernel), Flow.state_type, "mel array<float>", lambda p: {"mel": list(p)}, idle_ms)


def decoded(stream: DataFrame, filters: np.ndarray, decode: Callable, chunk: int = 56, context: int = 9, idle_ms: int = IDLE_MS) -> DataFrame:
    """capture_id, place, id: what a decoder with carried state makes of a stream of chunks at 16 kHz."""
    kernel, bands = LogMel(filters), len(filters)
    return _run(stream, lambda state: DecodeFlow(kernel, decode, bands, chunk, context, state), DecodeFlow.state_type, "id int", lambda p: {"id": np.array(p, "int32")}, idle_ms)


def idle_sessions(events: DataFrame, ts: str, *by: str, gap: str = "60 seconds") -> DataFrame:
    """by, start, end, n: stretches of ``events`` without a pause longer than ``gap``; on a stream, with a watermark on ``ts``."""
    found = events.groupBy(*by, F.session_window(ts, gap).alias("window_")).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return found.select(*by, F.col("window_.start").alias("start"), F.col("last").alias("end"), "n")


def toggled(events: DataFrame, kind: str, order: list[str], *by: str) -> DataFrame:
    """``events`` of a trigger (``kind``: pressed or released) as those of a held one: presses start and stop in turn, releases go."""
    presses = events.filter(F.col(kind) == "pressed")
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return presses.withColumn(kind, F.when(turn % 2 == 1, "pressed").otherwise("released"))


def is_complete(chunks: DataFrame) -> DataFrame:
    """capture_id, complete: whether a capture's last chunk and all before it are there."""
    n = F.count_distinct("seq")
    last: Column = F.max(F.when(F.col("is_last"), F.col("seq")))
    return chunks.groupBy("capture_id").agg(F.coalesce(n == last + 1, F.lit(False)).alias("complete"))

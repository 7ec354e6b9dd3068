"""Keyed state of the streaming pipeline: what a window, a queue or a retention remembers between micro-batches.

Every processor keeps one packed value a key, whose size is bounded by what it remembers (ticks of a window, events
within the maximum age, arrivals that still wait), and one event-time timer a key. State lives in the state store, so
a retried micro-batch starts from the state of the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from livetick.functions.timecols import duration_us

_BUCKET = np.dtype([("k", "<i8"), ("n", "<i8"), ("mean", "<f8"), ("m2", "<f8")])


class _Packed(StatefulProcessor):
    """A processor with one packed array and some numbers a key."""

    dtype: np.dtype
    numbers: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(["packed binary", *[f"{n} bigint" for n in self.numbers]])
        self.state = handle.getValueState("held", fields)

    def load(self) -> tuple[np.ndarray, list[int]]:
        if not self.state.exists():
            return np.zeros(0, self.dtype), [0] * len(self.numbers)
        packed, *numbers = self.state.get()
        return np.frombuffer(packed, self.dtype), list(numbers)

    def save(self, held: np.ndarray, *numbers: int) -> None:
        self.state.update((held.tobytes(), *[int(n) for n in numbers]))

    def wake(self, at_ms: int | None) -> None:
        """One timer a key: the earlier one goes when another is set."""
        timers = [t for t in self.handle.listTimers()]
        for t in timers:
            if t != at_ms:
                self.handle.deleteTimer(t)
        if at_ms is not None and at_ms not in timers:
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


#: Ticks whose windows are added up at a time.
_TICKS = 2_048


def windows(buckets: np.ndarray, ticks: np.ndarray, width: int) -> np.ndarray:
    """Moments of the ``width`` buckets that end at each tick; both ascend, no tick's window is empty.

    Each window adds up its own buckets: means around its first one, deviations around its mean. Nothing is subtracted
    from running sums, and values far from zero keep their last digits.
    """
    out = np.zeros(len(ticks), _BUCKET)
    out["k"] = ticks
    # Stretches without an empty window in between, as dense arrays of a bucket a tick.
    for stretch in np.split(np.arange(len(ticks)), np.flatnonzero(np.diff(ticks) > width) + 1):
        for part in (stretch[at : at + _TICKS] for at in range(0, len(stretch), _TICKS)):
            first, last = ticks[part[0]], ticks[part[-1]]
            own = buckets[(buckets["k"] > first - width) & (buckets["k"] <= last)]
            dense = np.zeros((3, last - first + width))
            dense[:, own["k"] - (first - width + 1)] = own["n"], own["mean"], own["m2"]
            n, mean, m2 = np.lib.stride_tricks.sliding_window_view(dense, width, axis=1)[:, ticks[part] - first]
            total = n.sum(axis=1)
            center = np.take_along_axis(mean, (n > 0).argmax(axis=1)[:, None], axis=1)
            middle = center[:, 0] + (n * (mean - center)).sum(axis=1) / total
            out["n"][part], out["mean"][part] = total, middle
            out["m2"][part] = (m2 + n * (mean - middle[:, None]) ** 2).sum(axis=1)
    return out


class RingBaseline(_Packed):
    """The last ``width`` tick buckets of a host; one row for every closed tick whose window is not empty.

    Input: k, n, mean, m2 of closed ticks. Ticks without a bucket of their own are emitted with those after them, or
    by a timer once the watermark has closed them. Ring and timer are gone when the window has run empty.
    """

    dtype, numbers = _BUCKET, ("next",)

    def __init__(self, step_us: int, width: int) -> None:
        self.step, self.width = step_us, width

    def _emit(self, host: str, ring: np.ndarray, first: int, last: int) -> Iterator[pd.DataFrame]:
        """Ticks from ``first`` to ``last`` with a non-empty window."""
        reach = np.maximum(np.append(ring["k"][1:], last + 1) - ring["k"], 1)
        reach = np.minimum(reach, self.width)
        ticks = np.repeat(ring["k"], reach) + np.concatenate([np.arange(r) for r in reach]) if len(ring) else np.zeros(0, np.int64)
        ticks = ticks[(ticks >= first) & (ticks <= last)]
        if len(ticks):
            own = pd.Series(ring["n"], index=ring["k"]).reindex(ticks, fill_value=0)
            found = windows(ring, ticks, self.width)
            yield pd.DataFrame({
                "at": pd.to_datetime((ticks + 1) * self.step - 1, unit="us"), "host": host, "cpu_n": found["n"], "cpu_avg": found["mean"],
                "cpu_sd": np.sqrt(found["m2"] / found["n"]), "n_current": own.to_numpy()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring, (first,) = self.load()
        new = pd.concat(rows).sort_values("k")
        added = np.zeros(len(new), _BUCKET)
        for name in _BUCKET.names:
            added[name] = new[name]
        if not len(ring):
            first = int(added["k"][0])
        ring = np.concatenate([ring, added])
        last = int(ring["k"][-1])
        yield from self._emit(key[0], ring, first, last)
        self.save(ring[ring["k"] > last + 1 - self.width], last + 1)
        self.wake(self._end(last + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ring, (first,) = self.load()
        closed = timerValues.getCurrentWatermarkInMs() * 1000 // self.step - 1
        yield from self._emit(key[0], ring, first, closed)
        ring = ring[ring["k"] > closed + 1 - self.width]
        if len(ring):
            self.save(ring, max(first, closed + 1))
            self.wake(self._end(max(first, closed + 1)))
        else:
            self.state.clear()

    def _end(self, k: int) -> int:
        return -(-(k + 1) * self.step // 1000)


def ring_baseline(buckets: DataFrame, tick: str | int, base: str | int) -> DataFrame:
    """(at, host, cpu_n, cpu_avg, cpu_sd, n_current) of closed ticks; ``buckets`` has host, k, n, mean, m2 and an event time."""
    step = duration_us(tick)
    if step % 1000:
        raise ValueError("ticks of a stream are whole milliseconds")
    return buckets.groupBy("host").transformWithStateInPandas(
        RingBaseline(step, duration_us(base) // step), "at timestamp, host string, cpu_n bigint, cpu_avg double, cpu_sd double, n_current bigint",
        "append", "eventTime", eventTimeColumnName="at")


# --- retention by age ---------------------------------------------------------------------------------------


class Retention(StatefulProcessor):
    """Instants of the events within ``age`` of the watermark, in slices; rows say how many came and how many went.

    Only slices that gain or lose events are rewritten: the newest ones, and the oldest as the watermark moves. A
    timer is set to the moment the oldest event reaches the age.
    """

    def __init__(self, age_us: int, slice_us: int) -> None:
        self.age, self.slice = age_us, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "k bigint", "instants binary")
        self.held = handle.getValueState("held", "n bigint, oldest bigint")

    def _get(self, k: int) -> np.ndarray:
        return np.frombuffer(self.slices.getValue((k,))[0], np.int64)

    def _evict(self, key, added: int, held: int, oldest: int | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Drop what the watermark has outlived, report, and wake up when the next event does."""
        cut, gone = watermark_ms * 1000 - self.age, 0
        while oldest is not None and oldest <= cut:
            k = oldest // self.slice
            instants = self._get(k)
            rest = instants[instants > cut]
            gone += len(instants) - len(rest)
            if len(rest):
                self.slices.updateValue((k,), (rest.tobytes(),))
                oldest = int(rest.min())
            else:
                self.slices.removeKey((k,))
                left = [int(r[0]) for r in self.slices.keys()]
                oldest = int(self._get(min(left)).min()) if left else None
        held += added - gone
        if oldest is None:
            self.held.clear()
        else:
            self.held.update((held, oldest))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if oldest is not None:
            self.handle.registerTimer(-(-(oldest + self.age) // 1000))
        if added or gone:
            yield pd.DataFrame({"host": [key[0]], "added": [added], "evicted": [gone], "held": [held], "slices": [sum(1 for _ in self.slices.keys())]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([pdf["ts_us"].to_numpy(np.int64) for pdf in rows])
        held, oldest = self.held.get() if self.held.exists() else (0, None)
        for k in np.unique(new // self.slice).tolist():
            own = new[new // self.slice == k]
            before = self._get(k) if self.slices.containsKey((k,)) else own[:0]
            self.slices.updateValue((k,), (np.concatenate([before, own]).tobytes(),))
        first = int(new.min())
        yield from self._evict(key, len(new), held, first if oldest is None else min(first, oldest), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield from self._evict(key, 0, *self.held.get(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_retention(events: DataFrame, max_age: str | int, slice_width: str | int, salts: int = 16) -> DataFrame:
    """(host, added, evicted, held, slices) of every micro-batch and share of a host: the sums of ``added - evicted`` are kept.

    A host's events are spread over ``salts`` keys, whose counts add up.
    """
    rows = events.selectExpr("host", f"pmod(xxhash64(ts, seq), {salts}) AS salt", "unix_micros(ts) AS ts_us", "ts")
    return rows.groupBy("host", "salt").transformWithStateInPandas(
        Retention(duration_us(max_age), duration_us(slice_width)), "host string, added bigint, evicted bigint, held bigint, slices bigint",
        "append", "eventTime")


# --- first in, first out ------------------------------------------------------------------------------------

_WAITING = np.dtype([("rn", "<i8"), ("seq", "<i8"), ("at", "<i8")])


class Fifo(_Packed):
    """Arrivals of a key that wait for an emission, oldest first; each emission takes the oldest, others are ignored.

    What has waited longer than ``age`` when the watermark says so is reported without an emission.
    """

    dtype, numbers = _WAITING, ("arrived",)

    def __init__(self, age_us: int, keys: list[str]) -> None:
        self.age, self.keys = age_us, keys

    def _rows(self, key, taken: np.ndarray, emit_seq=None, emit_at=None) -> pd.DataFrame:
        n = len(taken)
        return pd.DataFrame({
            **{k: [v] * n for k, v in zip(self.keys, key, strict=True)}, "rn": taken["rn"], "seq": taken["seq"],
            "emit_seq": pd.array([None] * n if emit_seq is None else emit_seq, "Int64"),
            "latency_us": pd.array([None] * n if emit_at is None else emit_at - taken["at"], "Int64")})

    def _hold(self, waiting: np.ndarray, arrived: int) -> None:
        self.save(waiting, arrived)
        self.wake(-(-(int(waiting["at"].min()) + self.age) // 1000) if len(waiting) else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, (arrived,) = self.load()
        new = pd.concat(rows).sort_values("seq")
        came, left = new[~new["emitted"]], new[new["emitted"]]
        added = np.zeros(len(came), _WAITING)
        added["rn"] = arrived + 1 + np.arange(len(came))
        added["seq"], added["at"] = came["seq"], came["at_us"]
        waiting = np.concatenate([waiting, added])
        pairs = min(len(waiting), len(left))
        if pairs:
            yield self._rows(key, waiting[:pairs], left["seq"].to_numpy()[:pairs], left["at_us"].to_numpy()[:pairs])
        self._hold(waiting[pairs:], arrived + len(came))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, (arrived,) = self.load()
        gone = waiting["at"] + self.age <= timerValues.getCurrentWatermarkInMs() * 1000
        if gone.any():
            yield self._rows(key, waiting[gone])
        self._hold(waiting[~gone], arrived)


def stream_fifo(moves: DataFrame, keys: dict[str, str], max_wait: str | int) -> DataFrame:
    """Pairs of arrivals and emissions, and arrivals that waited too long (``emit_seq`` null), as they come about.

    ``moves`` is one stream of both: the keys (``name -> type``), seq, at_us, ``emitted`` and an event time.
    """
    names = list(keys)
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", rn bigint, seq bigint, emit_seq bigint, latency_us bigint"
    return moves.groupBy(*names).transformWithStateInPandas(Fifo(duration_us(max_wait), names), schema, "append", "eventTime")


# --- one clock over all hosts -------------------------------------------------------------------------------

_COUNT = np.dtype([("k", "<i8"), ("c", "<i8")])


class GlobalClock(_Packed):
    """Events so far, of the tick, and older than the maximum age, at every closed tick from the first one on.

    Its single key sees one row a tick, whatever the number of events; the state holds the counts of ticks within the age.
    """

    dtype, numbers = _COUNT, ("next", "total", "evicted")

    def __init__(self, step_us: int, age_ticks: int) -> None:
        self.step, self.age = step_us, age_ticks

    def _emit(self, held: np.ndarray, first: int, last: int, total: int, evicted: int) -> Iterator[pd.DataFrame]:
        for low in range(first, last + 1, 10_000):
            k = np.arange(low, min(last + 1, low + 10_000))
            upto = np.concatenate(([0], np.cumsum(held["c"])))
            here, old = np.searchsorted(held["k"], k, "right"), np.searchsorted(held["k"], k - self.age, "right")
            came = upto[here] - upto[np.searchsorted(held["k"], first, "left")]
            yield pd.DataFrame({
                "at": pd.to_datetime((k + 1) * self.step - 1, unit="us"), "events_ingested_total": total + came,
                "n": upto[here] - upto[np.searchsorted(held["k"], k, "left")], "evicted_total": evicted + upto[old]})

    def _advance(self, held: np.ndarray, first: int, last: int, total: int, evicted: int) -> Iterator[pd.DataFrame]:
        if last >= first:
            yield from self._emit(held, first, last, total, evicted)
            total += int(held["c"][(held["k"] >= first) & (held["k"] <= last)].sum())
            old = held["k"] <= last - self.age
            evicted += int(held["c"][old].sum())
            held, first = held[~old], last + 1
        self.save(held, first, total, evicted)
        self.wake(-(-(first + 1) * self.step // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, (first, total, evicted) = self.load()
        new = pd.concat(rows).sort_values("k")
        added = np.zeros(len(new), _COUNT)
        added["k"], added["c"] = new["k"], new["c"]
        if not self.state.exists():
            first = int(added["k"][0])
        yield from self._advance(np.concatenate([held, added]), first, int(added["k"][-1]), total, evicted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, (first, total, evicted) = self.load()
        yield from self._advance(held, first, timerValues.getCurrentWatermarkInMs() * 1000 // self.step - 1, total, evicted)


def stream_global_ticks(events: DataFrame, tick: str | int, max_age: str | int) -> DataFrame:
    """(at, events_ingested_total, n, evicted_total) of every closed tick. Events are counted by tick before they meet."""
    step, age = duration_us(tick), duration_us(max_age)
    if age % step or step % 1000:
        raise ValueError("the retention must be a whole number of ticks, and ticks whole milliseconds")
    counts = events.groupBy(F.window("ts", f"{step} microseconds").alias("w")).agg(F.count(F.lit(1)).alias("c")).select(
        F.lit("all").alias("clock"), F.window_time("w").alias("closed"), F.expr(f"unix_micros(w.start) div {step}L AS k"), "c")
    return counts.groupBy("clock").transformWithStateInPandas(
        GlobalClock(step, age // step), "at timestamp, events_ingested_total bigint, n bigint, evicted_total bigint", "append", "eventTime",
        eventTimeColumnName="at")

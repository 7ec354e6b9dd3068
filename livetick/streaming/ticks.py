"""The tick pipeline on a stream: same rows as the batch form, each emitted once.

Four stateful steps in append mode, all on event time: tick buckets, a ring of the window's buckets for each host, a join that lets the samples meet the baseline of their tick,
and the counters per host and tick. Samples of an open tick wait as one list for each salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from livetick.functions.sigma import beyond
from livetick.functions.timecols import duration_us
from livetick.schema import DEFAULT_THRESHOLDS
from livetick.streaming.state import ring_baseline

_SIDES = ("above", "below")


def _text(duration: str | int) -> str:
    return f"{duration_us(duration)} microseconds"


def tick_buckets(events: DataFrame, tick: str | int) -> DataFrame:
    """Count, mean and squared deviation of each host and closed tick, summed map-side."""
    buckets = events.groupBy(F.window("ts", _text(tick)).alias("w"), "host").agg(*[F.expr(e) for e in (
        "count(cpu) AS n", "avg(cpu) AS mean", "var_pop(cpu) * count(cpu) AS m2",
    )]).filter("n > 0")
    return buckets.select(F.window_time("w").alias("closed"), "host", F.expr(f"unix_micros(w.start) div {duration_us(tick)}L AS k"), "n", "mean", "m2")


def stream_baseline(events: DataFrame, tick: str | int, base: str | int) -> DataFrame:
    """Per host and closed tick: avg, deviation and count of the trailing window, and the slice's count.

    ``at`` is the tick's event time. A host's state is a ring of the window's buckets, each a count, a mean and a
    squared deviation; no bucket is copied per window.
    """
    return ring_baseline(tick_buckets(events, tick), tick, base)


def stream_host_ticks(
    source: Callable[[], DataFrame],
    tick: str | int,
    base: str | int,
    thresholds: tuple[float, ...] = DEFAULT_THRESHOLDS,
    salts: int = 1,
) -> DataFrame:
    """Host ticks of a watermarked stream, in append mode.

    ``source`` opens the stream; it is read twice. With ``salts`` > 1 the samples
    of one host and tick are spread over that many tasks, and so are the lists in which they wait.
    """
    levels = list(enumerate(thresholds))
    baseline = stream_baseline(source(), tick, base).selectExpr(
        "*", f"explode(sequence(0, {salts - 1})) AS salt",
    )
    # One row for each host, tick and salt waits for its baseline, eight bytes a sample.
    slices = source().groupBy(
        F.window("ts", _text(tick)).alias("w"), F.col("host").alias("sample_host"),
        F.expr(f"int(pmod(xxhash64(ts, cpu, seq), {salts})) AS sample_salt"),
    ).agg(F.collect_list("cpu").alias("samples"))
    slices = slices.select(F.window_time("w").alias("sample_at"), "sample_host", "sample_salt", "samples")
    met = baseline.join(
        slices, F.expr("at = sample_at AND host = sample_host AND salt = sample_salt"), "left_outer",
    ).select("at", "host", "cpu_avg", "cpu_sd", "cpu_n", "n_current", F.explode_outer("samples").alias("cpu"))
    stats = ("cpu_avg", "cpu_sd", "cpu_n", "n_current")
    counted = met.groupBy(F.window("at", _text(tick)).alias("tw"), "host").agg(
        *[F.expr(f"max({c}) AS {c}") for c in stats],
        *[
            F.expr(f"count_if({beyond('cpu', 'cpu_avg', 'cpu_sd', t, s)}) AS _{s}{i}")
            for s in _SIDES for i, t in levels
        ],
    )
    # Always true; it keeps the join in the plan of a reader who drops the counts, so that every reader gets the same rows.
    return counted.filter(f"_{_SIDES[0]}0 >= 0").selectExpr(
        "tw.end AS ts", "host", *stats,
        *[f"array({', '.join(f'_{s}{i}' for i, _ in levels)}) AS anomalies_{s}" for s in _SIDES],
    )

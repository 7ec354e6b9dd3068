"""Telemetry of the pipeline itself: pairing latency, percentiles, batch and gap statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from livetick.functions.timecols import duration_us, grid
from livetick.operators.grid import previous_in_key, steps
from livetick.operators.ranks import floor_percentiles
from livetick.operators.running import ranked, running


def fifo_pairs(arrivals: DataFrame, emissions: DataFrame, keys: list[str], chunk_rows: int = 1_000_000) -> DataFrame:
    """Pair the k-th arrival of a key with its k-th emission; unmatched emissions are ignored.

    Both sides carry ``seq`` (unique order) and ``at_us``.
    """
    left = ranked(arrivals, keys, "seq", chunk_rows).selectExpr(*keys, "rn", "seq", "at_us AS arrived_us")
    right = ranked(emissions, keys, "seq", chunk_rows).selectExpr(*keys, "rn", "seq AS emit_seq", "at_us AS emitted_us")
    return left.join(right, [*keys, "rn"]).selectExpr("*", "emitted_us - arrived_us AS latency_us")


def fifo_residual(arrivals: DataFrame, emissions: DataFrame, keys: list[str]) -> DataFrame:
    """Arrivals without an emission, per key; counts alone decide it, so nothing is ranked."""
    counted = arrivals.selectExpr(*keys, "1 AS a", "0 AS e").unionByName(emissions.selectExpr(*keys, "0 AS a", "1 AS e"))
    return counted.groupBy(*keys).agg(F.expr("greatest(0L, sum(a) - sum(e)) AS pending")).filter("pending > 0")


def recent_ring(df: DataFrame, metric: str, order: list[Column], capacity: int = 1024) -> DataFrame:
    """The newest ``capacity`` samples of each metric; each task sends at most that many per metric."""
    newest = Window.partitionBy(metric).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= capacity).drop("_rn")


def pause_rollup(pauses: DataFrame, kind: str, duration: str) -> DataFrame:
    return pauses.groupBy(kind).agg(
        F.count(duration).alias("pauses"), F.sum(duration).alias("total_ms"), F.max(duration).alias("max_ms"),
    )


def batch_stats(batches: DataFrame, size: str) -> DataFrame:
    """Calls, events, mean batch size (NaN without calls) and largest batch."""
    return batches.agg(*[F.expr(e) for e in (
        "count(1) AS calls", f"coalesce(sum({size}), 0L) AS events",
        f"if(count(1) = 0, double('NaN'), sum({size}) / count(1)) AS avg_batch", f"max({size}) AS max_batch",
    )])


def egress(frames: DataFrame, subscribers: str) -> DataFrame:
    """Characters sent: frame length times the subscribers open at that moment."""
    return frames.agg(*[F.expr(e) for e in (
        "count(1) AS frames", "sum(length(frame)) AS frame_chars",
        f"sum(length(frame) * {subscribers}) AS sent_chars",
    )])


def phase_residual(phases: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """What is left of the total after its measured phases."""
    return phases.selectExpr("*", f"{total} - ({' + '.join(parts)}) AS residual")


def tick_gaps(ticks: DataFrame, tick: str | int, chunk_ticks: int = 100_000) -> DataFrame:
    """Clock gap to the host's previous tick, and whether boundaries were missed in between."""
    step = duration_us(tick)
    gaps = previous_in_key(ticks.select("host", "ts_us"), ["host"], "ts_us", step * chunk_ticks, "_prev")
    return gaps.filter("_prev IS NOT NULL").selectExpr(
        "host", "ts_us", "ts_us - _prev AS gap_us", f"ts_us - _prev > {step} AS missed",
    )


def counter_deltas(scrapes: DataFrame, keys: list[str], at: str, counters: list[str], gauges: list[str]) -> DataFrame:
    """Achieved rate of each counter between the first and last scrape, and the peak of each gauge."""
    ends = scrapes.groupBy(*keys).agg(*[F.expr(e) for e in (
        f"max({at}) - min({at}) AS span",
        *[f"max_by({c}, {at}) - min_by({c}, {at}) AS {c}_delta" for c in counters],
        *[f"max({g}) AS {g}_peak" for g in gauges],
    )])
    return ends.selectExpr("*", *[f"if(span > 0, {c}_delta / span, NULL) AS {c}_rate" for c in counters])


def frame_fanin(ticks: DataFrame, chunk_us: int) -> DataFrame:
    """Per frame: samples folded into it, then running frames, running samples and their ratio."""
    frames = ticks.groupBy("ts_us").agg(F.sum("cpu_n").alias("frame_events"))
    run = running(frames, [], "ts_us", grid("ts_us", chunk_us), {
        "total_frames": ("sum", "1L"), "total_events": ("sum", "frame_events"),
    })
    return run.selectExpr("*", "total_events / total_frames AS fan_in")


def global_ticks(events: DataFrame, tick: str | int, max_age: str | int, chunk_ticks: int = 100_000) -> DataFrame:
    """Every closed tick from the first event on, quiet ones too: events ingested so far, the tick's rate, and
    events older than ``max_age`` by then."""
    step, age = duration_us(tick), duration_us(max_age)
    if age % step:
        raise ValueError("the retention must be a whole number of ticks")
    last = events.agg(F.expr(f"{grid('max(ts_us)', step)} - 1")).scalar()
    counts = events.groupBy(F.expr(f"{grid('ts_us', step)} AS k")).agg(F.count(F.lit(1)).alias("c"))
    # A slice is ingested at its own boundary and gone once its age has passed.
    moves = counts.selectExpr(
        f"inline(array(struct(k, c AS n, 0L AS gone), struct(k + {age // step}L AS k, 0L AS n, c AS gone)))",
    )
    first = events.agg(F.expr(f"min({grid('ts_us', step)}) AS _low"), F.expr(f"{grid('max(ts_us)', step)} - 1 AS _high"))
    quiet = steps(first, "_low", "_high", "k").selectExpr("k", "0L AS n", "0L AS gone")
    moves = moves.unionByName(quiet).groupBy("k").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone")).filter(F.col("k") <= last)
    run = running(moves, [], "k", grid("k", chunk_ticks), {
        "events_ingested_total": ("sum", "n"), "evicted_total": ("sum", "gone"),
    })
    return run.selectExpr(
        f"(k + 1) * {step}L AS ts_us", "events_ingested_total", f"n / {step / 1_000_000!r}D AS events_per_sec",
        "evicted_total",
    )


def cumulative_rate(events: DataFrame, tick: str | int, chunk_ticks: int = 100_000) -> DataFrame:
    """Running sum of a value per host at each of its ticks, and its change per second."""
    step = duration_us(tick)
    slices = events.groupBy("host", F.expr(f"{grid('ts_us', step)} AS k")).agg(F.sum("requests").alias("s"))
    chunk = grid("k", chunk_ticks)
    total = running(slices, ["host"], "k", chunk, {"cumulative": ("sum", "s")})
    with_prev = running(total, ["host"], "k", chunk, {"_prev": ("max", "k")}, exclusive=True)
    return with_prev.selectExpr(
        f"(k + 1) * {step}L AS ts_us", "host", "cumulative", f"s / ((k - _prev) * {step / 1_000_000!r}D) AS rate",
    )


def conservation(ticks: DataFrame, events: DataFrame, tick: str | int, limit_percent: float = 30.0) -> DataFrame:
    """Samples delivered through tick slices against raw events of the same closed ticks, in percent."""
    step = duration_us(tick)
    end = events.agg(F.expr(f"{grid('max(ts_us)', step)} * {step}L")).scalar()
    raw = events.filter(F.col("ts_us") < end).agg(F.count(F.lit(1))).scalar()
    frames = ticks.groupBy("ts_us").agg(F.sum("n_current").alias("n"))
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.expr("coalesce(sum(n), 0L) AS folded")).withColumn(
        "raw", raw,
    ).selectExpr("*", "if(raw > 0, (folded - raw) * 100.0D / raw, NULL) AS drift_percent").selectExpr(
        "*", f"abs(drift_percent) >= {limit_percent!r}D AS flagged",
    )


__all__ = [
    "fifo_pairs", "fifo_residual", "recent_ring", "floor_percentiles", "pause_rollup", "batch_stats", "egress", "phase_residual", "tick_gaps",
    "counter_deltas", "frame_fanin", "global_ticks", "cumulative_rate", "conservation",
]

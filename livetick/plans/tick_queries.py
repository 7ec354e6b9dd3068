"""Tick stream: baselines, slices, frames, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from livetick.functions.timecols import grid
from livetick.operators import telemetry
from livetick.operators.rollups import newest, weighted_rollup as weighted
from livetick.operators.running import running
from livetick.operators.ticks import host_ticks as build_ticks, slice_samples as samples_of, tick_slices
from livetick.plans import inputs, settings as S
from livetick.plans.shape import flat, ms, num
from livetick.sources import frames
from livetick.sources.tables import read_events, read_lineitem


def _tick_rows(ticks: DataFrame) -> DataFrame:
    return ticks.selectExpr(
        ms(), "host", num("cpu_avg"), num("cpu_sd"), "cpu_n", "n_current",
        flat("anomalies_above"), flat("anomalies_below"),
    )


def host_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tick_rows(inputs.ticks(spark, sf_dir))


def host_ticks_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings a billion higher: every count stays as it is."""
    shifted = read_events(spark, sf_dir).withColumn("cpu", F.expr("cpu + 1000000000D"))
    return build_ticks(shifted, S.TICK, S.BASE, places=S.PLACES).selectExpr(
        ms(), "host", "cpu_n", "n_current", flat("anomalies_above"), flat("anomalies_below"))


def host_ticks_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tick_rows(build_ticks(read_events(spark, sf_dir), S.DENSE_TICK, S.DENSE_BASE, places=S.PLACES))


def host_ticks_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tick_rows(build_ticks(read_lineitem(spark, sf_dir), S.LINE_TICK, S.LINE_BASE, places=S.PLACES))


def host_ticks_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline of one tick leaves silent ticks; they are emitted with count 0."""
    return _tick_rows(build_ticks(read_events(spark, sf_dir), S.TICK, S.TICK, emit_empty=True, places=S.PLACES))


def slice_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(read_events(spark, sf_dir), S.TICK, S.PART_ROWS).selectExpr(
        ms(), "host", "part", "n_current", flat("samples"),
    )


def tick_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_slices(read_events(spark, sf_dir), S.TICK).selectExpr(ms(), "host", "cpu_min", "cpu_max")


def tick_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_slices(read_events(spark, sf_dir), S.TICK).selectExpr(
        ms(), "host", num("requests_avg"), "requests_sum", "requests_n",
    )


def agg_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON frame per tick, compared through its decoded rows."""
    encoded = frames.aggregate_frames(inputs.ticks(spark, sf_dir))
    return frames.decode_ticks(encoded).selectExpr(
        "type", "ts AS ts_ms", "host", num("cpu_avg"), num("cpu_sd"), "cpu_n", "n_current",
        flat("anomalies_above"), flat("anomalies_below"),
    )


def tick_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recent ticks a late subscriber receives, as snapshot frames with thresholds."""
    ticks = inputs.ticks(spark, sf_dir)
    span = 86_400_000_000
    recent = ticks.filter(F.col("ts_us") > ticks.agg(F.max("ts_us")).scalar() - span)
    return frames.decode_ticks(frames.aggregate_snapshot(recent)).selectExpr(
        "type", "ts AS ts_ms", "host", num("cpu_avg"), "cpu_n", "n_current",
    )


def last_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = newest(inputs.ticks(spark, sf_dir), 20, F.col("ts_us").desc(), F.col("host"))
    return rows.selectExpr(ms(), "host", num("cpu_avg"), num("cpu_sd"), "cpu_n", "n_current")


def weighted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weighted(inputs.ticks(spark, sf_dir), S.TICK, "6h")
    return rows.selectExpr(ms(), "host", num("weighted_avg"), "weight")


def frame_fanin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.frame_fanin(inputs.ticks(spark, sf_dir), 7 * 86_400_000_000)
    return rows.selectExpr(ms(), "frame_events", "total_frames", "total_events", num("fan_in"))


def global_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.global_ticks(read_events(spark, sf_dir), S.TICK, S.KEEP, chunk_ticks=200)
    return rows.selectExpr(ms(), "events_ingested_total", num("events_per_sec"), "evicted_total")


def cumulative_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.cumulative_rate(read_events(spark, sf_dir), S.TICK, chunk_ticks=200)
    return rows.selectExpr(ms(), "host", "cumulative", num("rate"))


def tick_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a host's slices: median, p99 and missed boundaries per host."""
    slices = tick_slices(read_events(spark, sf_dir), S.TICK)
    gaps = telemetry.tick_gaps(slices, S.TICK, chunk_ticks=200)
    ranks = telemetry.floor_percentiles(gaps, ["host"], "gap_us", [50, 99])
    missed = gaps.groupBy("host").agg(F.count_if("missed").alias("missed"))
    return ranks.join(missed, "host").selectExpr(
        "host", "n AS n_gaps", ms("p50", "p50_ms"), ms("p99", "p99_ms"), "missed",
    )


def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    rows = telemetry.conservation(build_ticks(events, S.TICK, S.BASE), events, S.TICK)
    return rows.selectExpr("frames", "folded", "raw", num("drift_percent"), "flagged")


def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrapes are the hourly slices of each host with running counters."""
    slices = tick_slices(read_events(spark, sf_dir), S.TICK).selectExpr("*", f"{grid('ts_us', 1_000_000)} AS uptime_sec")
    scrapes = running(slices, ["host"], "ts_us", grid("ts_us", 7 * 86_400_000_000), {
        "ingested": ("sum", "n_current"), "requests": ("sum", "requests_sum"),
    })
    rows = telemetry.counter_deltas(scrapes, ["host"], "uptime_sec", ["ingested", "requests"], ["cpu_max"])
    return rows.selectExpr(
        "host", "span AS span_sec", "ingested_delta", "requests_delta",
        num("ingested_rate"), num("requests_rate"), "cpu_max_peak",
    )


__all__ = [
    "host_ticks", "host_ticks_dense", "host_ticks_lineitem", "host_ticks_silent", "slice_samples",
    "tick_extremes", "tick_requests", "agg_frames", "tick_backfill", "last_ticks", "weighted_rollup",
    "frame_fanin", "global_ticks", "cumulative_rate", "tick_gaps", "conservation", "counter_deltas",
]

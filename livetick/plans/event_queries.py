"""Raw event stream: sources, frames, roll-ups, baselines, ordering, telemetry."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from livetick.functions.timecols import duration_us, grid as grid_of
from livetick.operators import baseline, custom, grid, hosts, ordering, rolling, rolling_ranks, rollups, smoothing, telemetry
from livetick.plans import inputs, settings as S
from livetick.plans.shape import flat, ms, num
from livetick.schema import contract_report
from livetick.sources import frames
from livetick.sources.tables import read_events, to_points
from livetick.sources.validate import split_required


# -- sources and frames -------------------------------------------------------------

def batch_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = frames.event_batches(read_events(spark, sf_dir), S.BATCH_ROWS)
    return frames.unpack_batches(batches, ["batch_id"]).select("batch_id", "time_ms", "cpu", "requests", "host")


def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and aggregate frames on one channel; the raw reader keeps its own types only."""
    events = read_events(spark, sf_dir)
    raw = frames.append_frames(frames.event_batches(events, S.BATCH_ROWS)).select("frame")
    other = frames.empty_aggregate_snapshot(spark).select("frame")
    return frames.decode_events(raw.unionByName(other)).select("type", "time_ms", "cpu", "requests", "host")


def snapshot_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained rows as snapshot frames, summarised per frame after decoding."""
    kept = ordering.retained(read_events(spark, sf_dir), S.KEEP)
    parts = frames.snapshot_frames(kept, S.BATCH_ROWS)
    decoded = parts.select("part", F.from_json("frame", "type string, rows array<struct<time_ms bigint, cpu double>>").alias("f"))
    return decoded.select("part", F.col("f.type").alias("type"), F.inline("f.rows")).groupBy("part", "type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"),
        F.expr(num("sum(cpu)", "cpu_sum")),
    )


def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = T.StructType([
        T.StructField("event_id", T.LongType(), False), T.StructField("ts", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False), T.StructField("value", T.DoubleType(), False),
    ])
    return contract_report(spark.read.parquet(f"{sf_dir}/events.parquet"), declared)


def required_null_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zero reading counts as missing here; the row is set aside with the reason."""
    rows = read_events(spark, sf_dir).select("seq", "host", F.nullif("cpu", F.lit(0.0)).alias("cpu"),
                                             F.nullif("requests", F.lit(0)).alias("requests"))
    tagged = split_required(rows, ["cpu", "requests", "host"])
    return tagged.selectExpr("seq", "status", flat("missing"))


# -- hosts, filters, roll-ups -------------------------------------------------------

def enabled_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hosts.enabled(read_events(spark, sf_dir), inputs.disabled(spark))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def host_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.discover(read_events(spark, sf_dir), inputs.hosts(spark)).selectExpr(
        "host", "bigint(rank) AS rank").orderBy("rank")


def high_cpu_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hosts.high_value(read_events(spark, sf_dir), S.HIGH, inputs.disabled(spark))
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("alerts"))


def host_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.host_rollup(read_events(spark, sf_dir)).selectExpr(
        "host", num("cpu_avg"), num("cpu_sd"), "n", "requests_sum", "cpu_min", "cpu_max")


def host_tail_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.tail(read_events(spark, sf_dir), S.TAIL).groupBy("host").agg(
        F.expr(num("avg(requests)", "requests_avg")), F.count(F.lit(1)).alias("n"))


def rolling_tail_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.tail(read_events(spark, sf_dir), S.TAIL).agg(F.expr(num("avg(cpu)", "rolling_cpu")))


def event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.event_rate(read_events(spark, sf_dir), S.TAIL).selectExpr("n_events", num("events_per_sec"))


def alert_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    alerts = hosts.high_value(events, S.HIGH, inputs.disabled(spark))
    bars = rollups.dense_bars(alerts, S.BUCKET, inputs.axis(events))
    return bars.selectExpr(ms("begin_us", "begin_ms"), ms("end_us", "end_ms"), ms("mid_us", "mid_ms"), "n")


def keep_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.top_n(read_events(spark, sf_dir), S.TICK, 3).selectExpr(ms(), "host", "cpu_keep", "n", flat("top"))


def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.edges(read_events(spark, sf_dir), 5)


def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollups.newest(read_events(spark, sf_dir), 20, F.col("ts").desc(), F.col("seq").desc())
    return rows.selectExpr("seq", ms(), "host", "cpu", "requests")


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.page_summary(read_events(spark, sf_dir), S.KEEP, S.TAIL).selectExpr(
        "retained", "hosts", num("events_per_sec"), "evicted")


def custom_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square through the user-function surface."""
    return custom.custom_reduce(
        read_events(spark, sf_dir), "host", "cpu",
        partial=lambda v: [float((v * v).sum()), float(len(v))],
        combine=lambda a, b: [a[0] + b[0], a[1] + b[1]],
        finish=lambda s: math.sqrt(s[0] / s[1]),
        out="cpu_rms",
    ).selectExpr("host", num("cpu_rms"))


def host_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statistic of each host's whole sub-series that cannot be merged from parts, without gathering a host."""
    calls = rollups.middles(read_events(spark, sf_dir).select("host", "cpu"), "host", "cpu")
    return calls.selectExpr("host", num("mid", "median"), num("high - low", "spread"), "n")


def series_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function of each sub-series that cannot be merged from parts: median and longest run that never falls."""
    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        run = (pdf["cpu"].diff() < 0).cumsum()
        return pd.DataFrame({"host": pdf["host"][:1], "part": pdf["part"][:1], "n": [len(pdf)], "first_seq": pdf["seq"][:1],
                             "median": [pdf["cpu"].median()], "longest_rise": [run.value_counts().max()]})

    rows = custom.series_apply(read_events(spark, sf_dir).select("seq", "host", "cpu"), "host", shape,
                               "host string, part bigint, n bigint, first_seq bigint, median double, longest_rise bigint", S.SERIES_ROWS)
    return rows.selectExpr("host", "part", "n", "first_seq", num("median"), "longest_rise")


def slice_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named output map of a tick's slice with the reducers that return values or lists of them."""
    rows = read_events(spark, sf_dir).withColumn("k", F.expr(grid_of("ts_us", duration_us(S.TICK))))
    reduced = rollups.reduce_by(
        rows, ["host", "k"], n=("cpu", "count"), requests=("requests", "unique"), samples=("cpu", "samples"), top=("cpu", "top2"),
        first_cpu=("cpu", "first"), last_cpu=("cpu", "last"), cpu_avg=("cpu", "avg"))
    return reduced.selectExpr("host", "k", "n", flat("requests"), flat("samples"), flat("top"), "first_cpu", "last_cpu", num("cpu_avg"))


# -- rolling and ordered ------------------------------------------------------------

def event_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baseline.event_baseline(read_events(spark, sf_dir), S.BASE, 2.0, S.MIN_SAMPLES)
    return rows.selectExpr("seq", ms(), "host", "cpu", "window_n", num("avg"), num("sd"), num("upper"), num("lower"))


def event_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baseline.event_baseline(read_events(spark, sf_dir), S.BASE, 2.0, S.MIN_SAMPLES)
    return baseline.outliers(rows).selectExpr("seq", ms(), "host", "cpu", num("upper"), num("lower"))


def event_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in and custom reducers over the trailing window of each event."""
    folds = {
        "n": ("sum", "1L"), "s": ("sum", "requests"), "lo": ("min", "cpu"), "hi": ("max", "cpu"), "l": ("sum", "ln(1 + cpu)"),
    }
    rows = rolling.rolling(read_events(spark, sf_dir), S.BASE, folds, {
        "window_n": "n", "requests_sum": "s", "cpu_min": "lo", "cpu_max": "hi", "log_mean": "exp(l / n) - 1",
    })
    return rows.selectExpr("seq", ms(), "host", "window_n", "requests_sum", "cpu_min", "cpu_max", num("log_mean"))


def event_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reducers of the trailing window that cannot be merged from parts: the median and a floor percentile."""
    rows = rolling_ranks.rolling_quantiles(read_events(spark, sf_dir), S.BASE, {
        "median": rolling_ranks.MEDIAN, "p90": rolling_ranks.floor_percentile(90)})
    return rows.selectExpr("seq", ms(), "host", "window_n", num("median"), "p90")


def _smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    rate = rollups.event_rate(events, S.TAIL).select("events_per_sec").scalar()
    smooth = smoothing.ema(events.select("seq", "ts_us", "host", "requests"), ["host"], "requests",
                           S.ALPHA_REQUESTS, chunk_rows=2_000_000)
    return smoothing.scaled(smoothing.after_warm_up(smooth, S.WARM_UP), "ema", rate, "req_per_sec")


def ema_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smoothed(spark, sf_dir).selectExpr("seq", ms(), "host", "pos", num("ema"), num("req_per_sec"))


def ema_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.ema_last(read_events(spark, sf_dir), "cpu", S.ALPHA_TREND).selectExpr(num("trend"))


def total_req_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = hosts.enabled(rollups.latest_per(_smoothed(spark, sf_dir), ["host"], "seq"), inputs.disabled(spark))
    return last.agg(F.expr(num("sum(req_per_sec)", "total_req_per_sec")))


def back_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordering.back_window(read_events(spark, sf_dir), S.VIEW)
    return rows.selectExpr("seq", ms(), "host", "cpu", ms("t_start_us", "t_start_ms"), ms("t_end_us", "t_end_ms"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.retention(read_events(spark, sf_dir), S.KEEP)


def late_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High readings arrive up to seven places late; those behind the newest accepted one are dropped."""
    shifted = read_events(spark, sf_dir).selectExpr("*", f"seq * 2 + if(cpu > {S.HIGH}, 15, 0) AS arrival")
    return ordering.late_filter(shifted, "arrival").selectExpr("seq", ms(), "host")


def snapshot_append_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the first 60 % of the time span, then a re-delivery from its half on."""
    events = read_events(spark, sf_dir)
    lo, hi = events.agg(F.min("ts")).scalar(), events.agg(F.max("ts")).scalar()
    held = events.filter(F.col("ts") <= lo + (hi - lo) * 0.6)
    incoming = events.filter(F.col("ts") >= lo + (hi - lo) * 0.5)
    return ordering.resume_merge(held, incoming).selectExpr("seq", ms(), "host", "cpu")


def snapshot_from_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client that holds nothing yet resumes; it gets the whole re-delivery."""
    events = read_events(spark, sf_dir)
    return ordering.resume_merge(events.filter(F.lit(False)), events).selectExpr("seq", ms(), "host", "cpu")


def timed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the enabled hosts in order of time."""
    rows = hosts.enabled(read_events(spark, sf_dir), inputs.disabled(spark)).withColumn("ts_ms", F.expr("ts_us div 1000L"))
    return to_points(rows, "ts_ms", "host", "cpu")


def grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid.grid_fill(read_events(spark, sf_dir), "10m", chunk_steps=1_000)
    return rows.selectExpr(ms(), "host", num("value"), num("filled"))


# -- telemetry ----------------------------------------------------------------------

def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    return telemetry.fifo_pairs(inputs.arrivals(events), inputs.emissions(events), ["host", "day"])


def fifo_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("host", "day", "rn", "seq", "emit_seq", "latency_us")


def fifo_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    return telemetry.fifo_residual(inputs.arrivals(events), inputs.emissions(events), ["host", "day"])


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = telemetry.recent_ring(_pairs(spark, sf_dir), "host", [F.col("emitted_us").desc(), F.col("seq").desc()])
    return telemetry.floor_percentiles(ring, ["host"], "latency_us", [50, 95, 99])


def pause_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.pause_rollup(read_events(spark, sf_dir), "host", "cpu").selectExpr(
        "host", "pauses", num("total_ms"), "max_ms")


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are the events of one host within an hour."""
    sizes = read_events(spark, sf_dir).groupBy("host", F.expr(grid_of("ts_us", 3_600_000_000)).alias("k")).agg(
        F.count(F.lit(1)).alias("size"))
    return telemetry.batch_stats(sizes, "size").selectExpr("calls", "events", num("avg_batch"), "max_batch")


def egress_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame goes to the users active in its batch."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = raw.groupBy(F.expr(grid_of("event_id", S.BATCH_ROWS)).alias("batch_id")).agg(
        F.countDistinct("user_id").alias("subscribers"))
    encoded = frames.append_frames(frames.event_batches(read_events(spark, sf_dir), S.BATCH_ROWS))
    return telemetry.egress(encoded.join(users, "batch_id"), "subscribers")


def phase_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price as the total, discount and tax as its measured phases; percentiles of what is left."""
    phases = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_returnflag", "l_extendedprice AS total", "l_extendedprice * l_discount AS record",
        "l_extendedprice * l_tax AS serialize",
    )
    rest = telemetry.phase_residual(phases, "total", ["record", "serialize"])
    ranks = telemetry.floor_percentiles(rest, ["l_returnflag"], "residual", [50, 95, 99])
    return ranks.selectExpr("l_returnflag", "n", num("p50"), num("p95"), num("p99"))

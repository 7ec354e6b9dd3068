"""Chart tables derived from the tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from livetick.functions.display import age_text, percent_text
from livetick.functions.sigma import count_at_sigma as at_sigma
from livetick.operators import bands as B, hosts, rollups
from livetick.plans import inputs, settings as S
from livetick.plans.shape import ms, num
from livetick.sources.tables import from_points, read_events, static_series


def _enabled_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.enabled(inputs.ticks(spark, sf_dir), inputs.disabled(spark))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.bands(_enabled_ticks(spark, sf_dir), S.SIGMA, S.MIN_SAMPLES)
    return rows.selectExpr(ms(), "host", num("smooth"), num("upper"), num("lower"))


def anomaly_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    dots = B.anomaly_dots(_enabled_ticks(spark, sf_dir), S.SIGMA, S.MIN_SAMPLES)
    return dots.selectExpr(ms(), "host", "side", num("value"), num("n_at_sigma"), num("radius"), num("opacity"))


def anomaly_bars_15s(spark: SparkSession, sf_dir: str) -> DataFrame:
    dots = B.anomaly_dots(_enabled_ticks(spark, sf_dir), S.SIGMA, S.MIN_SAMPLES)
    points = from_points(dots, T.StructType([
        T.StructField("ts_us", T.LongType()), T.StructField("value", T.DoubleType())]))
    bars = rollups.dense_bars(points, S.BUCKET, inputs.axis(read_events(spark, sf_dir)))
    return bars.selectExpr(ms("begin_us", "begin_ms"), ms("end_us", "end_ms"), ms("mid_us", "mid_ms"), "n")


def anomaly_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.anomaly_density(inputs.ticks(spark, sf_dir), S.SIGMA, S.BUCKET)
    return rows.selectExpr(ms("bucket_us", "bucket_ms"), "host", num("anomalies"), "samples", num("fraction"))


def anomaly_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.anomaly_feed(inputs.ticks(spark, sf_dir), S.SIGMA, 20)
    return rows.selectExpr(ms(), "host", num("above_at_sigma"), num("below_at_sigma"), "n_current")


def _at_every_sigma(spark: SparkSession, sf_dir: str, log: bool) -> DataFrame:
    sigmas = ", ".join(f"{s!r}D" for s in S.SIGMAS)
    rows = inputs.ticks(spark, sf_dir).selectExpr("*", f"explode(array({sigmas})) AS sigma")
    return rows.selectExpr(ms(), "host", "sigma", *[
        num(at_sigma(f"anomalies_{side}", "sigma", log=log), side) for side in ("above", "below")
    ])


def count_at_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at_every_sigma(spark, sf_dir, log=False)


def count_at_sigma_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at_every_sigma(spark, sf_dir, log=True)


def wide_by_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.bands(inputs.ticks(spark, sf_dir), S.SIGMA, S.MIN_SAMPLES)
    wide = B.wide_by_time(rows, S.HOSTS, ["smooth", "upper", "lower"])
    return wide.selectExpr(ms(), *[num(f"{h}_{c}") for h in S.ALL_HOSTS for c in ("smooth", "upper", "lower")])


def axis_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.bands(_enabled_ticks(spark, sf_dir), S.SIGMA, S.MIN_SAMPLES)
    return B.axis_domain(rows, ["smooth", "upper", "lower"]).selectExpr(num("lo"), num("hi"), num("y_min"), num("y_max"))


def threshold_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed lines of the enabled hosts plus a fixed line over the visible axis."""
    events = read_events(spark, sf_dir)
    lines = B.gated(_enabled_ticks(spark, sf_dir), S.SIGMA, S.MIN_SAMPLES).selectExpr(
        "host AS series", ms(), num("smooth", "value"))
    # Two mounted rows; each takes one end of the axis.
    mounted = static_series(spark, [(-5 * 86_400_000, S.HIGH), (0, S.HIGH)])
    axis_end = events.agg(F.expr(ms("max(ts_us)", "t"))).scalar()
    line = mounted.select(F.lit("threshold").alias("series"), (F.col("ts_ms") + axis_end).alias("ts_ms"), "value")
    return lines.unionByName(line)


def latest_tick_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest tick per host, known hosts first, with display texts and age at the newest event."""
    as_of = read_events(spark, sf_dir).agg(F.max("ts_us")).scalar()
    last = rollups.latest_per(inputs.ticks(spark, sf_dir), ["host"])
    ordered = hosts.ranked_hosts(last, inputs.hosts(spark)).withColumn("age_ms", (as_of - F.col("ts_us")))
    return ordered.selectExpr(
        "host", "bigint(rank) AS rank", ms(), f"{percent_text('cpu_avg')} AS avg_text",
        f"{percent_text('cpu_sd')} AS sd_text", "cpu_n", f"{age_text('(age_ms div 1000L)')} AS age",
    )

"""Chart tables over host ticks: gated bands, density dots, bars, wide rows, axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from livetick.functions.sigma import count_at_sigma, dot_opacity, dot_radius, threshold_array
from livetick.functions.timecols import duration_us, grid_start


def gated(ticks: DataFrame, sigma: float, min_samples: int) -> DataFrame:
    """Band edges avg +- sigma * sd; null (a gap, the row stays) below ``min_samples``."""
    avg = f"if(cpu_n >= {min_samples}, cpu_avg, NULL)"
    return ticks.selectExpr(
        "*", f"{avg} AS smooth", f"{avg} + {float(sigma)!r}D * cpu_sd AS upper",
        f"{avg} - {float(sigma)!r}D * cpu_sd AS lower",
    )


def drawable_hosts(rows: DataFrame, at_least: int = 2) -> DataFrame:
    """Hosts with enough edge rows for a band; gap rows count."""
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least).select("host")


def bands(ticks: DataFrame, sigma: float, min_samples: int = 30) -> DataFrame:
    rows = gated(ticks, sigma, min_samples)
    return rows.join(drawable_hosts(ticks), "host", "left_semi").select("ts_us", "host", "smooth", "upper", "lower")


def anomaly_dots(ticks: DataFrame, sigma: float, min_samples: int = 30,
                 thresholds: tuple[float, ...] | None = None) -> DataFrame:
    """A dot on a band edge wherever the interpolated count reaches one."""
    at = threshold_array(thresholds)
    rows = gated(ticks, sigma, min_samples).join(drawable_hosts(ticks), "host", "left_semi")
    sides = ", ".join(
        f"struct('{side}' AS side, {edge} AS value, {count_at_sigma(f'anomalies_{side}', sigma, at)} AS n_at_sigma)"
        for side, edge in (("above", "upper"), ("below", "lower"))
    )
    dots = rows.selectExpr("ts_us", "host", f"inline(array({sides}))")
    return dots.filter("n_at_sigma >= 1 AND value IS NOT NULL").selectExpr(
        "*", f"{dot_radius('n_at_sigma')} AS radius", f"{dot_opacity('n_at_sigma')} AS opacity",
    )


def with_density(ticks: DataFrame, sigma: float, thresholds: tuple[float, ...] | None = None,
                 log: bool = False) -> DataFrame:
    """Interpolated counts above and below at sigma, for every tick."""
    at = threshold_array(thresholds)
    return ticks.selectExpr("*", *[
        f"{count_at_sigma(f'anomalies_{side}', sigma, at, log=log)} AS {side}_at_sigma" for side in ("above", "below")
    ])


def anomaly_density(ticks: DataFrame, sigma: float, step: str | int) -> DataFrame:
    """Per host and bucket: interpolated anomalies, samples, and the anomalous share of the samples."""
    bucket = F.expr(f"{grid_start('ts_us', duration_us(step))} AS bucket_us")
    return with_density(ticks, sigma).groupBy("host", bucket).agg(
        F.expr("sum(above_at_sigma + below_at_sigma) AS anomalies"), F.sum("n_current").alias("samples"),
    ).selectExpr("*", "if(samples > 0, anomalies / samples, NULL) AS fraction")


def anomaly_feed(ticks: DataFrame, sigma: float, n: int = 20) -> DataFrame:
    """The newest n ticks with any interpolated anomaly at sigma."""
    return (
        with_density(ticks, sigma).filter("above_at_sigma + below_at_sigma > 0")
        .orderBy(F.col("ts_us").desc(), F.col("host")).limit(n)
    )


#: Columns of a wide table; a chart with more hosts takes the long form.
WIDE_HOSTS = 500


def wide_by_time(rows: DataFrame, hosts: list[str], columns: list[str], most: int = WIDE_HOSTS) -> DataFrame:
    """One row per time with a column per host and value, for a chart.

    The declared hosts come first, with or without rows; hosts only the data know follow by name. Their names are
    read before the table is built, as they become columns; more than ``most`` are refused.
    """
    others = [r["host"] for r in rows.select("host").distinct().filter(F.col("host").isNotNull() & ~F.col("host").isin(hosts)).orderBy("host").limit(most + 1).collect()]
    if len(hosts) + len(others) > most:
        raise ValueError(f"more than {most} hosts do not become columns")
    return rows.groupBy("ts_us").pivot("host", [*hosts, *others]).agg(*[F.first(c).alias(c) for c in columns])


def axis_domain(rows: DataFrame, columns: list[str], y_min: float | None = None,
                y_max: float | None = None) -> DataFrame:
    """Padded value axis over all columns: 10 % of the span, or a fallback for a flat line."""
    edge = rows.agg(F.min(F.least(*columns)).alias("lo"), F.max(F.greatest(*columns)).alias("hi"))
    pad = "if(hi - lo <> 0, (hi - lo) * 0.1D, greatest(0.05D, hi * 0.1D))"
    return edge.selectExpr(
        "lo", "hi",
        f"{float(y_min)!r}D AS y_min" if y_min is not None else f"greatest(0D, lo - {pad}) AS y_min",
        f"{float(y_max)!r}D AS y_max" if y_max is not None else f"hi + {pad} AS y_max",
    )

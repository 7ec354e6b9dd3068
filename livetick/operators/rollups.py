"""Reductions: per host, over a trailing window, per bucket, latest and edge rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from livetick.functions.timecols import duration_us, grid, grid_start
from livetick.operators.grid import steps
from livetick.operators.ranks import middles
from livetick.operators.sliding import sliding_moments
from livetick.sources.tables import latest


def interval(duration: str | int) -> Column:
    return F.make_dt_interval(secs=F.lit(duration_us(duration) / 1_000_000))


def tail(events: DataFrame, window: str | int) -> DataFrame:
    """Events of (max(ts) - window, max(ts)]. The bound is a scalar, so it reaches the file scan."""
    return events.filter(F.col("ts") > latest(events) - interval(window))


def reduce_by(df: DataFrame, keys: list[str], **outputs: tuple[str, str]) -> DataFrame:
    """Several named reductions in one pass: ``name=(column, reducer)``.

    Reducers: avg, stdev, count, sum, min, max, keep (the value if all agree, else null), first and last (in order of
    ``seq``), unique (distinct values, ascending), top3 and the like (the largest values, descending), and samples (all
    values, ascending; for keys that bound a group, such as host and tick). Null values never count.
    """
    tops = {name: (col, int(fn[3:])) for name, (col, fn) in outputs.items() if fn.startswith("top")}
    plain = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[
        _REDUCERS[fn](F.col(col)).alias(name) for name, (col, fn) in outputs.items() if name not in tops])
    for i, (name, (col, n)) in enumerate(tops.items()):
        # Ranked before the shuffle as well, so a task sends at most n rows of a group.
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(col).desc()))
        best = df.filter(F.col(col).isNotNull()).select(*keys, col).withColumn("_rank", rank).filter(F.col("_rank") <= n)
        best = best.groupBy(*[F.col(k).alias(f"_{i}_{k}") for k in keys]).agg(F.sort_array(F.collect_list(col), asc=False).alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_{i}_{k}")) for k in keys]
        plain = plain.join(best, same, "left").withColumn(name, F.coalesce(name, F.array().cast(best.schema[name].dataType)))
    return plain.select(*keys, *outputs)


_REDUCERS = {
    "avg": F.avg,
    "stdev": F.stddev_pop,
    "count": F.count,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "keep": lambda c: F.when(F.min(c) == F.max(c), F.min(c)),
    "first": lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("seq"))),
    "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq"))),
    "unique": lambda c: F.sort_array(F.collect_set(c)),
    "samples": lambda c: F.sort_array(F.collect_list(c)),
}


def host_rollup(events: DataFrame) -> DataFrame:
    return reduce_by(
        events, ["host"],
        cpu_avg=("cpu", "avg"), cpu_sd=("cpu", "stdev"), n=("cpu", "count"),
        requests_sum=("requests", "sum"), cpu_min=("cpu", "min"), cpu_max=("cpu", "max"),
    )


def event_rate(events: DataFrame, window: str | int) -> DataFrame:
    """Events per second of the trailing window."""
    seconds = duration_us(window) / 1_000_000
    return tail(events, window).agg(
        F.count(F.lit(1)).alias("n_events"), (F.count(F.lit(1)) / seconds).alias("events_per_sec"),
    )


def bucket_counts(df: DataFrame, step: str | int, keys: list[str] | None = None) -> DataFrame:
    """Row counts per fixed bucket: begin, end and midpoint in microseconds."""
    width = duration_us(step)
    counts = df.groupBy(*(keys or []), F.expr(f"{grid_start('ts_us', width)} AS begin_us")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.selectExpr(
        *(keys or []), "begin_us", f"begin_us + {width}L AS end_us", f"begin_us + {width // 2}L AS mid_us", "n",
    )


def dense_bars(df: DataFrame, step: str | int, axis: DataFrame) -> DataFrame:
    """Every bar that touches the axis, with 0 where nothing fell; ``axis`` is one row (first_us, last_us)."""
    width = duration_us(step)
    # A bar that ends where the axis begins touches it.
    spans = axis.selectExpr(f"{grid('first_us - 1', width)} AS _low", f"{grid('last_us', width)} AS _high")
    spine = steps(spans, "_low", "_high", "_k").selectExpr(f"_k * {width}L AS begin_us")
    counts = bucket_counts(df, step).select("begin_us", "n")
    return spine.join(counts, "begin_us", "left").selectExpr(
        "begin_us", f"begin_us + {width}L AS end_us", f"begin_us + {width // 2}L AS mid_us", "coalesce(n, 0L) AS n")


def clip_bars(bars: DataFrame, first_us: Column, last_us: Column) -> DataFrame:
    """Bars that touch the visible axis [first, last]."""
    return bars.filter((F.col("end_us") >= first_us) & (F.col("begin_us") <= last_us))


def top_n(events: DataFrame, step: str | int, n: int) -> DataFrame:
    """Per host and bucket, the n largest values and the value all rows agree on, if any.

    The rank filter is applied before the shuffle as well, so each task sends at
    most n rows per group.
    """
    width = duration_us(step)
    rows = events.withColumn("k", F.expr(grid("ts_us", width)))
    by_value = Window.partitionBy("host", "k").orderBy(F.col("cpu").desc(), F.col("seq"))
    top = (
        rows.withColumn("rn", F.row_number().over(by_value)).filter(F.col("rn") <= n)
        .groupBy("host", "k").agg(F.sort_array(F.collect_list("cpu"), asc=False).alias("top"))
    )
    kept = rows.groupBy("host", "k").agg(
        F.when(F.min("cpu") == F.max("cpu"), F.min("cpu")).alias("cpu_keep"), F.count("cpu").alias("n"),
    )
    return kept.join(top, ["host", "k"], "left").withColumn("ts_us", F.col("k") * width).drop("k")


def latest_per(df: DataFrame, keys: list[str], order: str = "ts_us") -> DataFrame:
    """The newest row of each key; keys missing from recent frames keep their old row."""
    # One struct, so that a tie of `order` never mixes two rows.
    rest = [c for c in df.columns if c not in (*keys, order)]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), order).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in (order, *rest)])


def edges(events: DataFrame, at: int) -> DataFrame:
    """Per host: first, last and the row at position ``at`` (0-based), in arrival order."""
    ends = events.groupBy("host").agg(*[F.expr(e) for e in (
        "min(seq) AS first_seq", "min_by(cpu, seq) AS first_cpu", "max(seq) AS last_seq", "max_by(cpu, seq) AS last_cpu",
    )])
    in_order = Window.partitionBy("host").orderBy("seq")
    nth = (
        events.withColumn("rn", F.row_number().over(in_order)).filter(F.col("rn") <= at + 1)
        .filter(F.col("rn") == at + 1).select("host", F.col("seq").alias("at_seq"), F.col("cpu").alias("at_cpu"))
    )
    return ends.join(nth, "host", "left")


def newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The top n rows of an order; Spark keeps n rows per task and merges those."""
    return df.orderBy(*order).limit(n)


def weighted_rollup(ticks: DataFrame, tick: str | int, window: str | int) -> DataFrame:
    """Trailing mean of tick means, weighted by their sample counts."""
    step = duration_us(tick)
    parts = ticks.filter("cpu_n > 0").selectExpr(
        "host", f"{grid('ts_us', step)} AS k", "cpu_n AS n", "cpu_avg AS mean", "0D AS m2",
    )
    rolled = sliding_moments(parts, ["host"], duration_us(window) // step, filled_only=True)
    return rolled.selectExpr(f"k * {step}L AS ts_us", "host", "mean AS weighted_avg", "n AS weight")


def page_summary(events: DataFrame, retain: str | int, rate_window: str | int) -> DataFrame:
    """Retained rows, hosts seen, event rate and evicted rows, from one pass."""
    end = latest(events)
    seconds = duration_us(rate_window) / 1_000_000
    kept = F.col("ts") > end - interval(retain)
    return events.select("host", kept.alias("kept"), (F.col("ts") > end - interval(rate_window)).alias("recent")) \
        .groupBy("host").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"), F.count_if("recent").alias("r"),
        ).agg(
            F.sum("k").alias("retained"),
            F.count_if(F.col("k") > 0).alias("hosts"),
            (F.sum("r") / seconds).alias("events_per_sec"),
            (F.sum("n") - F.sum("k")).alias("evicted"),
        )


__all__ = [
    "tail", "reduce_by", "host_rollup", "event_rate", "bucket_counts", "clip_bars", "top_n", "latest_per",
    "edges", "newest", "weighted_rollup", "page_summary", "interval", "middles",
]

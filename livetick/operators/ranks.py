"""Exact order statistics of keys of any size.

Equal values are counted before anything is ordered. Distinct values are cut into chunks at approximate quantiles of the
whole table, so a chunk holds about the same share of all rows whatever the values look like; counts per key and chunk
say which chunks hold the wanted ranks of a key, and only those are scanned. The cuts decide the size of chunks alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Chunks of the whole table; a task scans about one in so many of the rows.
CHUNKS = 256


def borders(df: DataFrame, column: str, chunks: int = CHUNKS) -> Column:
    """Ascending values at approximate quantiles of a column, as a scalar array of arrays; null for an empty table.

    The inner arrays have about the square root of all values each, so that a value finds its place in two short steps.
    """
    wide = math.isqrt(chunks - 1) + 1
    cuts = df.agg(F.array_distinct(F.percentile_approx(column, [i / chunks for i in range(1, chunks)], 20 * chunks)).alias("c"))
    return cuts.select(F.expr(f"transform(sequence(0, (size(c) - 1) div {wide}), i -> slice(c, i * {wide} + 1, {wide}))")).scalar()


def with_chunk(df: DataFrame, column: str, cuts: Column, name: str = "_chunk") -> DataFrame:
    """Number the chunk of each row: how many of the ascending cuts lie below its value; it never falls along the column."""
    # The last inner array that begins below the value holds the last cut below it.
    return df.withColumn("_cuts", cuts).withColumn("_at", F.expr(f"size(filter(_cuts, b -> b[0] < {column}))")).withColumn(
        name, F.expr(f"coalesce(if(_at <= 0, 0, (_at - 1) * size(_cuts[0]) + size(filter(get(_cuts, _at - 1), b -> b < {column}))), 0)")).drop("_cuts", "_at")


def _same(names: list[str]) -> Column:
    met = F.lit(True)
    for name in names:
        met = met & F.col(name).eqNullSafe(F.col(f"_w_{name}"))
    return met


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, str], chunks: int = CHUNKS) -> DataFrame:
    """Per key the number of values ``n`` and, for each named rank, the value at that 0-based place in ascending order.

    A rank is SQL over ``n`` and is kept within 0 and n - 1. Null values do not count; keys without others are absent.
    """
    known = df.filter(F.col(value).isNotNull())
    counts = with_chunk(known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), value, borders(known, value, chunks))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_t")).withColumns(
        {"_before": F.coalesce(F.sum("_t").over(before), F.lit(0)), "n": F.sum("_t").over(by_key)})
    places = ", ".join(f"struct('{name}' AS name, bigint(greatest(0L, least(n - 1, {rank}))) AS place)" for name, rank in ranks.items())
    wanted = totals.selectExpr("*", f"filter(array({places}), r -> r.place >= _before AND r.place < _before + _t) AS _ranks").filter(
        "size(_ranks) > 0").selectExpr(*[f"{k} AS _w_{k}" for k in keys], "_chunk AS _w__chunk", "_before", "n", "_ranks")
    near = counts.join(wanted, _same([*keys, "_chunk"]))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_chunk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("_upto", upto).select(
        *keys, "n", value, F.expr("explode(filter(_ranks, r -> r.place < _upto AND r.place >= _upto - _n)) AS r"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("r.name") == name, F.col(value))).alias(name) for name in ranks])


def floor_percentiles(df: DataFrame, keys: list[str], value: str, percents: list[int], chunks: int = CHUNKS) -> DataFrame:
    """Exact order statistic sorted[min(n - 1, floor(n * p / 100))], no interpolation, as p50 and so on."""
    return order_statistics(df, keys, value, {f"p{p}": f"n * {p} div 100" for p in percents}, chunks)


def middles(df: DataFrame, key: str, value: str, chunks: int = CHUNKS) -> DataFrame:
    """(key, mid, low, high, n): exact median (mean of the two middle values), least and greatest value, rows per key.

    Null values count as rows only.
    """
    mids = order_statistics(df, [key], value, {"lo": "(n - 1) div 2", "hi": "n div 2"}, chunks).selectExpr(
        f"{key} AS _key", "(lo + hi) / 2 AS mid")
    facts = df.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
    return facts.join(mids, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "mid", "low", "high", "n")


def dense_ranks(df: DataFrame, value: str, name: str, chunks: int = CHUNKS) -> DataFrame:
    """(value, rank): each distinct value and its 0-based place among them, without one task sorting them all."""
    distinct = df.filter(F.col(value).isNotNull()).select(value).distinct()
    rows = with_chunk(distinct, value, borders(distinct, value, chunks))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_c")).select("_chunk", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_chunk").orderBy(value)) - 1
    return rows.withColumn("_own", own).join(ahead, "_chunk").select(value, (F.col("_own") + F.col("_ahead")).alias(name))

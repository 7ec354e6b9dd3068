"""Inputs of the registered queries: bound tables and tables Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from livetick.functions.timecols import duration_us, grid
from livetick.operators.ticks import host_ticks
from livetick.plans import settings as S
from livetick.sources.tables import host_dimension, read_events


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_ticks(read_events(spark, sf_dir), S.TICK, S.BASE, places=S.PLACES)


def axis(events: DataFrame) -> DataFrame:
    """The visible axis: one row with its ends."""
    width = duration_us(S.VIEW)
    return events.agg((F.max("ts_us") - width).alias("first_us"), F.max("ts_us").alias("last_us"))


def hosts(spark: SparkSession) -> DataFrame:
    return host_dimension(spark, S.HOSTS)


def disabled(spark: SparkSession) -> DataFrame:
    return host_dimension(spark, S.DISABLED)


def arrivals(events: DataFrame) -> DataFrame:
    """Every event, keyed by host and day, so that keys collide."""
    return events.selectExpr("host", f"{grid('ts_us', 86_400_000_000)} AS day", "seq", "ts_us AS at_us", "cpu")


def emissions(events: DataFrame) -> DataFrame:
    """Events leave with their ingest batch, at its last event; outsized values are held back."""
    batch = F.expr(grid("seq", S.BATCH_ROWS))
    ends = events.groupBy(batch.alias("batch")).agg(F.max("ts_us").alias("end_us"))
    sent = arrivals(events).filter(f"cpu <= {S.HELD_BACK}").withColumn("batch", batch)
    return sent.join(ends, "batch").selectExpr("host", "day", "seq", "end_us AS at_us")

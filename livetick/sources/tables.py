"""Event tables: a column binding turns any timestamped table into the event shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from livetick.functions.timecols import micros


@dataclass(frozen=True)
class Binding:
    """SQL expressions that name the event columns of a source table."""

    ts: str
    host: str
    cpu: str
    requests: str
    seq: str | None = None


# The provided event stream: the type plays the host, the id is the arrival order.
EVENTS = Binding(
    ts="ts", host="event_type", cpu="value",
    requests="try_cast(get_json_object(props, '$.k') as bigint)", seq="event_id",
)
# Line items shipped per day; no unique arrival id, so order-free operators only.
LINEITEM = Binding(
    ts="l_shipdate", host="l_returnflag", cpu="l_quantity", requests="cast(l_linenumber as bigint)",
)


def bind(df: DataFrame, binding: Binding) -> DataFrame:
    """Project a table to ``seq?, ts, ts_us, host, cpu, requests``.

    ``ts`` stays as stored, so that time filters reach the file scan.
    """
    return df.selectExpr(
        *([] if binding.seq is None else [f"cast({binding.seq} AS bigint) AS seq"]),
        f"{binding.ts} AS ts", f"{micros(binding.ts)} AS ts_us", f"{binding.host} AS host",
        f"cast({binding.cpu} AS double) AS cpu", f"{binding.requests} AS requests",
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet",
               **options: str) -> DataFrame:
    """Scan parquet, JSON or CSV; with a schema nothing is inferred."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark.read.parquet(f"{sf_dir}/events.parquet"), EVENTS)


def read_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), LINEITEM)


def static_series(spark: SparkSession, rows: list[tuple[int, float]]) -> DataFrame:
    """A fixed reference series such as a threshold line: (time_ms, value) rows."""
    return spark.createDataFrame(rows, "ts_ms bigint, value double")


def write_ticks(ticks: DataFrame, path: str, mode: str = "append") -> None:
    """Keep a tick table by day, so that every chart reads it instead of the events.

    Rows are spread by day and time within the day, which gives each day a few files of even size.
    """
    dated = ticks.selectExpr("*", "to_date(timestamp_micros(ts_us)) AS day")
    dated.repartitionByRange("day", "ts_us").write.mode(mode).partitionBy("day").parquet(path)


def read_ticks(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """A kept tick table; days outside the bounds are not listed or read."""
    ticks = spark.read.parquet(path)
    if first_day is not None:
        ticks = ticks.filter(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        ticks = ticks.filter(F.col("day") <= F.lit(last_day).cast("date"))
    return ticks.drop("day")


def from_points(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Derived points as a typed series: columns in schema order, cast to its types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def to_points(df: DataFrame, ts: str, *cols: str) -> DataFrame:
    """Rows ordered by time, for a consumer that reads them in order."""
    return df.select(ts, *cols).orderBy(ts)


def host_dimension(spark: SparkSession, hosts: list[str]) -> DataFrame:
    """The declared hosts with their rank; deploy-time configuration, a handful of rows."""
    return spark.createDataFrame(list(zip(hosts, range(1, len(hosts) + 1))), "host string, rank int")


def latest(df: DataFrame, ts: str | Column = "ts") -> Column:
    """max(ts) as a scalar subquery: one value, evaluated once, usable in any filter."""
    return df.agg(F.max(ts)).scalar()

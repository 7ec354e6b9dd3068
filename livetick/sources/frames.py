"""Event batches and JSON frames, as tables of batches and of frame texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from livetick.functions.timecols import grid, to_ms
from livetick.schema import DEFAULT_THRESHOLDS, HOST_TICK, WIRE_EVENT

# The frame types of the two streams.
RAW_TYPES = ("snapshot", "append")
AGGREGATE_TYPES = ("aggregate-snapshot", "aggregate-append")


def _wire_event() -> Column:
    return F.expr(f"struct({to_ms('ts_us')} AS time_ms, cpu, requests, host)")


def event_batches(events: DataFrame, batch_rows: int = 1_000) -> DataFrame:
    """Consecutive arrivals as ``batch_id, events``; a batch holds at most ``batch_rows`` events."""
    return events.groupBy(F.expr(grid("seq", batch_rows)).alias("batch_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", _wire_event().alias("event")))),
            lambda r: r["event"],
        ).alias("events")
    )


def unpack_batches(batches: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Batches to rows with a real timestamp; an empty batch adds none."""
    return batches.select(*(keep or []), F.inline("events")).withColumn("time", F.timestamp_millis("time_ms"))


def frame_text(kind: str, rows: Column, thresholds: Column | None = None) -> Column:
    parts = [F.lit(kind).alias("type")]
    if thresholds is not None:
        parts.append(thresholds.alias("thresholds"))
    return F.to_json(F.struct(*parts, rows.alias("rows")))


def append_frames(batches: DataFrame) -> DataFrame:
    """One append frame per ingest batch."""
    return batches.select("batch_id", frame_text("append", F.col("events")).alias("frame"))


def snapshot_frames(events: DataFrame, frame_rows: int = 10_000) -> DataFrame:
    """The given rows as snapshot frames of at most ``frame_rows`` events each."""
    return event_batches(events, frame_rows).select(
        F.col("batch_id").alias("part"), frame_text("snapshot", F.col("events")).alias("frame"),
    )


def _wire_tick() -> Column:
    return F.struct(
        F.expr(to_ms("ts_us")).alias("ts"),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in HOST_TICK.fields[1:]],
    )


#: Hosts of one aggregate frame; a boundary with more of them has several frames.
FRAME_HOSTS = 1_000


def _with_part(ticks: DataFrame, hosts_each: int) -> DataFrame:
    """Deal the hosts of each boundary to parts of about ``hosts_each``, by the number of all hosts."""
    parts = ticks.agg(F.expr(f"greatest(1L, bigint(ceil(count(DISTINCT host) / {hosts_each}D)))")).scalar()
    return ticks.withColumn("part", F.pmod(F.xxhash64("host"), parts))


def aggregate_frames(ticks: DataFrame, hosts_each: int = FRAME_HOSTS) -> DataFrame:
    """Frames of each tick boundary, their rows one per host in name order; about ``hosts_each`` hosts a frame."""
    return _with_part(ticks, hosts_each).groupBy("ts_us", "part").agg(
        F.array_sort(F.collect_list(F.struct("host", _wire_tick().alias("row")))).alias("_rows")
    ).select(
        "ts_us",
        F.size("_rows").cast("bigint").alias("n_rows"),
        frame_text("aggregate-append", F.transform("_rows", lambda r: r["row"])).alias("frame"),
    )


def aggregate_snapshot(history: DataFrame, thresholds: tuple[float, ...] = DEFAULT_THRESHOLDS, hosts_each: int = FRAME_HOSTS) -> DataFrame:
    """Snapshot frames of a tick history, by boundary and part of the hosts, each with the threshold list."""
    at = F.array(*[F.lit(t) for t in thresholds])
    return _with_part(history, hosts_each).groupBy("ts_us", "part").agg(
        F.array_sort(F.collect_list(F.struct("host", _wire_tick().alias("row")))).alias("_rows")
    ).select(
        "ts_us", frame_text("aggregate-snapshot", F.transform("_rows", lambda r: r["row"]), at).alias("frame"),
    )


def empty_aggregate_snapshot(spark: SparkSession, thresholds: tuple[float, ...] = DEFAULT_THRESHOLDS) -> DataFrame:
    """The first frame of an aggregate subscriber without history: the thresholds and no rows."""
    at = F.array(*[F.lit(t) for t in thresholds])
    return spark.range(1).select(frame_text("aggregate-snapshot", F.array(), at).alias("frame"))


def _frame_schema(row: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("thresholds", T.ArrayType(T.DoubleType())),
        T.StructField("rows", T.ArrayType(row)),
    ])


def _decode(frames: DataFrame, row: T.StructType, types: tuple[str, ...]) -> DataFrame:
    parsed = frames.select(F.from_json("frame", _frame_schema(row)).alias("f"))
    return parsed.filter(F.col("f.type").isin(*types)).select(F.col("f.type").alias("type"), F.inline("f.rows"))


def decode_events(frames: DataFrame) -> DataFrame:
    """Rows of raw frames in schema order; frames of any other type are ignored."""
    return _decode(frames, WIRE_EVENT, RAW_TYPES)


def decode_ticks(frames: DataFrame) -> DataFrame:
    """Rows of aggregate frames in schema order, nulls kept; other frames are ignored."""
    return _decode(frames, HOST_TICK, AGGREGATE_TYPES)


def write_frames(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Frames as text lines, one message per line, in as many files as there are tasks."""
    frames.select("frame").write.mode(mode).text(path)

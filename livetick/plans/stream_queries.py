"""Streaming runs over the event table: each takes all that is there, then stops."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from livetick.plans import inputs, settings as S
from livetick.plans.shape import flat, num
from livetick.session import shared_dir
from livetick.sources import frames
from livetick.sources.tables import EVENTS, read_events
from livetick.streaming import sinks, state
from livetick.streaming.sources import bind_stream, file_stream, table_stream
from livetick.streaming.ticks import stream_host_ticks as stream_ticks

DELAY = "10 minutes"
#: Files a micro-batch takes. Files must be in time order: what is older than the watermark of earlier ones is late.
FILES_PER_TRIGGER = 64


def _events(spark: SparkSession, sf_dir: str, delay: str = DELAY) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return bind_stream(table_stream(spark, f"{sf_dir}/events.parquet", schema, FILES_PER_TRIGGER), EVENTS, delay)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def stream_host_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "ticks")
    ticks = stream_ticks(lambda: _events(spark, sf_dir), S.TICK, S.BASE, salts=2)
    sinks.to_files(ticks, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(ticks.schema).parquet(f"{out}/rows").selectExpr(
        "unix_millis(ts) AS ts_ms", "host", num("cpu_avg"), num("cpu_sd"), "cpu_n", "n_current",
        flat("anomalies_above"), flat("anomalies_below"),
    )


def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "frames")
    events = _events(spark, sf_dir)
    sinks.to_append_frames(events, f"{out}/frames", f"{out}/checkpoint", S.BATCH_ROWS).awaitTermination()
    written = spark.read.text(f"{out}/frames").select(F.col("value").alias("frame"))
    return frames.decode_events(written).select("type", "time_ms", "cpu", "requests", "host")


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stream is delivered twice; every event is kept once."""
    out = _folder(spark, "resume")
    merged = sinks.merge_resumed(_events(spark, sf_dir), _events(spark, sf_dir))
    sinks.to_files(merged, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(merged.schema).parquet(f"{out}/rows").selectExpr(
        "seq", "unix_millis(ts) AS ts_ms", "host", "cpu")


def stream_high_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable predicate on the stream itself; each event is looked at once."""
    out = _folder(spark, "high")
    high = _events(spark, sf_dir).filter(F.col("cpu") > S.HIGH)
    sinks.to_files(high, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(high.schema).parquet(f"{out}/rows").groupBy("host").agg(
        F.count(F.lit(1)).alias("alerts"))


def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept and evicted by a maximum age, summed over the eviction stream; the watermark is the newest event."""
    out = _folder(spark, "retention")
    moves = state.stream_retention(_events(spark, sf_dir, "0 seconds"), S.KEEP, S.BUCKET, salts=4)
    sinks.to_files(moves, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(moves.schema).parquet(f"{out}/rows").groupBy("host").agg(
        F.expr("sum(added) - sum(evicted) AS kept"), F.sum("evicted").alias("evicted"))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late filter on the stream, with the same displaced readings; rejected events are set aside."""
    out = _folder(spark, "late")
    shifted = _events(spark, sf_dir).selectExpr("*", f"seq * 2 + if(cpu > {S.HIGH}, 15, 0) AS arrival")
    sinks.reject_late(shifted, out, f"{out}/checkpoint", "arrival").awaitTermination()
    kinds = [spark.read.parquet(f"{out}/{kind}").selectExpr("seq", "unix_millis(ts) AS ts_ms", "host", f"{kind == 'rejected'} AS rejected")
             for kind in ("accepted", "rejected")]
    return kinds[0].unionByName(kinds[1])


def stream_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals and emissions as one stream of moves, paired as they come."""
    out = _folder(spark, "fifo")
    events = read_events(spark, sf_dir)
    sides = [side.selectExpr("host", "day", "seq", "at_us", f"{emitted} AS emitted", "timestamp_micros(at_us) AS ts")
             for side, emitted in ((inputs.arrivals(events), "false"), (inputs.emissions(events), "true"))]
    moves = sides[0].unionByName(sides[1])
    moves.write.parquet(f"{out}/moves")
    stream = file_stream(spark, f"{out}/moves", moves.schema).withWatermark("ts", DELAY)
    pairs = state.stream_fifo(stream, {"host": "string", "day": "bigint"}, S.KEEP)
    sinks.to_files(pairs, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(pairs.schema).parquet(f"{out}/rows").filter("emit_seq IS NOT NULL")


def stream_global_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "global")
    ticks = state.stream_global_ticks(_events(spark, sf_dir, "0 seconds"), S.TICK, S.KEEP)
    sinks.to_files(ticks, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.schema(ticks.schema).parquet(f"{out}/rows")
    return rows.selectExpr("(unix_micros(at) + 1) div 1000L AS ts_ms", "events_ingested_total", num("n / 3600D", "events_per_sec"), "evicted_total")


def stream_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscriber joins half-way: committed history up to a number, then what follows; host and global ticks, each once."""
    out, kinds = _folder(spark, "backfill"), []
    hosts = stream_ticks(lambda: _events(spark, sf_dir), S.TICK, S.BASE, salts=2).selectExpr(
        "unix_millis(ts) AS ts_ms", "host", "cpu_n", "n_current", flat("anomalies_above"), flat("anomalies_below"),
        "CAST(NULL AS bigint) AS events_ingested_total")
    clock = state.stream_global_ticks(_events(spark, sf_dir), S.TICK, S.KEEP).selectExpr(
        "(unix_micros(at) + 1) div 1000L AS ts_ms", "CAST(NULL AS string) AS host", "CAST(NULL AS bigint) AS cpu_n", "CAST(NULL AS bigint) AS n_current",
        "CAST(NULL AS string) AS anomalies_above", "CAST(NULL AS string) AS anomalies_below", "events_ingested_total")
    for name, ticks in (("host", hosts), ("global", clock)):
        sinks.to_history(ticks, f"{out}/{name}", f"{out}/{name}-checkpoint").awaitTermination()
        newest = spark.read.parquet(f"{out}/{name}").agg(F.coalesce(F.max("micro_batch"), F.lit(0))).first()[0]
        history, appended = sinks.handover(spark, f"{out}/{name}", ticks.schema, newest // 2)
        kinds.append(history.unionByName(appended).selectExpr(f"'{name}' AS kind", "*"))
    return kinds[0].unionByName(kinds[1])


def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each host, upserted into a snapshot table."""
    out = _folder(spark, "snapshot")
    sinks.snapshots(_events(spark, sf_dir), out, f"{out}-checkpoint", ["host"], ["ts", "seq"]).awaitTermination()
    return sinks.newest_snapshot(spark, out).selectExpr("host", "seq", "unix_millis(ts) AS ts_ms", "cpu", "requests")

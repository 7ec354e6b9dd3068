"""Starting streams: files, frames per micro-batch, observers, resumed deliveries, committed history, snapshots.

What a micro-batch writes goes to a folder named after its number, which a retried one replaces. So every number is
there once and in order, and readers can be told to take it up to or from a number on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from livetick.operators.ordering import late_tagged
from livetick.sources.frames import append_frames, event_batches, write_frames
from livetick.streaming.sources import configure_state


_PARTITIONS = "spark.sql.shuffle.partitions"


def _start(spark: SparkSession, writer, checkpoint: str, every: str | None,
           state_partitions: int | None = None) -> StreamingQuery:
    """Start with at most one micro-batch per interval; None takes all that is there and stops.

    State partitions are fixed in the checkpoint at the first start. ``state_partitions`` sets
    them for this stream alone; None leaves them to ``spark.sql.shuffle.partitions``.
    """
    configure_state(spark)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    if state_partitions is None:
        return writer.start()
    configured = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(_PARTITIONS, configured)


def to_files(stream: DataFrame, path: str, checkpoint: str, every: str | None = None,
             state_partitions: int | None = None) -> StreamingQuery:
    """Append results as parquet; a restart with the same checkpoint neither loses nor repeats a row."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return _start(stream.sparkSession, writer, checkpoint, every, state_partitions)


def observe(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str,
            every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Call an observer with each micro-batch."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(callback)
    return _start(stream.sparkSession, writer, checkpoint, every)


def to_append_frames(stream: DataFrame, path: str, checkpoint: str, batch_rows: int = 1_000,
                     every: str | None = None) -> StreamingQuery:
    """Append frames of each micro-batch as text lines, in a folder per micro-batch.

    A retried micro-batch replaces its own folder, so no frame is written twice.
    """
    def emit(batch: DataFrame, batch_id: int) -> None:
        events = batch.selectExpr("seq", "unix_micros(ts) AS ts_us", "cpu", "requests", "host")
        write_frames(append_frames(event_batches(events, batch_rows)), f"{path}/micro_batch={batch_id}", "overwrite")

    return observe(stream, emit, checkpoint, every)


def merge_resumed(snapshot: DataFrame, appended: DataFrame, id_col: str = "seq") -> DataFrame:
    """A re-delivered stream after a snapshot, each event once while within the watermark."""
    return snapshot.unionByName(appended).dropDuplicatesWithinWatermark([id_col])


# --- committed history ---------------------------------------------------------------------------------------


def to_history(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Rows of each micro-batch under its number, for subscribers that come late."""
    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_id}")

    return observe(stream, commit, checkpoint, every)


def handover(spark: SparkSession, path: str, schema: StructType, number: int) -> tuple[DataFrame, DataFrame]:
    """What a subscriber that joins after micro-batch ``number`` receives: the history up to it, and all that follows.

    The same committed folders serve both, so no row is in both and none is left out.
    """
    rows = spark.read.schema(StructType([*schema.fields, StructField("micro_batch", LongType())])).parquet(path)
    return rows.filter(F.col("micro_batch") <= number).drop("micro_batch"), rows.filter(F.col("micro_batch") > number).drop("micro_batch")


# --- strict rejection of late events ------------------------------------------------------------------------


def reject_late(stream: DataFrame, path: str, checkpoint: str, arrival: str, every: str | None = None) -> StreamingQuery:
    """Accepted and rejected events under ``path``, strictly by the newest event that arrived before each.

    The watermark only knows the newest event of earlier micro-batches. Here the events of a micro-batch are scanned
    in order of arrival, in chunks, starting from the newest one before it, which each micro-batch leaves behind.
    """
    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/newest/micro_batch={batch_id - 1}").first()[0] if batch_id else None
        rows = batch.withColumn("ts_us", F.expr("unix_micros(ts)")).persist()
        try:
            tagged = late_tagged(rows, arrival, newest=before)
            for name, late in (("accepted", False), ("rejected", True)):
                tagged.filter(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{path}/{name}/micro_batch={batch_id}")
            newest = rows.agg(F.max("ts_us")).withColumn("before", F.lit(before).cast("bigint"))
            newest.selectExpr("greatest(`max(ts_us)`, before) AS newest").write.mode("overwrite").parquet(f"{path}/newest/micro_batch={batch_id}")
        finally:
            rows.unpersist()

    return observe(stream, emit, checkpoint, every)


# --- throttled snapshots ------------------------------------------------------------------------------------


def snapshots(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], every: str | None = None,
              keep: int = 2) -> StreamingQuery:
    """The newest row of each key as a whole table, written at most once per interval.

    The state store holds the newest row of each key. A micro-batch brings the keys that changed since the one before,
    which replace theirs in its snapshot; the ``keep`` newest snapshots stay. Readers take `newest_snapshot`.
    """
    columns = [c for c in stream.columns if c not in keys]
    latest = stream.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(*keys, "row.*")

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark, target, own = batch.sparkSession, f"{path}/snapshot={batch_id}", f"{path}/changes={batch_id}"
        if batch_id:
            batch.write.mode("overwrite").parquet(own)
            changed, held = (spark.read.schema(batch.schema).parquet(p) for p in (own, f"{path}/snapshot={batch_id - 1}"))
            held.join(changed.select(*keys), keys, "left_anti").select(*changed.columns).unionByName(changed).write.mode("overwrite").parquet(target)
            _drop(spark, own)
        else:
            batch.write.mode("overwrite").parquet(target)
        _drop(spark, f"{path}/snapshot={batch_id - keep}")

    return observe(latest, emit, checkpoint, every, "update")


def _place(spark: SparkSession, path: str):
    """A path and its file system, whatever the store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _drop(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.delete(place, True)


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest committed snapshot under ``path``; it stays for as many intervals as snapshots are kept."""
    place, system = _place(spark, path)
    done = [f.getPath() for f in system.globStatus(_place(spark, f"{path}/snapshot=*/_SUCCESS")[0])]
    newest = max(int(p.getParent().getName().partition("=")[2]) for p in done)
    return spark.read.parquet(f"{path}/snapshot={newest}")

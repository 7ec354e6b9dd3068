"""Streaming event sources, bound to the same columns as the batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from livetick.schema import EVENT_BATCH
from livetick.sources.frames import unpack_batches
from livetick.sources.tables import Binding

# Large keyed state lives on disk and is checkpointed as changes, not as full copies.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure_state(spark: SparkSession) -> None:
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)


def bind_stream(raw: DataFrame, binding: Binding, delay: str) -> DataFrame:
    """The event shape with a watermark on ``ts``; events older than it are rejected."""
    return raw.selectExpr(
        *([] if binding.seq is None else [f"cast({binding.seq} AS bigint) AS seq"]),
        f"cast({binding.ts} AS timestamp) AS ts", f"{binding.host} AS host",
        f"cast({binding.cpu} AS double) AS cpu", f"{binding.requests} AS requests",
    ).withWatermark("ts", delay)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """Files of a folder as they appear; no new file, no output."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a table stored as one file or as a folder of part files, in order of their time stamps."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(place).isDirectory():
        return file_stream(spark, path, schema, files_per_trigger=files_per_trigger)
    return file_stream(spark, str(place.getParent()), schema, files_per_trigger=files_per_trigger, pathGlobFilter=place.getName())


def kafka_batches(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """JSON event batches from a Kafka topic, one row per event (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    parsed = raw.select(F.from_json(F.col("value").cast("string"), EVENT_BATCH).alias("batch"))
    return unpack_batches(parsed.select("batch.events"))

"""Helpers that several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from livetick.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of ids and numbers are far smaller than those of texts; they are kept in a fourth of the partitions,
#: which saves files in every checkpoint and shuffle that follows.
NARROW = 4


def narrow(df: DataFrame) -> DataFrame:
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // NARROW))


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def sampled(df: DataFrame, size: int, *by: str) -> DataFrame:
    """At most `size` rows, those first by a hash of the columns `by`.

    The count of all rows sets a share that about twice as many rows pass, so that no task sends more than its part
    of those to the driver, whatever the number of tasks.
    """
    at, rows = F.xxhash64(*by), max(1, df.count())
    early = df.withColumn("_first", F.pmod(at, F.lit(rows))).where(F.col("_first") < 2 * size)
    return early.orderBy("_first", *by).limit(size).drop("_first")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; a table written there is kept until the folder is cleared."""
    return f"{shared_dir(spark).rstrip('/')}/livetick-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def agreed_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of ids whose rows all carry one label, 0 or 1."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    low_high = known.groupBy("doc_id").agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
    return low_high.where("_low = _high").select("doc_id", F.col("_low").cast("int").alias("label"))


# --- hashes of byte runs ------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z to a-z in every byte; bytes of other characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that part words: blank and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown on demand up to the longest text of a task."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every run of bytes between blanks; equal runs have equal hashes."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    solid = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False]))))
    start, end = edge[::2], edge[1::2]
    up, down = powers.of(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def lower_bytes(text: str | None) -> np.ndarray:
    return LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]


def batches(frames: Iterator, rows: int) -> Iterator:
    """Pieces of at most `rows` rows of the pandas frames of a task."""
    for pdf in frames:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]

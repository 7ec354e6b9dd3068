"""Token ids in directly addressable codes.

An id is split into chunks of `CHUNK` bits. Level 0 holds the lowest chunk of every id; a bitmap marks the ids that go
on, and level 1 holds the next chunk of just those, and so on. A rank directory counts the marks before every block of
`BLOCK` places, so that the place of an id's next chunk, and with it any single id, is found without decoding others.

A segment holds whole documents: a header, their ids and borders, and the levels. Segments of a bounded number of
tokens (one document at least) are written by Spark as a Parquet table with one segment a row, in ascending order of
doc_id, which keeps task retries and lost executors harmless: only committed files are read.

Results for odd rows: a null or empty text is a document with the end id alone; rows with a null doc_id come first;
repeated rows are kept, next to each other, equal ids in order of their texts; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livetick.llm.common import table, work_path
from livetick.llm.words import byte_level_cache, pieces

MODEL, END = "byte_bpe_50k.json", 0
CHUNK, BLOCK = 8, 512
SEGMENT_TOKENS = 1 << 18
_HEAD = struct.Struct("<4sHHQQ")  # magic, levels, flags (0), documents, tokens
_MAGIC = b"DAC1"
_SEGMENTS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("nulls", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


class CachedEncoder:
    """Ids of the tokenizers library, remembered by word."""

    def __init__(self, path: str) -> None:
        self.cache = byte_level_cache(path, open_start=True)

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        found = self.cache.encode(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()))
        return np.split(found.ids, np.cumsum(found.lengths)[:-1])


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> CachedEncoder:
    """One encoder for all tasks of a worker process, so that a task starts with the words of those before it."""
    return CachedEncoder(path)


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: documents, how many tokens each has, and the tokens."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK > 0
        levels.append((rest & ((1 << CHUNK) - 1), more))
        if not more.any():
            break
        rest = rest[more] >> CHUNK
    out = [_HEAD.pack(_MAGIC, len(levels), 0, len(doc_ids), len(ids)),
           doc_ids.astype("<i8").tobytes(), np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes()]
    for chunk, more in levels:
        marks = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0)
        ranks = np.concatenate(([0], np.cumsum(marks)))[: len(marks)]
        out += [struct.pack("<Q", len(chunk)), ranks.astype("<u4").tobytes(), np.packbits(more).tobytes(), chunk.astype("<u1").tobytes()]
    return b"".join(out)


class Segment:
    """A packed segment, read in place."""

    def __init__(self, data: bytes) -> None:
        magic, levels, _, docs, self.tokens = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 16 * docs + 8
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // BLOCK)
            at += 8
            ranks = np.frombuffer(data, "<u4", blocks, at)
            bits = np.frombuffer(data, "<u1", -(-n // 8), at + 4 * blocks)
            chunks = np.frombuffer(data, "<u1", n, at + 4 * blocks + len(bits))
            at += 4 * blocks + len(bits) + n
            self.levels.append((ranks, bits, chunks))

    def token(self, i: int) -> int:
        """The id at one place; reads one chunk a level and at most one block of marks."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for level, (ranks, bits, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << CHUNK * level
            if not bits[i >> 3] >> (7 - (i & 7)) & 1:
                break
            block = i // BLOCK
            i = int(ranks[block]) + int(np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1])[: i - block * BLOCK].sum())
        return value

    def all(self) -> np.ndarray:
        value, at = np.zeros(self.tokens, np.uint32), slice(None)
        places = np.arange(self.tokens)
        for level, (_, bits, chunks) in enumerate(self.levels):
            value[places[at]] |= chunks.astype(np.uint32) << np.uint32(CHUNK * level)
            places = places[at]
            at = np.unpackbits(bits, count=len(chunks)).astype(bool)
        return value

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, one place after the other."""
        return np.array([self.token(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode all documents and write their segments, ascending by doc_id over parts and segments."""

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        held, tokens, seq, part = [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            data = pack(np.array([h[0] or 0 for h in held], np.int64), np.array([len(h[1]) for h in held]),
                        np.concatenate([h[1] for h in held]))
            nulls = sum(h[0] is None for h in held)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "nulls": nulls, "n_tokens": tokens, "payload": data}], _SEGMENTS)

        for frame in frames:
            # Small pieces, so that the texts of a whole frame are not held twice.
            for piece in pieces(frame, 2):
                part = piece.column(0)[0].as_py()
                for number, ids in zip(piece.column(1).to_pylist(), encoder.encode(piece.column(2)), strict=True):
                    if held and tokens + len(ids) + 1 > segment_tokens:
                        yield segment()
                        held, tokens, seq = [], 0, seq + 1
                    held.append((number, np.append(ids, np.uint32(end))))
                    tokens += len(ids) + 1
        if held:
            yield segment()

    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "id", "text")
    ordered.mapInArrow(of, "part int, seq int, nulls int, n_tokens long, payload binary").write.parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, base): tokens before each segment. One window over the parts, then one within each part."""
    segments = spark.read.parquet(path).select("part", "seq", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("_ahead"))
    own = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("seq")), F.lit(0))
    return segments.withColumn("_own", own).join(parts, "part").select("part", "seq", (F.col("_own") + F.col("_ahead")).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the segments at `path`."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, seq, nulls, payload in zip(pdf["part"], pdf["seq"], pdf["nulls"], pdf["payload"], strict=True):
                segment = Segment(payload)
                ids = segment.all().astype("<u4")
                start, end = segment.starts[:-1], segment.starts[1:]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(start, end, strict=True)]
                doc_ids = pd.array(segment.doc_ids, dtype="Int64")
                doc_ids[:nulls] = pd.NA
                yield pd.DataFrame({"part": part, "seq": seq, "doc_id": doc_ids, "start": start,
                                    "n_tokens": end - start, "ids_crc32": crc})

    stored = spark.read.parquet(path).select("part", "seq", "nulls", "payload")
    docs = stored.mapInPandas(of, "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(index(spark, path), ["part", "seq"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op3_dac_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and describe each document as read back from them."""
    path = work_path(spark, "dac")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(MODEL))
    return read(spark, path)

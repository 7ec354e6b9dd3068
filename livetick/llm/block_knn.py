"""Nearest neighbours by block matrix products of quantised vectors.

Queries and candidates are packed into blocks, and every pair of a query block and a candidate block is one tile. A
tile multiplies 8-bit vectors (as whole numbers in single precision, which holds their products exactly) and adds
what rounding can have changed: |x.y - x'.y'| <= |x - x'| |y'| + |x| |y - y'| with the norms of both residuals known.
Pairs whose smallest possible distance is above the k-th smallest largest-possible distance of their query are out;
the others are computed in double precision. Heaps of k per query merge the tiles of a task, a ranked window the tasks.

The answer is exact. Work is queries times rows by the statement of the problem; blocks bound the memory of a tile, and
a candidate block is sent once per query block and a query block once per `GROUP` candidate blocks. Results for odd rows: vectors that are null, empty, zero or hold null
or non-finite components take no part, as do null ids; vectors of different lengths are never compared; ties go to
the smaller id; a repeated id is a candidate as often as it occurs, never its own; as a query it counts once per distinct vector; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livetick.llm.common import table

NEAREST, EVERY = 10, 100
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: Candidate blocks that meet a query block in one task.
GROUP = 8


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


#: Squares below and above these lose digits or are no number.
_SMALL, _LARGE = 1e-280, 1e300


class Block:
    """Vectors of one length with their 8-bit form and error norms."""

    @np.errstate(over="ignore", invalid="ignore")
    def __init__(self, ids: np.ndarray, data: np.ndarray) -> None:
        self.ids, self.x = ids, data
        peak = np.abs(data).max(1)
        scale = np.where(peak > 0, peak / 127, 1.0)
        self.codes = np.rint(data / scale[:, None]).astype(np.int8)
        near = self.codes * scale[:, None]
        self.scale = scale
        self.norm, self.near_norm = np.sqrt((data**2).sum(1)), np.sqrt((near**2).sum(1))
        self.lost = np.sqrt(((data - near) ** 2).sum(1))

    @staticmethod
    def unpack(ids: bytes, data: bytes) -> Block:
        numbers = np.frombuffer(ids, "<i8")
        return Block(numbers, np.frombuffer(data, "<f8").reshape(len(numbers), -1))


def bounds(q: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all squared distances of a tile."""
    # Products of 8-bit numbers stay below 2^24 for up to 1,040 components and are exact in single precision.
    kind = np.float32 if q.x.shape[1] <= 1040 else np.float64
    dot = (q.codes.astype(kind) @ c.codes.astype(kind).T).astype(float) * q.scale[:, None] * c.scale
    slack = q.lost[:, None] * c.near_norm + q.norm[:, None] * c.lost
    square = q.norm[:, None] ** 2 + c.norm**2
    room = 2 * slack + 1e-9 * square + _SMALL
    low, high = square - 2 * dot - room, square - 2 * dot + room
    # Squares beyond a double bound nothing; such pairs are computed.
    lost = ~(np.isfinite(low) & np.isfinite(high))
    low[lost], high[lost] = -np.inf, np.inf
    return low, high


def distances(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(square, distance) of rows to a vector. Squares out of a double's range are 0 or infinite, distances are not."""
    gap = x - q
    square = (gap**2).sum(1)
    far = np.sqrt(square)
    odd = (square < _SMALL) | (square > _LARGE)
    if odd.any():
        square[odd] = np.where(square[odd] < 1, 0.0, np.inf)
        peak = np.abs(gap[odd]).max(axis=1)
        unit = np.where((peak > 0) & np.isfinite(peak), peak, 1.0)
        far[odd] = np.where(np.isfinite(peak), unit * np.sqrt(((gap[odd] / unit[:, None]) ** 2).sum(1)), np.inf)
    return square, far


@np.errstate(over="ignore", invalid="ignore")
def tile(q: Block, c: Block, k: int, worst: np.ndarray) -> Iterator[tuple[int, tuple[float, float], int]]:
    """(row of the query, (square, distance), candidate id) of what may be among the k nearest; `worst` is known already."""
    low, high = bounds(q, c)
    own = q.ids[:, None] == c.ids
    high[own] = np.inf
    limit = worst if high.shape[1] < k else np.minimum(worst, np.partition(high, k - 1, axis=1)[:, k - 1])
    for i in range(len(q.ids)):
        near = np.flatnonzero((low[i] <= limit[i]) & ~own[i])
        square, far = distances(c.x[near], q.x[i])
        if len(near) > k:  # ties at the border go to the smaller id
            best = np.lexsort((c.ids[near], far, square))[:k]
            near, square, far = near[best], square[best], far[best]
        yield from zip([i] * len(near), zip(square.tolist(), far.tolist()), c.ids[near].tolist(), strict=True)


def packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """(dim, name, ids, data): the rows in so many blocks, dealt by place and id, so that repeated rows part; one row per
    block and length."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("vec_id")
        data = np.array(ordered["v"].tolist(), "<f8")
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], name: [int(pdf[name].iloc[0])],
                             "ids": [ordered["vec_id"].to_numpy("<i8").tobytes()], "data": [data.tobytes()]})

    keyed = rows.select("dim", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias(name), "vec_id", "v")
    return keyed.groupBy("dim", name).applyInPandas(pack, f"dim int, {name} int, ids binary, data binary")


def blocks_of(rows: int, block: int) -> int:
    return max(1, -(-rows // block))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates of every query by Euclidean distance."""
    rows, wanted = usable(vectors), usable(queries).dropDuplicates(["vec_id", "v"])
    many, few = blocks_of(rows.count(), CANDIDATE_BLOCK), blocks_of(wanted.count(), QUERY_BLOCK)
    groups = blocks_of(many, GROUP)
    candidates = packed(rows, many, "c").withColumn("g", F.col("c") % groups).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(few - 1))))
    asked = packed(wanted, few, "q").withColumnsRenamed({"ids": "q_ids", "data": "q_data"})
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, q, heaps = None, None, []

        def done() -> pd.DataFrame:
            rows = [(int(q.ids[i]), -number, -square, -far) for i, heap in enumerate(heaps) for square, far, number in heap]
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "square", "score"])

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                if at != (row.dim, row.q):
                    if q is not None:
                        yield done()
                    at, q = (row.dim, row.q), Block.unpack(row.q_ids, row.q_data)
                    heaps = [[] for _ in q.ids]
                worst = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps])
                for i, (square, far), number in tile(q, Block.unpack(row.ids, row.data), k, worst * (1 + 1e-12)):
                    entry = (-square, -far, -number)
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], entry)
                    elif entry > heaps[i][0]:
                        heapq.heapreplace(heaps[i], entry)
        if q is not None:
            yield done()

    tiles = candidates.join(asked, ["dim", "q", "g"]).sortWithinPartitions("dim", "q", "g")
    found = tiles.mapInPandas(search, "query_id long, vec_id long, square double, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("square", "score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))

"""Shards as runs of a Hilbert curve over document metadata, in DataFrame functions alone.

Source, language, size and id are each cut, texts by whole values, at equally filled quantiles into `2^BITS - 1`
classes, nulls being one more; a document's place on the Hilbert curve through those classes, then its id and text hash, orders all rows. The order is cut into runs of equal
row counts (law `rows`), so that every shard covers a small box in several dimensions at once and files can be
skipped by any of them. Ranks come from a range-partitioned, checkpointed order: rows are numbered within parts, and
parts are moved by the counts of those before them.

Results for odd rows: null text has size 8 and the crc32 of the empty text; nulls in any column form the lowest class
of their dimension and sort first; equal rows are all kept, in neighbouring slots; an empty table gives no rows; other
columns are ignored. More shards than rows leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from livetick.llm.common import cut, table

SHARDS, BITS = 24, 4
#: Bytes a row counts besides its text.
ROW_BYTES = 8
DIMENSIONS = ["source", "lang", "size", "doc_id"]


def text_borders(rows: DataFrame, column: str, classes: int) -> list[str]:
    """Ascending values that cut a text column, by whole values, into about equally filled classes.

    Rows are counted by value, values are ordered in range partitions, and a value is a border if the rows up to it
    reach another of the equal shares; the driver sees borders only.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(counts.repartitionByRange(parts, "v").withColumn("p", F.spark_partition_id()))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("p").agg(F.sum("n").alias("t")).select(
        "p", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ahead"), F.sum("t").over(Window.partitionBy()).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v")) + F.col("ahead")
    found = placed.join(sums, "p").withColumn("upto", upto).where(
        f"upto < total AND upto * {classes} DIV total > (upto - n) * {classes} DIV total").select("v").orderBy("v").collect()
    return [r["v"] for r in found]


def hilbert_index(df: DataFrame, axes: list[str], bits: int, to: str) -> DataFrame:
    """Add the place of each cell on the Hilbert curve; `axes` hold classes from 0 to 2^bits - 1.

    Skilling's transposition: from the highest bit down, a class with the bit set inverts the lower bits of the
    first axis, one without it swaps them with the first axis; a Gray code and its decoding follow.
    """
    n, x = len(axes), [f"_x{i}" for i in range(len(axes))]
    df = df.withColumns({a: F.col(b).cast("long") for a, b in zip(x, axes, strict=True)})
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for a in x:
            swap = (F.col(x[0]).bitwiseXOR(F.col(a))).bitwiseAND(F.lit(q - 1))
            is_set = F.col(a).bitwiseAND(F.lit(q)) != 0
            changed = {x[0]: F.when(is_set, F.col(x[0]).bitwiseXOR(F.lit(q - 1))).otherwise(F.col(x[0]).bitwiseXOR(swap))}
            if a != x[0]:
                changed[a] = F.when(is_set, F.col(a)).otherwise(F.col(a).bitwiseXOR(swap))
            df = df.withColumns(changed)
    for before, a in zip(x, x[1:]):
        df = df.withColumn(a, F.col(a).bitwiseXOR(F.col(before)))
    turn = F.lit(0).cast("long")
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(q)) != 0, q - 1).otherwise(0))
    df = df.withColumn("_turn", turn).withColumns({a: F.col(a).bitwiseXOR(F.col("_turn")) for a in x})
    place = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for a in x:
            place = F.shiftleft(place, 1).bitwiseOR(F.shiftright(F.col(a), b).bitwiseAND(F.lit(1)))
    return df.withColumn(to, place).drop("_turn", *x)


def sharded(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *[c for c in dimensions if c not in ("size", "doc_id")],
                       (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    kinds = dict(zip(rows.columns, [f.dataType for f in rows.schema.fields], strict=True))
    texts = [d for d in dimensions if isinstance(kinds[d], T.StringType)]
    values = {d: F.col(d) if d in texts else F.col(d).cast("double") for d in dimensions}
    last = (1 << bits) - 1
    shares = [i / last for i in range(1, last)]
    quantiles = [F.array_distinct(F.percentile_approx(v, shares)).alias(d) for d, v in values.items() if d not in texts]
    borders = (rows.agg(*quantiles).first().asDict() if quantiles else {}) | {d: text_borders(rows, d, last) for d in texts}
    classes = rows
    for d, v in values.items():
        over = [(v > b).cast("int") for b in borders[d] or []]
        classes = classes.withColumn(f"_class_{d}", F.when(v.isNull(), 0).otherwise(sum(over, F.lit(1))))
    keyed = hilbert_index(classes, [f"_class_{d}" for d in dimensions], bits, "curve")
    keyed = keyed.select("doc_id", "size", "text_crc32", "curve", F.monotonically_increasing_id().alias("_tie"))
    order = ["curve", "doc_id", "text_crc32", "size", "_tie"]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(keyed.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    in_part = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row per part: its window is over as many rows as there are parts.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = placed.withColumn("_in", in_part).join(offsets, "_part")
    rank = F.col("_before") + F.col("_in") - 1
    # In whole numbers: the shard is the largest s with ceil(s * all / shards) <= rank.
    shard = F.expr(f"CAST(((_before + _in - 1) * {shards}) DIV _all AS INT)")
    first = F.expr(f"((shard * _all) + {shards - 1}) DIV {shards}")
    out = ranked.withColumn("_rank", rank).withColumn("shard", shard)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_rank") - first).alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 runs of a Hilbert curve with row counts at most one apart."""
    return sharded(table(spark, sf_dir, "documents"))

"""Ranked lexical search with documents of equal bags scored once.

Documents are restricted to the vocabulary of the items: a bag is the sorted list of (term, occurrences), and with it
goes the length measure m. Documents of equal bag and m score alike for every item, so they form a class: Spark groups
by a hash and, within it, by the bag and m themselves. Each class is scored once against all items, as products of a
block of classes and a block of items; every task keeps the best classes of each item. As members of a class differ by
doc_id only, the 20 best documents lie in the 20 best classes by score and smallest member, which are expanded by
ascending doc_id.

Terms are the maximal runs of characters other than ASCII ones that are no digit or letter, A-Z lower-cased. With N
documents that hold a term, L terms in them, n terms in a document, df documents that hold a term and tf occurrences:
w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 75 + 25 n N div L, and an item's score of a document is the sum of
w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included. All but w is in integers.

The items of a part (`ITEM_CHARS` letters) are held by every task, their size is measured first; more are searched in
several passes over the bags' text.

Results for odd rows: null, empty and term-free texts and items match nothing; a null doc_id sorts last; repeated rows
count and are ranked each, repeated items are reported each, also with a null id; empty tables give no rows; other
columns are ignored. Texts are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from livetick.llm.common import stored, table
from livetick.llm.words import pieces

TOP = 20
ITEM_CHARS = 4_000_000
#: Classes and items that are multiplied at a time.
CLASS_BLOCK, ITEM_BLOCK = 1024, 256
#: Sums below this are exact in doubles.
_EXACT = 1 << 53

#: Bytes of texts: what parts terms becomes a blank, A-Z becomes a-z; all bytes of other characters stay.
_FOLD = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _FOLD[_low : _high + 1] = np.arange(_low, _high + 1)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in a row, and the text each is from."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    folded = _FOLD[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(folded)])
    split = pc.split_pattern(plain, " ")
    words = split.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), owner[some.to_numpy(zero_copy_only=False)]


class Items:
    """The items of one part: their vocabulary, and the occurrences of its terms in each item."""

    def __init__(self, ids: list[int | None], texts: list[str]) -> None:
        words, owner = terms_of(pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        self.ids, self.vocabulary = ids, coded.dictionary
        pair, self.repeats = np.unique(owner * max(1, len(self.vocabulary)) + coded.indices.to_numpy(), return_counts=True)
        self.item, self.code = np.divmod(pair, max(1, len(self.vocabulary)))


def parts_of(benchmark: DataFrame, letters_each: int = ITEM_CHARS) -> Iterator[Items]:
    """The items in parts of about `letters_each` letters; one part for any usual benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // letters_each))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield Items([r["item_id"] for r in own], [r["text"] for r in own])


# --- bags ---------------------------------------------------------------------------------------------------

_PAIR = np.dtype([("code", "<u4"), ("tf", "<u4")])


def bags(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, bag) of documents that hold a term; the bag has the terms of the vocabulary only."""
    size = max(1, len(vocabulary))

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for piece in pieces(frame, 1):
                words, owner = terms_of(piece.column(1))
                n = np.bincount(owner, minlength=piece.num_rows)
                code = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                held = code >= 0
                pair, tf = np.unique(owner[held] * size + code[held], return_counts=True)
                rows, codes = np.divmod(pair, size)
                entries = np.empty(len(pair), _PAIR)
                entries["code"], entries["tf"] = codes, tf
                borders = np.searchsorted(rows, np.arange(piece.num_rows + 1)).astype(np.int64) * _PAIR.itemsize
                bag = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(entries)])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), bag], ["doc_id", "n", "bag"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(of, "doc_id long, n long, bag binary").where("n > 0")


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of bags, and the number of entries of each bag."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // _PAIR.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), _PAIR), sizes


def counts(bag_rows: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of each term; a task sends one row a term it has met, and the driver holds one a term of the items."""

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_all, l_all = np.zeros(terms, np.int64), 0, 0
        for frame in frames:
            df += np.bincount(_entries(frame.column(1))[0]["code"], minlength=terms)
            n_all, l_all = n_all + frame.num_rows, l_all + (pc.sum(frame.column(0)).as_py() or 0)
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], met)), pa.int64()),
                                          pa.array(np.concatenate(([n_all, l_all], df[met])), pa.int64())], ["code", "c"])

    df = np.zeros(terms, np.int64)
    found = bag_rows.select("n", "bag").mapInArrow(of, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).collect()
    total = {r["code"]: r["c"] for r in found}
    for code, c in total.items():
        if code >= 0:
            df[code] = c
    return total.get(-2, 0), total.get(-1, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def classes(bag_rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(class_id, bag, m, first_doc): one row for each different bag and m; documents without a term of the items score nothing."""
    held = with_class_key(bag_rows, n_docs, n_terms)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first_doc")
    return held.groupBy("hash", "m", "bag").agg(first).withColumn("class_id", F.monotonically_increasing_id())


def with_class_key(bag_rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    m = F.expr(f"75L + (25L * n * {n_docs}L) div {max(1, n_terms)}L")
    return bag_rows.where("length(bag) > 0").select("doc_id", "bag", m.alias("m")).withColumn("hash", F.xxhash64("bag", "m"))


# --- scores -------------------------------------------------------------------------------------------------


class ItemBlock:
    """Some items as a matrix, terms down and items across, of weights times occurrences."""

    def __init__(self, items: Items, weight: np.ndarray, low: int, high: int) -> None:
        own = slice(*np.searchsorted(items.item, (low, high)))
        self.low, codes = low, items.code[own]
        self.codes, row = np.unique(codes, return_inverse=True)
        value = weight[codes] * items.repeats[own]
        most = int(np.bincount(items.item[own] - low, value, high - low).max(initial=0)) * 1_000_000
        self.matrix = np.zeros((len(self.codes), high - low), np.float64 if most < _EXACT else np.int64)
        self.matrix[row, items.item[own] - low] = value

    def scores(self, row: np.ndarray, code: np.ndarray, saturated: np.ndarray, rows: int) -> np.ndarray:
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == code
        left = np.zeros((rows, len(self.codes)), self.matrix.dtype)
        left[row[known], at[known]] = saturated[known]
        return left @ self.matrix


class Best:
    """The best classes of every item so far: highest score, then smallest first document."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.least = top, np.zeros(items, np.int64)
        self.kept = np.zeros((4, 0), np.int64)  # item, score, first document, class

    def add(self, low: int, scores: np.ndarray, first: np.ndarray, ids: np.ndarray) -> None:
        floor = self.least[low : low + scores.shape[1]].astype(scores.dtype)
        if len(scores) > self.top:
            floor = np.maximum(floor, np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top])
        row, column = np.nonzero((scores >= floor) & (scores > 0))
        new = np.stack([column + low, scores[row, column].astype(np.int64), first[row], ids[row]])
        kept = np.concatenate([self.kept, new], axis=1)
        kept = kept[:, np.lexsort((kept[3], kept[2], -kept[1], kept[0]))]
        starts = np.flatnonzero(np.diff(kept[0], prepend=-1))
        place = np.arange(kept.shape[1]) - np.repeat(starts, np.diff(starts, append=kept.shape[1]))
        self.kept = kept[:, place < self.top]
        last = kept[:, place == self.top - 1]
        self.least[last[0]] = last[1]


#: Stands for a null doc_id, behind all others.
_LAST = (1 << 63) - 1


def best_classes(class_rows: DataFrame, items: Items, weight: np.ndarray, top: int = TOP) -> DataFrame:
    """(item, score, first_doc, class_id): each task's best classes of every item, few enough for one window."""
    count = len(items.ids)

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [ItemBlock(items, weight, low, min(count, low + ITEM_BLOCK)) for low in range(0, count, ITEM_BLOCK)]
        best = Best(count, top)
        for frame in frames:
            for at in range(0, frame.num_rows, CLASS_BLOCK):
                part = frame.slice(at, CLASS_BLOCK)
                found, sizes = _entries(part.column(0))
                m, first, ids = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                row, tf = np.repeat(np.arange(len(sizes)), sizes), found["tf"].astype(np.int64)
                saturated = 1_000_000_000 * tf // (1000 * tf + 12 * m[row])
                for block in blocks:
                    best.add(block.low, block.scores(row, found["code"], saturated, len(sizes)), first, ids)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in best.kept], ["item", "score", "first_doc", "class_id"])

    rows = class_rows.select("bag", "m", F.coalesce("first_doc.doc_id", F.lit(_LAST)).alias("first_doc"), "class_id")
    ahead = Window.partitionBy("item").orderBy(F.desc("score"), "first_doc", "class_id")
    found = rows.mapInArrow(of, "item long, score long, first_doc long, class_id long")
    return found.withColumn("_at", F.row_number().over(ahead)).where(F.col("_at") <= top).drop("_at")


def expanded(best: DataFrame, class_rows: DataFrame, bag_rows: DataFrame, top: int = TOP) -> DataFrame:
    """(item, rank, doc_id, score): the members of the best classes, as many as can be among an item's best."""
    named = class_rows.join(best.select("class_id").distinct(), "class_id").select("class_id", "hash", "m", "bag")
    by_id = F.col("doc_id").asc_nulls_last()
    members = bag_rows.join(named, ["hash", "m", "bag"]).select("class_id", "doc_id")
    members = members.withColumn("_at", F.row_number().over(Window.partitionBy("class_id").orderBy(by_id))).where(F.col("_at") <= top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), by_id)).alias("rank")
    return best.join(members, "class_id").select("item", rank, "doc_id", "score").where(F.col("rank") <= top)


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` best documents of every item."""
    return reduce(DataFrame.union, [_search_part(docs, items, top) for items in parts_of(benchmark)])


def _search_part(docs: DataFrame, items: Items, top: int) -> DataFrame:
    spark = docs.sparkSession
    bag_rows = stored(bags(docs, items.vocabulary), "bags")
    n_docs, n_terms, df = counts(bag_rows, len(items.vocabulary))
    class_rows = stored(classes(bag_rows, n_docs, n_terms), "bag-classes")
    best = stored(best_classes(class_rows, items, weights(n_docs, df), top), "best-classes")
    ranked = expanded(best, class_rows, with_class_key(bag_rows, n_docs, n_terms), top)
    names = spark.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op12_bag_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same term by term, without bags or classes.
ORACLE_SQL = r"""
WITH low AS (
  SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS re),
terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, a, b), re)) AS term FROM documents, low),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lens),
ms AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM lens, totals),
wanted AS (SELECT item_id, unnest(regexp_extract_all(translate(text, a, b), re)) AS term FROM benchmark, low),
asked AS (SELECT item_id, term, count(*) AS q FROM wanted GROUP BY ALL),
ws AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, nn),
scores AS (
  SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN ws USING (term) JOIN tfs USING (term) JOIN ms USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""

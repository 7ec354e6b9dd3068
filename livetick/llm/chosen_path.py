"""Near duplicates by a chosen-path set similarity join.

A document is the set of its runs of `WORDS` words (lower case, parted at blanks). Documents with equal sets form one
class and are joined once. Each class samples `coordinates(runs)` tokens of its set by min-wise hashes; a token that two
sets sampled by the same hash is shared. In each of `runs` repetitions a class goes down two sampled tokens; classes
that met at a node small enough to compare are compared there, larger nodes are split again on two further tokens as
long as that parts them, and nodes that stay together (many near copies) are compared in pairs of blocks. Every run and
level has tokens of its own, so that runs fail independently. A pair is compared where it first meets, by its whole
sets, so links are exact; `runs` is set so that a pair at the threshold is missed with a probability below 1 - `recall`,
however often its nodes are split.

Results for odd rows: a text of fewer words than a run is the set of its one shorter run; a null text, or one without
words, is like no other and stays alone; a null id is alone with class null and no links; repeated rows are documents
of their own with the same id; two texts under one id are two documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetick.llm.common import Powers, batches, cut, mix, narrow, stored, table, word_hashes
from livetick.llm.components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
BRANCHES, LEVELS = 2, 4
#: A node or block with more members, or more tokens, is split or cut into blocks.
MEMBERS, TOKENS = 1024, 1 << 20
#: A split is worth while if no child has more than this share of a node.
PARTED = 0.5
BATCH = 256
#: What `_key` gives.
KEY = ["doc_id", "h1", "h2"]

_STEPS = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)


def missed(threshold: float, branches: int = BRANCHES, levels: int = LEVELS) -> float:
    """Probability that a pair at the threshold parts in one run whose nodes are split at all levels.

    All nodes of a level are split on the same tokens, so the pair is lost if it shares none of those at any level.
    """
    return 1 - (1 - (1 - threshold) ** branches) ** levels


def runs_for(threshold: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed(threshold))))


def coordinates(runs: int) -> int:
    """Sampled tokens of a set: no two levels or runs have one in common."""
    return runs * LEVELS * BRANCHES


def sets_of(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of each text, ascending, one text after the other, and how many each has."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    hashes, start, _ = word_hashes(np.frombuffer(b"\n".join(raw), np.uint8), powers)
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, "right")
    words = np.bincount(doc, minlength=len(raw))
    first = np.concatenate(([0], np.cumsum(words)))
    n = len(hashes)
    run = np.zeros(n, np.uint64)
    for j in range(WORDS):
        run[: n - j] += hashes[j:] * _STEPS[j]
    whole = doc[: n - WORDS + 1] == doc[WORDS - 1 :] if n >= WORDS else np.zeros(0, bool)
    keep = np.zeros(n, bool)
    keep[: len(whole)] = whole
    for d in np.flatnonzero((words > 0) & (words < WORDS)):
        own = hashes[first[d] : first[d + 1]]
        run[first[d]] = (own * _STEPS[: len(own)]).sum() + np.uint64(len(own))
        keep[first[d]] = True
    values, owner = mix(run[keep]), doc[keep]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(raw))


def digests(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that tell sets apart, of each set from its start on."""
    return np.stack([np.add.reduceat(mix(values ^ np.uint64(s)), start).view(np.int64) for s in (0x55, 0xAA)])


def sketches(docs: DataFrame, runs: int) -> DataFrame:
    """(uid, doc_id, h1, h2, n, d1, d2, sampled): the text's hashes, and its set's size, digests and sampled tokens, of
    every document with words and an id."""
    seeds = mix(np.arange(1, coordinates(runs) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for pdf in batches(frames, BATCH):
            values, sizes = sets_of(pdf["text"].tolist(), powers)
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            start = np.concatenate(([0], np.cumsum(sizes)))[some]
            sums = digests(values, start)
            sampled = np.stack([np.minimum.reduceat(mix(values ^ s), start) for s in seeds], 1)
            yield pd.DataFrame({"uid": pdf["uid"].to_numpy()[some], "doc_id": pdf["doc_id"].to_numpy()[some], "h1": pdf["h1"].to_numpy()[some],
                                "h2": pdf["h2"].to_numpy()[some], "n": sizes[some], "d1": sums[0], "d2": sums[1], "sampled": list(sampled.view(np.int64))})

    rows = docs.where("doc_id IS NOT NULL").select(F.monotonically_increasing_id().alias("uid"), *_key(), "text")
    return rows.mapInPandas(of, "uid long, doc_id long, h1 long, h2 long, n long, d1 long, d2 long, sampled array<long>")


def _key() -> list:
    """What tells documents apart: the id and two hashes of the text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def _children(rows: DataFrame, level: int) -> DataFrame:
    """(node, parent, uid, n): where each class goes from its node; `rows` has (node, run, uid, n, sampled)."""
    first = (F.col("run") * LEVELS + level) * BRANCHES
    out = rows.withColumn("_at", F.explode(F.sequence(first, first + BRANCHES - 1)))
    node = F.xxhash64("node", "run", "_at", F.col("sampled")[F.col("_at")])
    return out.select(node.alias("node"), F.col("node").alias("parent"), "run", "uid", "n")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"),
                                    F.bit_xor(F.xxhash64("uid")).alias("s1"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("s2"))


def _cut(df: DataFrame) -> DataFrame:
    return cut(narrow(df))


def leaves(classes: DataFrame, runs: int) -> DataFrame:
    """(node, uid, n, blocks): the nodes whose members are compared with each other; `classes` has (uid, n, sampled)."""
    big = (F.col("members") > MEMBERS) | (F.col("tokens") > TOKENS)
    start = classes.select(F.lit(0).cast("long").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "uid", "n", "sampled")
    rows = _cut(_children(start, 0).drop("parent"))
    done, level = [], 1
    while True:
        sizes = _cut(_sizes(rows).where("members > 1"))
        large = sizes.where(big)
        if level >= LEVELS or large.isEmpty():
            done.append(rows.join(sizes, "node"))
            break
        inside = rows.join(large.select("node"), "node", "left_semi")
        below = _cut(_children(inside.join(classes.select("uid", "sampled"), "uid"), level))
        shares = below.groupBy("parent", "node").agg(F.count("*").alias("c")).groupBy("parent").agg(F.max("c").alias("c"))
        parted = large.join(shares, large["node"] == shares["parent"]).where(F.col("c") <= PARTED * F.col("members")).select("parent")
        parted = _cut(parted)
        done.append(rows.join(sizes.join(parted, sizes["node"] == parted["parent"], "left_anti"), "node"))
        rows = below.join(parted, "parent", "left_semi").drop("parent")
        level += 1
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    found = _cut(found.select("node", "uid", "n", "members", "tokens", "s1", "s2"))
    # Nodes with the same members say the same; one of them is enough.
    once = found.select("node", "members", "s1", "s2").distinct().groupBy("members", "s1", "s2").agg(F.min("node").alias("node")).select("node")
    blocks = F.greatest(F.ceil(F.col("tokens") / TOKENS), F.ceil(F.col("members") / MEMBERS)).cast("int")
    return found.join(once, "node", "left_semi").select("node", "uid", "n", blocks.alias("blocks"))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, through products of the 0/1 columns of shared tokens."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    column = np.cumsum(np.concatenate(([0], tokens[1:] != tokens[:-1]))) if len(tokens) else tokens
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    out = np.zeros((len(sets), len(sets)), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
    width = 4096
    for low in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def compared(node: int, low: int, high: int, rows: list[tuple], threshold: float) -> list[tuple[int, int, int]]:
    """(uid, links, root) of the members of blocks `low` and `high`; a row is (uid, block, weight, nodes, set)."""
    blocks = np.array([r[1] for r in rows])
    if low != high and blocks.min() == blocks.max():  # one of the two is empty; the other is compared as (low, low)
        return []
    sets = [r[4] for r in rows]
    sizes = np.fromiter(map(len, sets), float, len(sets))
    if len(rows) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        near = np.array([[False, both >= threshold * (sizes.sum() - both) - 1e-9], [False, False]])
    else:
        both = shared_counts(sets)
        near = np.triu(both >= threshold * (sizes[:, None] + sizes - both) - 1e-9, 1)
    if low != high:
        near &= blocks[:, None] != blocks
    left, right = np.nonzero(near)
    if not len(left):
        return []
    # A pair that also meets at a smaller node is counted there.
    earlier = [{x for x in r[3] if x < node} for r in rows]
    counted = np.fromiter((earlier[i].isdisjoint(earlier[j]) for i, j in zip(left, right, strict=True)), bool, len(left))
    weights = np.array([r[2] for r in rows])
    links = np.bincount(left[counted], weights[right[counted]], len(rows)) + np.bincount(right[counted], weights[left[counted]], len(rows))
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    uids = [r[0] for r in rows]
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            i, j = (i, j) if uids[i] < uids[j] else (j, i)
            root[j] = i
    return [(uids[i], int(links[i]), uids[find(i)]) for i in sorted({*left.tolist(), *right.tolist()})]


def compare(docs: DataFrame, classes: DataFrame, where: DataFrame, threshold: float) -> DataFrame:
    """(uid, links, root) from every pair of blocks of every node; sets are made anew from the texts of members only."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for pdf in batches(frames, BATCH):
            values, sizes = sets_of(pdf["text"].tolist(), powers)
            rows = []
            for uid, d1, d2, end, size in zip(pdf["uid"], pdf["d1"], pdf["d2"], np.cumsum(sizes), sizes, strict=True):
                own = values[end - size : end]
                if size and digests(own, np.zeros(1, np.int64))[:, 0].tolist() == [d1, d2]:
                    rows.append((uid, own.tobytes()))
            yield pd.DataFrame(rows, columns=["uid", "tokens"])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def done() -> pd.DataFrame:
            rows = compared(*key, held, threshold) if len(held) > 1 else []
            return pd.DataFrame(rows, columns=["uid", "links", "root"])

        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                if key != (row.node, row.low, row.high):
                    if len(held) > 1:
                        out.append(done())
                    key, held = (row.node, row.low, row.high), []
                held.append((row.uid, row.block, row.weight, row.nodes, np.frombuffer(row.tokens, "<u8")))
            if out:
                yield pd.concat(out)
        if len(held) > 1:
            yield done()

    nodes = where.groupBy("uid").agg(F.collect_list("node").alias("nodes"))  # at most BRANCHES^LEVELS x runs of them
    members = classes.select("uid", *KEY, "weight", "d1", "d2").join(nodes, "uid")
    texts = docs.where("doc_id IS NOT NULL").select(*_key(), "text").join(members.select("uid", *KEY, "d1", "d2"), KEY)
    made = texts.select("uid", "d1", "d2", "text").mapInPandas(sets, "uid long, tokens binary")
    if _repeats(docs):
        made = made.dropDuplicates(["uid"])
    block = F.pmod(F.xxhash64("uid", "node"), F.col("blocks")).cast("int")
    dealt = where.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "uid", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full = dealt.join(members.select("uid", "weight", "nodes"), "uid").join(made, "uid")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = full.repartition(parts, "node", "low", "high").sortWithinPartitions("node", "low", "high")
    return ordered.mapInPandas(walk, "uid long, links long, root long")


def _repeats(docs: DataFrame) -> bool:
    """Whether any id occurs twice."""
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def grouped(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The sketches, and (d1, d2, n, first, n_links) of every set: the first document of its group, as `KEY`, and its links."""
    runs = runs_for(threshold, recall)
    known = stored(sketches(docs, runs), "sketches")
    sets = known.groupBy("d1", "d2", "n").agg(F.min(F.struct(*KEY, "uid", "sampled")).alias("_first"), F.count("*").alias("weight"))
    classes = _cut(sets.select("_first.uid", *[f"_first.{c}" for c in KEY], "_first.sampled", "d1", "d2", "n", "weight"))
    where = _cut(leaves(classes, runs))
    links = stored(compare(docs, classes, where, threshold), "links")
    roots = components(links.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = roots.join(classes.select(F.col("uid").alias("v"), *KEY), "v").groupBy("root").agg(F.min(F.struct(*KEY)).alias("first"))
    linked = links.groupBy("uid").agg(F.sum("links").alias("links"))
    groups = roots.join(named, "root").select(F.col("v").alias("uid"), "first")
    said = classes.join(groups, "uid", "left").join(linked, "uid", "left")
    return known, said.select("d1", "d2", "n", F.coalesce("first", F.struct(*KEY)).alias("first"),
                              (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the smallest id of its group, and how many other rows are as similar."""
    known, said = grouped(docs, threshold, recall)
    out = known.select("doc_id", "d1", "d2", "n").join(said.select("d1", "d2", "n", F.col("first.doc_id").alias("class_id"), "n_links"), ["d1", "d2", "n"])
    out = out.select("doc_id", "class_id", "n_links")
    alone = docs.select(F.col("doc_id").cast("long").alias("doc_id"), wordless("text").alias("_none"))
    alone = alone.where("_none OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(alone)


def wordless(text: str):
    return F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group, one with the smallest id; rows without id or words stay.

    Rows go by id and text, so that other texts under the id of a lost one stay. Of several texts of a group under its
    smallest id the one with the smallest hash is kept, of equal rows one.
    """
    known, said = grouped(docs, THRESHOLD, RECALL)
    lost = known.select(*KEY, "d1", "d2", "n").join(said.select("d1", "d2", "n", "first"), ["d1", "d2", "n"])
    lost = lost.where(F.struct(*KEY) != F.col("first")).select(*[F.col(c).alias(f"_lost_{c}") for c in KEY]).distinct()
    same = [k == F.col(f"_lost_{c}") for k, c in zip(_key(), KEY, strict=True)]
    kept = docs.join(lost, same, "left_anti").select(*docs.columns)
    if _repeats(docs):
        numbered, rest = kept.where(F.col("doc_id").isNotNull() & ~wordless("text")), kept.where(F.col("doc_id").isNull() | wordless("text"))
        kept = numbered.dropDuplicates(["doc_id", "text"]).union(rest)
    return kept


def op2_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and links of every whole document."""
    return near_duplicates(table(spark, sf_dir, "documents"))

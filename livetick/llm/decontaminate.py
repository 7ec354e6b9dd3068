"""Benchmark passages in documents: q-gram lemma filtering, then banded alignment.

Texts are compared in lower case with white space as single blanks. An item of length L may differ from a passage by
`budget` = 10 % of L edits. By the q-gram lemma such a passage shares at least L - q + 1 - q * budget character q-grams
with the item, all on diagonals within `budget` of each other. Shared q-grams are counted per item in overlapping bands
of that many diagonals, one from each diagonal that has any; bands that reach the bound are aligned, near ones together.

The items' q-grams are held by every task. Their size is measured first: items beyond `ITEM_CHARS` letters are dealt to
several parts, and the documents are read once per part. An item shorter than q is looked for as it stands.

Results for odd rows: null or empty texts and items match nothing; a null doc_id is reported with a null id, null
item ids likewise; repeated rows and items are reported each; empty tables give no rows; other columns are ignored
by `matches` and kept by `keep_clean`. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetick.llm.common import batches, mix, table

Q, RATE = 8, 0.1
ITEM_CHARS = 4_000_000
BATCH = 256
#: Letters of texts that are searched at a time; arrays of that size stay in a core's cache.
SLICE = 1 << 16
#: Shared q-grams that are held at a time, and cells of a row of all regions that are aligned at a time.
HITS, ALIGNED = 1 << 20, 1 << 18
_FILTER_BITS = 22

_STEPS = mix(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the q = 8 letters from each place on: pairs of letters, pairs of pairs, and pairs of those."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    out = codes.astype(np.uint64)
    for reach, step in zip((1, 2, 4), _STEPS[:3], strict=True):
        out = out[:-reach] + out[reach:] * step
    return out * _STEPS[3]


def budget(length: int, rate: float = RATE) -> int:
    """Edits allowed, as many as leave the lemma at least one shared q-gram."""
    return max(0, min(int(rate * length), (length - Q) // Q))


def align_many(items: np.ndarray, regions: np.ndarray, sizes: np.ndarray, first: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end) of the best passage of each region that matches all of its item with at most `most` edits.

    Items of one length, a row each; regions padded with -1. A passage starts at a diagonal from `first` to `first +
    width`; cells outside the band of those diagonals, widened by `most`, cannot be on such a path. Of equal distances
    the earliest end is taken; a distance above `most` stands for none.
    """
    offset, far = np.arange(width + 2 * most + 1), np.int64(1 << 30)
    low, high = (first - most)[:, None] + offset, sizes[:, None]
    padded = np.pad(regions.astype(np.int64), ((0, 0), (0, 1)), constant_values=-1)
    edge = np.full((len(items), 1), far)
    # Row 0: a passage may start anywhere on the allowed diagonals.
    row = np.where((offset >= most) & (offset <= most + width) & (low >= 0) & (low <= high), np.int64(0), far)
    for i in range(1, items.shape[1] + 1):
        at = low + i  # place in the region after this row, by diagonal
        letter = np.take_along_axis(padded, np.clip(at - 1, -1, padded.shape[1] - 1), axis=1)
        match = np.where((at < 1) | (at > high), far, row + (letter != items[:, i - 1 : i]))
        row = np.minimum(match, np.concatenate([row[:, 1:], edge], axis=1) + 1)
        outside = (at < 0) | (at > high)
        row[outside] = far
        row = np.minimum.accumulate(row - offset, axis=1) + offset  # letters of the region that the item lacks
        row[outside] = far
        if row.min() > most:
            break
    best = row.argmin(axis=1)
    each = np.arange(len(items))
    return row[each, best], low[each, best] + items.shape[1]


class Items:
    """The q-gram index of some items; items of equal plain text are searched once and reported each."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE) -> None:
        named: dict[str, list[int | None]] = {}
        for i, t in items:
            named.setdefault(plain(t), []).append(i)
        self.texts = [(ids, t) for t, ids in named.items() if len(t) >= Q]
        self.short = [(ids, t) for t, ids in named.items() if 0 < len(t) < Q]
        if len(self.texts) >= 1 << 16:
            raise ValueError("too many items in one part")
        self.rate = rate
        self.codes = [letters(t) for _, t in self.texts]
        lengths = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([budget(int(n), rate) for n in lengths], np.int64)
        self.least = lengths - Q + 1 - Q * self.budget
        self.step = 2 * self.budget + 1
        all_grams = [grams(c) for c in self.codes]
        keys = np.concatenate(all_grams) if all_grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(self.codes)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if all_grams else item
        order = np.argsort(keys, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.keys, self.start, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the text, item, place in the item) of every shared q-gram, about `HITS` at a time."""
        found = grams(codes)
        at = np.flatnonzero(self.maybe[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, found[at]), max(len(self.keys) - 1, 0))
        same = self.keys[slot] == found[at] if len(self.keys) else np.zeros(len(at), bool)
        at, slot = at[same], slot[same]
        count = self.count[slot]
        part = np.cumsum(count) // HITS
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
            n = count[own]
            entry = np.repeat(self.start[slot[own]] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
            yield np.repeat(at[own], n), self.item[entry], self.place[entry]

    def search(self, texts: list[str | None]) -> list[tuple[int, int | None, int, int]]:
        """(text, item id, end of the passage in the plain text, edits), the best passage of each text and item."""
        plains = [plain(t) for t in texts]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if self.texts:
            codes = letters(("\0" * Q).join(plains))
            ends = np.cumsum([len(p) + Q for p in plains])
            starts = ends - np.array([len(p) + Q for p in plains], np.int64)
            for low in range(0, len(codes), SLICE):
                # Slices overlap by as much as the longest region needs.
                self._slice(codes, low, min(len(codes), low + SLICE + self.overlap), starts, ends, best)
        out = [(t, one, end, edits) for (t, i), (edits, end) in sorted(best.items()) for one in self.texts[i][0]]
        for t, text in enumerate(plains):
            out += [(t, one, at + len(s), 0) for ids, s in self.short if (at := text.find(s)) >= 0 for one in ids]
        return out

    def _exact(self, i: int, region: np.ndarray) -> int:
        """End of the item as it stands in the region, 0 if it does not; only then is there something to align."""
        data, item = region.tobytes(), self.codes[i].tobytes()
        at = data.find(item)
        while at >= 0 and at % 4:
            at = data.find(item, at + 1)
        return at // 4 + len(self.codes[i]) if at >= 0 else 0

    @property
    def overlap(self) -> int:
        return int(max(len(c) for c in self.codes) * 2 + 4 * self.step.max()) if self.codes else 0

    def _counts(self, codes, low, high, starts, ends, base) -> tuple[np.ndarray, np.ndarray]:
        """Shared q-grams by text, item and diagonal, as ascending keys and their counts."""
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, item, place in self.hits(codes[low:high]):
            at = at + low
            text = np.searchsorted(ends, at, "right")
            own, n = np.unique((text << 52) | (item << 36) | (at - place - starts[text] + base), return_counts=True)
            if not len(key):
                key, count = own, n
                continue
            merged, where = np.unique(np.concatenate([key, own]), return_inverse=True)
            key, count = merged, np.bincount(where, np.concatenate([count, n])).astype(np.int64)
        return key, count

    def _slice(self, codes, low, high, starts, ends, best) -> None:
        base = len(codes) + self.overlap  # so that diagonals are above 0, whatever the place in the item
        if base >= 1 << 35:
            raise ValueError("too long texts")
        key, count = self._counts(codes, low, high, starts, ends, base)
        if not len(key):
            return
        # A passage has its q-grams on diagonals within the edits of each other: every band of that width that begins
        # at a diagonal with hits is held against the bound.
        item = (key >> 36) & 0xFFFF
        upto = np.concatenate(([0], np.cumsum(count)))
        enough = upto[np.searchsorted(key, key + self.budget[item], "right")] - upto[:-1] >= self.least[item]
        key, item = key[enough], item[enough]
        # Bands that begin near each other are aligned together.
        near = np.unique(np.stack([key >> 52, item, (key & ((1 << 36) - 1)) // self.step[item]]), axis=1).T
        waiting: dict[int, dict[tuple[int, bytes], list[tuple[int, int]]]] = {}
        for t, i, b in near.tolist():
            if best.get((t, i), (1 << 30,))[0] == 0:
                continue
            step, most = int(self.step[i]), int(self.budget[i])
            first = b * step - base - most
            region = codes[starts[t] : ends[t] - Q]
            cut = max(0, first - most)
            region = region[cut : first + step + 3 * most + len(self.codes[i])]
            at_once = self._exact(i, region)
            if at_once:
                best[t, i] = (0, at_once + cut)
            else:  # equal regions are aligned once
                waiting.setdefault(len(self.codes[i]), {}).setdefault((i, first - cut, region.tobytes()), []).append((t, cut))
        for length, regions in waiting.items():
            open_ = [(r, [(t, cut) for t, cut in places if best.get((t, r[0]), (1 << 30,))[0] > 0]) for r, places in regions.items()]
            self._align(length, [(r, places) for r, places in open_ if places], best)

    def _align(self, length: int, regions: list, best: dict) -> None:
        """Regions of items of one length, several at a time."""
        most = budget(length, self.rate)
        width = 4 * most  # bands of 2 most + 1 diagonals, a start up to `most` beside them
        each = max(1, ALIGNED // (length + width + 4 * most + 1))
        for at in range(0, len(regions), each):
            part = regions[at : at + each]
            found = [np.frombuffer(r[2], np.uint32) for r, _ in part]
            padded = np.full((len(part), max(map(len, found))), -1, np.int64)
            for row, f in zip(padded, found, strict=True):
                row[: len(f)] = f
            distance, end = align_many(
                np.stack([self.codes[r[0]] for r, _ in part]).astype(np.int64), padded, np.array([len(f) for f in found]),
                np.array([r[1] for r, _ in part]), width, most)
            for (r, places), d, e in zip(part, distance.tolist(), end.tolist(), strict=True):
                for t, cut in places if d <= most else ():
                    best[t, r[0]] = min(best.get((t, r[0]), (d, e + cut)), (d, e + cut))


def parts_of(benchmark: DataFrame, letters_each: int = ITEM_CHARS) -> Iterator[Items]:
    """The items in parts of about `letters_each` letters; one part for any usual benchmark."""
    items = benchmark.select(F.struct(F.col("item_id").cast("long").alias("item_id")).alias("id"), "text").where("text IS NOT NULL")
    items = items.groupBy("text").agg(F.collect_list("id").alias("ids"))
    total, rows = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-total // letters_each), -(-rows // 50_000))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        yield Items([(i["item_id"], r["text"]) for r in own.collect() for i in r["ids"]])


def _matches_of(rows: DataFrame, items: Items) -> DataFrame:
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(frames, BATCH):
            hits = items.search(pdf["text"].tolist())
            ids = pdf["doc_id"].astype("Int64").array
            yield pd.DataFrame({"doc_id": ids[[h[0] for h in hits]], "item_id": pd.array([h[1] for h in hits], "Int64"),
                                "passage_end": pd.array([h[2] for h in hits], "Int64"), "edits": pd.array([h[3] for h in hits], "Int64")})

    return rows.mapInPandas(of, "doc_id long, item_id long, passage_end long, edits long")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage_end, edits) for every document and item found in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reduce(DataFrame.union, [_matches_of(rows, items) for items in parts_of(benchmark)])


def _holds(items: Items):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        held = np.zeros(len(texts), bool)
        for at in range(0, len(texts), BATCH):
            held[[at + h[0] for h in items.search(texts.iloc[at : at + BATCH].tolist())]] = True
        return pd.Series(held)

    return holds("text")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a benchmark item. Only texts pass through Python and nothing is shuffled."""
    for items in parts_of(benchmark):
        docs = docs.where(~_holds(items))
    return docs


def op8_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item it holds."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

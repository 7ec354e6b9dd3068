"""Word bigram model with interpolated modified Kneser-Ney smoothing, and perplexity of whole documents.

Words are counted in three Spark jobs. Tasks add up what they have seen before anything is shuffled and send sorted,
delta-coded key arrays, dealt by the leading bits of a key's hash, so that neither a frequent word nor a frequent
context meets in one task:

1. word hashes -> sorted hash arrays with counts; a word's id is its place in them;
2. word pairs -> sorted hash arrays with counts, and per bucket what they say of contexts and of continuations;
3. contexts (total, backoff weight) and continuations (distinct words in front), by id.

The arrays are files in the shared folder. Workers map them into memory and look words and pairs up by binary search;
nothing of the model passes through the driver but one row of counts per file. Files are written under a name of the
attempt's own and renamed, so that repeated tasks leave the same file. Where the shared folder is no mounted one,
files are read through Arrow's file systems, one bucket at a time.

Texts are bytes in UTF-8; A-Z become a-z; words are runs without blank and 0x09 to 0x0D; an end follows every text and
counts as a word. Results for odd rows: a null or empty text is the end alone; a null id is in the training part as
its crc32 is that of the empty text (0); repeated rows are learned and scored one by one; an empty table gives no
rows; without training text every known share is 0 and probabilities come from the unknown word alone; other
columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetick.llm.common import LOWER, Powers, batches, fold, mix, stored, table, word_hashes, work_path

FOLDS, HELD_OUT = 7, 2
BATCH = 512
#: Words a task holds before it adds them up and sends them on.
HELD_WORDS = 1 << 22
#: The end of a text; no run of bytes has this hash but by chance.
END = np.uint64(0x1F3D5B79A2C4E6F8)


# --- arrays between tasks ------------------------------------------------------------------------------------


def squeeze(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences, and their columns, byte planes compressed."""
    parts = [np.diff(keys, prepend=keys[:1] * 0), *columns]
    planes = [np.ascontiguousarray(p.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes() for p in parts]
    return len(keys).to_bytes(8, "little") + zlib.compress(b"".join(planes), 1)


def spread(data: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zlib.decompress(data[8:]), np.uint8).reshape(columns + 1, 8, n)
    parts = [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]
    return [np.cumsum(parts[0], dtype=np.uint64), *parts[1:]]


def add_up(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order with the sums of their columns."""
    if not len(keys):
        return [keys, *columns]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(c[order], first) for c in columns)]


def dealt(keys: np.ndarray, to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted keys and columns, parted by bucket; order within a bucket stays."""
    order = np.argsort(to, kind="stable")
    kinds, first = np.unique(to[order], return_index=True)
    for bucket, rows in zip(kinds, np.split(order, first[1:]), strict=True):
        yield int(bucket), squeeze(keys[rows], *(c[rows] for c in columns))


def joined(blobs: pd.Series, columns: int) -> list[np.ndarray]:
    parts = [spread(b, columns) for b in blobs]
    return add_up(*(np.concatenate(c) for c in zip(*parts, strict=True)))


# --- files ------------------------------------------------------------------------------------------------------


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def mounted(path: str) -> str | None:
    """The path as a mounted folder has it, None for another store."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save(path: str, array: np.ndarray) -> None:
    """Write an array under an attempt's own name, then rename."""
    own, local = f"{path}.{uuid.uuid4().hex}", mounted(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(mounted(own), "wb") as f:
            f.write(array.tobytes())
        os.replace(mounted(own), local)
        return
    system, place = _system(own)
    with system.open_output_stream(place) as f:
        f.write(array.tobytes())
    system.move(place, _system(path)[1])


def load(path: str, kind: str) -> np.ndarray:
    """A mapped array, or one read from a store that cannot be mapped."""
    local = mounted(path)
    if local is not None:
        return np.memmap(local, kind, "r") if os.path.getsize(local) else np.zeros(0, kind)
    system, place = _system(path)
    with system.open_input_stream(place) as f:
        return np.frombuffer(f.read(), kind)


class Arrays:
    """The files of one name, one per bucket, opened when first needed."""

    def __init__(self, folder: str, name: str, kind: str, there: set[int]) -> None:
        self.folder, self.name, self.kind, self.there, self.open = folder, name, kind, there, {}

    def __getitem__(self, bucket: int) -> np.ndarray:
        if bucket not in self.there:
            return np.zeros(0, self.kind)
        if bucket not in self.open:
            self.open[bucket] = load(f"{self.folder}/{self.name}-{bucket}", self.kind)
        return self.open[bucket]


class Layout:
    """Where the files lie and how keys are dealt to them. All a worker needs to know, a few numbers per bucket."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int]) -> None:
        self.folder, self.bits, self.sizes = folder, bits, sizes
        self.starts = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum([sizes.get(b, 0) for b in range(1 << bits)], out=self.starts[1:])
        self.words = int(self.starts[-1])

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def home(self, ids: np.ndarray) -> np.ndarray:
        """The bucket whose word arrays hold an id; the id one beyond the words, the start, is in the last."""
        return np.minimum(np.searchsorted(self.starts, ids, "right") - 1, (1 << self.bits) - 1)


def found(arrays: Arrays, hashes: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket borders, place in its bucket or -1) of sorted hashes."""
    place = np.full(len(hashes), -1)
    kinds, first = np.unique(to, return_index=True)
    borders = np.append(first, len(hashes))
    for bucket, a, b in zip(kinds, borders[:-1], borders[1:], strict=True):
        keys = arrays[int(bucket)]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
            place[a:b] = np.where(keys[at] == hashes[a:b], at, -1)
    return place, borders


# --- texts ------------------------------------------------------------------------------------------------------


def tokens(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with the ends, document of each) for a batch."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(raw), np.uint8)]
    hashes, start, _ = word_hashes(data, powers)
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(ends, start, "right")
    at = np.searchsorted(doc, np.arange(len(raw)), "right")
    return np.insert(hashes, at, END), np.insert(doc, at, np.arange(len(raw)))


def word_ids(layout: Layout, vocabulary: Arrays, hashes: np.ndarray) -> np.ndarray:
    """Ids of words, -1 for unknown ones."""
    kinds, back = np.unique(hashes, return_inverse=True)
    to = layout.bucket(kinds)
    place, _ = found(vocabulary, kinds, to)
    return np.where(place >= 0, place + layout.starts[to], -1)[back]


def pair_keys(ids: np.ndarray, doc: np.ndarray, start: int) -> np.ndarray:
    """Key of every word with the one in front, `start` at the head of a text."""
    front = np.where(np.diff(doc, prepend=-1) != 0, start, np.concatenate(([start], ids[:-1])))
    return front.astype(np.uint64) << np.uint64(32) | (ids.astype(np.uint64) & np.uint64(0xFFFFFFFF))


def counted(texts: DataFrame, keys_of: Callable, bucket_of: Callable) -> DataFrame:
    """(bucket, blob): keys of all texts with their counts, added up within a task."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held, n, state = Powers(), [], 0, {}

        def flush() -> pd.DataFrame:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame(list(dealt(keys, bucket_of(keys), counts)), columns=["bucket", "blob"])

        for pdf in batches(frames, BATCH):
            if not len(pdf):
                continue
            held.append(keys_of(*tokens(pdf["text"].tolist(), powers), state))
            n += len(held[-1])
            if n >= HELD_WORDS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return texts.select("text").mapInPandas(of, "bucket int, blob binary")


# --- the model ----------------------------------------------------------------------------------------------------


class Model:
    """Numbers of the model; everything that grows with the vocabulary lies in the files."""

    def __init__(self, layout: Layout, pair_files: set[int], total: int, pair_marks: np.ndarray, word_marks: np.ndarray, kinds: int) -> None:
        self.layout, self.pair_files = layout, pair_files
        self.tokens, self.words, self.kinds = total, layout.words, kinds
        self.pair_cut, self.word_cut = discounts(pair_marks), discounts(word_marks)
        #: Share of the continuation counts that is set free for words without any.
        self.free = float((word_marks[:2] @ self.word_cut[:2] + (word_marks[4]) * self.word_cut[2]) / kinds) if kinds else 1.0


def discounts(marks: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts from how many counts are 1, 2, 3, 4 (and, fifth, 3 or more)."""
    if (marks[:4] <= 0).any():
        return np.full(3, 0.5)
    y = marks[0] / (marks[0] + 2 * marks[1])
    return np.clip([i - (i + 1) * y * marks[i] / marks[i - 1] for i in (1, 2, 3)], 0.0, [1.0, 2.0, 3.0])


def marks_of(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and 3 or more."""
    return [*(int((counts == i).sum()) for i in (1, 2, 3, 4)), int((counts >= 3).sum())]


def cut(counts: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, by[np.clip(counts.astype(np.int64), 1, 3) - 1], 0.0)


def learn(docs: DataFrame) -> Model:
    """Count the texts of `docs` (column text) and write the model's files."""
    spark = docs.sparkSession
    folder = work_path(spark, "kneser-ney")
    bits = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    plain = Layout(folder, bits, {})

    def save_words(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        keys, counts = joined(pdf["blob"], 1)
        save(f"{folder}/words-{bucket}", keys)
        save(f"{folder}/counts-{bucket}", counts)
        return pd.DataFrame({"bucket": [bucket], "words": [len(keys)], "tokens": [int(counts.sum())]})

    words = counted(docs, lambda hashes, _doc, _state: hashes, plain.bucket)
    sizes = words.groupBy("bucket").applyInPandas(save_words, "bucket int, words long, tokens long").collect()
    layout = Layout(folder, bits, {r["bucket"]: r["words"] for r in sizes})
    start = layout.words
    if start >= (1 << 32) - 1:
        raise ValueError("more than 2^32 distinct words: give pairs wider keys")

    def pairs_of(hashes: np.ndarray, doc: np.ndarray, state: dict) -> np.ndarray:
        vocabulary = state.setdefault("words", Arrays(folder, "words", "<u8", set(layout.sizes)))
        return pair_keys(word_ids(layout, vocabulary, hashes), doc, start)

    def save_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        keys, counts = joined(pdf["blob"], 1)
        hashes = mix(keys)
        order = np.argsort(hashes)
        save(f"{folder}/pairs-{bucket}", hashes[order])
        if len(counts) and counts.max() > 0xFFFFFFFF:
            raise ValueError("a pair of words occurs more often than its four bytes hold")
        save(f"{folder}/paircounts-{bucket}", counts[order].astype("<u4"))
        rows = [("pairs", bucket, b"", [len(keys), *marks_of(counts)])]
        front, last = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        ones = [(counts == 1).astype(np.uint64), (counts == 2).astype(np.uint64), (counts >= 3).astype(np.uint64)]
        context = add_up(front, counts, *ones)
        rows += [("context", b, blob, None) for b, blob in dealt(context[0], layout.home(context[0]), *context[1:])]
        behind = add_up(last, np.ones(len(last), np.uint64))
        rows += [("behind", b, blob, None) for b, blob in dealt(behind[0], layout.home(behind[0]), behind[1])]
        return pd.DataFrame(rows, columns=["kind", "bucket", "blob", "marks"])

    pairs = counted(docs, pairs_of, lambda keys: layout.bucket(mix(keys)))
    said = stored(pairs.groupBy("bucket").applyInPandas(save_pairs, "kind string, bucket int, blob binary, marks array<long>"), "pairs")
    marks = said.where("kind = 'pairs'").select("bucket", "marks").collect()
    pair_marks = np.sum([r["marks"] for r in marks], axis=0) if marks else np.zeros(6)
    by = discounts(pair_marks[1:])

    def save_ids(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = pdf["kind"].iloc[0], int(pdf["bucket"].iloc[0])
        low, size = int(layout.starts[bucket]), int(layout.sizes.get(bucket, 0)) + (bucket == (1 << bits) - 1)
        if kind == "context":
            ids, total, *ones = joined(pdf["blob"], 4)
            dense = np.zeros((2, size))
            dense[0, ids.astype(np.int64) - low] = total
            dense[1, ids.astype(np.int64) - low] = by @ np.array(ones, float) / total
            save(f"{folder}/context-{bucket}", dense[0])
            save(f"{folder}/weight-{bucket}", dense[1])
            return pd.DataFrame({"kind": [kind], "bucket": [bucket], "marks": [[0] * 5]})
        ids, before = joined(pdf["blob"], 1)
        dense = np.zeros(size)
        dense[ids.astype(np.int64) - low] = before
        save(f"{folder}/behind-{bucket}", dense)
        return pd.DataFrame({"kind": [kind], "bucket": [bucket], "marks": [marks_of(before)]})

    ids = said.where("kind <> 'pairs'").groupBy("kind", "bucket").applyInPandas(save_ids, "kind string, bucket int, marks array<long>").collect()
    word_marks = np.sum([r["marks"] for r in ids], axis=0) if ids else np.zeros(5)
    model = Model(layout, {r["bucket"] for r in marks}, sum(r["tokens"] for r in sizes), pair_marks[1:], word_marks, int(pair_marks[0]))
    model.files = {k: {r["bucket"] for r in ids if r["kind"] == k} for k in ("context", "behind")}
    return model


class Reader:
    """A worker's view of the model."""

    def __init__(self, model: Model) -> None:
        self.model, layout = model, model.layout
        at = lambda name, kind, there: Arrays(layout.folder, name, kind, there)
        own = set(layout.sizes)
        self.words, self.counts = at("words", "<u8", own), at("counts", "<u8", own)
        self.context, self.weight = at("context", "<f8", model.files["context"]), at("weight", "<f8", model.files["context"])
        self.behind = at("behind", "<f8", model.files["behind"])
        self.pairs, self.paircounts = at("pairs", "<u8", model.pair_files), at("paircounts", "<u4", model.pair_files)

    def by_id(self, arrays: Arrays, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids."""
        out = np.zeros(len(ids))
        if not len(ids):
            return out
        to = self.model.layout.home(ids)
        kinds, first = np.unique(to, return_index=True)
        for bucket, a, b in zip(kinds, first, [*first[1:], len(ids)], strict=True):
            values = arrays[int(bucket)]
            if len(values):
                out[a:b] = values[ids[a:b] - self.model.layout.starts[bucket]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        hashes = mix(keys)
        order = np.argsort(hashes)
        to = self.model.layout.bucket(hashes[order])
        place, borders = found(self.pairs, hashes[order], to)
        counts = np.zeros(len(keys))
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            hit = place[a:b] >= 0
            if hit.any():
                counts[order[a:b][hit]] = self.paircounts[int(to[a])][place[a:b][hit]]
        return counts

    def score(self, texts: list[str | None], powers: Powers) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of each text."""
        model, n = self.model, len(texts)
        hashes, doc = tokens(texts, powers)
        ids = word_ids(model.layout, self.words, hashes)
        kinds, back = np.unique(ids, return_inverse=True)
        known = kinds >= 0
        count, behind = np.zeros(len(kinds)), np.zeros(len(kinds))
        count[known] = self.by_id(self.counts, kinds[known])
        behind[known] = self.by_id(self.behind, kinds[known])
        base = np.log10((count + 1) / (model.tokens + model.words + 1))
        single = (behind - cut(behind, model.word_cut)) / max(model.kinds, 1) + model.free / (model.words + 1)
        front = np.where(np.diff(doc, prepend=-1) != 0, model.words, np.concatenate(([-1], ids[:-1])))
        fronts, front_back = np.unique(front, return_inverse=True)
        seen = fronts >= 0
        total, weight = np.zeros(len(fronts)), np.ones(len(fronts))
        total[seen] = self.by_id(self.context, fronts[seen])
        weight[seen] = np.where(total[seen] > 0, self.by_id(self.weight, fronts[seen]), 1.0)
        prob = weight[front_back] * single[back]
        both = np.flatnonzero((ids >= 0) & (total[front_back] > 0))
        keys = front[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64)
        pair, pair_back = np.unique(keys, return_inverse=True)
        counts = self.pair_counts(pair)[pair_back]
        prob[both] += (counts - cut(counts, model.pair_cut)) / total[front_back[both]]
        sums = lambda x: np.bincount(doc, x, n)
        return pd.DataFrame({"n_tokens": np.bincount(doc, minlength=n), "n_known": sums(ids >= 0).astype(np.int64),
                             "train_tokens": model.tokens, "base_score": sums(base[back]), "score": sums(np.log10(prob))})


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, powers = Reader(model), Powers()
        for pdf in batches(frames, BATCH):
            if len(pdf):
                out = reader.score(pdf["text"].tolist(), powers)
                yield pd.concat([pdf[["id", "held_out"]].reset_index(drop=True), out], axis=1)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    schema = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = rows.mapInPandas(of, schema)
    return out.select(F.col("id").cast(id_type).alias("doc_id"), *out.columns[1:])


def op10_kneser_ney_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document scored by the model of the training part."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs.where(fold("doc_id", FOLDS) != HELD_OUT)))

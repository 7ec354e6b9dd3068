"""Tokens of two tokenizers aligned by the bytes they cover.

A text's tokens end at ascending byte offsets under either tokenizer, and both lists end at the same byte. Merging the
two lists walks through all overlaps: every offset at which a token ends closes the overlap of the A and the B token
that hold the byte before it, and an offset at which both end closes a group. A merge path cuts the walk anywhere into
pieces of equal work: a binary search on each diagonal i + j = d finds how many ends of either list come first, and
pieces are merged without the others. A piece starts with the last end before it, so that an offset that A and B share
is seen as one where the cut falls between them; groups are stitched from the shared ends of all pieces. The texts of
an Arrow batch are merged as one, as a text's end is always a shared one, so that short and long texts make equal pieces.

Counts of linked id pairs over all texts take a second pass. Texts are not encoded again for it: blocks of at most
`BLOCK_LINKS` links are kept as indices into the block's own list of id pairs, lists and counts of all blocks are summed
by Spark, and the sums are joined back to the lists. Nothing of the size of the corpus or of all pairs is held in a task.

Results for odd rows: null and empty texts, and texts whose tokens' bytes differ from blank + text, have no tokens: zeros
and an empty digest; a null doc_id is returned; repeated rows are aligned one by one, their links count each; an empty
table gives no rows; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from livetick.llm.bpe_stream import byte_alphabet
from livetick.llm.common import stored, table
from livetick.llm.words import Flat, WordCache, byte_level_cache, flat, pieces

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ends of both lists that one piece of a merge takes.
PIECE_ENDS = 1 << 16
BLOCK_LINKS = 1 << 22
#: Bytes of text that are encoded and aligned at a time (one text at least).
BATCH_BYTES = 1 << 21
#: B's ids lie above A's where both are in one array.
_B = 1 << 20


# --- tokenizers ---------------------------------------------------------------------------------------------


def bytes_of_a(path: str) -> list[bytes]:
    """The bytes of every token of a byte-level file, by id."""
    names = Tokenizer.from_file(path).get_vocab()
    value = {letter: b for b, letter in enumerate(byte_alphabet())}
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = bytes(value[c] for c in name) if all(c in value for c in name) else name.encode()
    return out


def bytes_of_b(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of every piece, by id: U+2581 is a blank, byte pieces are their byte."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


class PairTokenizer:
    """Ids of blank + text under both tokenizers.

    B's pieces hold no blank behind another character, as A's words do not, so one cache of words serves both: a part
    has A's ids and then B's. Bytes are compared part by part; as neither tokenizer changes letters other than U+2581,
    which it takes for a blank, a text's bytes agree if those of all its parts do.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        a = byte_level_cache(path_a, open_start=False, plain_specials=True)
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        tables = bytes_of_a(path_a), bytes_of_b(b)
        if any(" " in p.strip(" ") for p in (t.decode("utf-8", "replace") for t in tables[1])):
            raise ValueError("pieces with a blank inside")
        self.sizes = np.zeros(_B + len(tables[1]), np.int32)
        self.sizes[: len(tables[0])], self.sizes[_B:] = list(map(len, tables[0])), list(map(len, tables[1]))
        joined = {i: t for i, t in enumerate(tables[0])} | {_B + i: t for i, t in enumerate(tables[1])}

        def both(of_a: Flat, of_b: list[list[int]]) -> Flat:
            ids_b, n_b = flat(of_b)
            n = of_a[1] + n_b
            out = np.empty(int(n.sum()), np.uint32)
            is_b = np.zeros(len(n) * 2, bool)
            is_b[1::2] = True
            is_b = np.repeat(is_b, np.stack([of_a[1], n_b], axis=1).ravel())
            out[~is_b], out[is_b] = of_a[0], ids_b + _B
            return out, n

        def check(parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            at, agree, values = 0, [], ids.tolist()
            for part, n in zip(parts, lengths.tolist(), strict=True):
                own, want = values[at : at + n], part.encode()
                at += n
                agree.append(b"".join([joined[i] for i in own]) == want + want and
                             b"".join([joined[i] for i in own if i < _B]) == want)
            return np.array(agree, bool)

        self.cache = WordCache(
            lambda texts: both(a.whole(texts), b.encode([t[1:] for t in texts], num_threads=1)),
            lambda new: both(a.words(new), b.encode(new, num_threads=1)), False, check)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of all texts in a row, how many each text has, and B's likewise; texts without tokens have none."""
        found = self.cache.encode(texts)
        kept = found.passed & pc.greater(pc.binary_length(pc.fill_null(texts, "")), 0).to_numpy(zero_copy_only=False)
        ids, owner = found.ids, np.repeat(np.arange(len(kept)), found.lengths)
        if not kept.all():
            held = kept[owner]
            ids, owner = ids[held], owner[held]
        is_b = ids >= _B
        n_b = np.bincount(owner[is_b], minlength=len(kept))
        return ids[~is_b], np.bincount(owner, minlength=len(kept)) - n_b, ids[is_b], n_b


@lru_cache(maxsize=1)
def worker_tokenizer(path_a: str, path_b: str) -> PairTokenizer:
    return PairTokenizer(path_a, path_b)


# --- merging ------------------------------------------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first `at` ends of the merged lists are A's; equal ends come A first. All searches at once."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(at), bool)
        first[open_] = a[middle[open_]] <= b[at[open_] - 1 - middle[open_]]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low


class Piece(NamedTuple):
    """Places in A and B of the tokens of each link, in order of their ends, and of the tokens that end together."""

    link_a: np.ndarray
    link_b: np.ndarray
    shared_a: np.ndarray
    shared_b: np.ndarray


def merged(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> Piece:
    """The ends a[i] and b[j] merged; of what lies before, only A's last end is looked at."""
    own_a, own_b = a[i[0] : i[1]], b[j[0] : j[1]]
    beside_a = np.searchsorted(own_b, own_a, "left")
    beside_b = np.searchsorted(own_a, own_b, "right")
    before = i[0] + beside_b - 1
    both = (before >= 0) & (a[before] == own_b)
    alone = ~both
    place = np.empty(len(own_a) + int(alone.sum()), np.int32)
    link_a, link_b = np.empty_like(place), np.empty_like(place)
    # A's own links, and those of B's ends that A does not share, each at its place among the links.
    skipped = np.concatenate(([0], np.cumsum(both)))
    at_a = np.arange(len(own_a)) + beside_a - skipped[beside_a]
    at_b = (np.arange(len(own_b)) + beside_b - skipped[:-1])[alone]
    link_a[at_a], link_b[at_a] = np.arange(i[0], i[1]), j[0] + beside_a
    link_a[at_b], link_b[at_b] = i[0] + beside_b[alone], j[0] + np.flatnonzero(alone)
    return Piece(link_a, link_b, before[both], j[0] + np.flatnonzero(both))


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE_ENDS) -> Piece:
    """All links and shared ends, piece by piece along the merge path."""
    total = len(a) + len(b)
    cuts = np.append(np.arange(0, total, piece), total)
    i = diagonals(a, b, cuts)
    j = cuts - i
    found = [merged(a, b, (i[k], i[k + 1]), (j[k], j[k + 1])) for k in range(len(cuts) - 1)]
    return Piece(*(np.concatenate(c) for c in zip(*found))) if found else Piece(*(np.zeros(0, np.int32) for _ in range(4)))


def _digits(most: int) -> np.ndarray:
    """Decimal digits of 0 to `most`, padded with zero bytes."""
    return np.array([str(i) for i in range(most + 1)], "S").view(np.uint8).reshape(most + 1, -1)


_DIGITS = _digits(65_535)


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, shared_a: np.ndarray, shared_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of all groups, each ended by a semicolon, and where the text of each group ends."""
    in_a, in_b = shared_a + 1, shared_b + 1
    n_a, n_b = np.diff(in_a, prepend=0), np.diff(in_b, prepend=0)
    at_a = np.arange(len(ids_a)) + np.repeat(in_b - n_b, n_a)
    at_b = np.arange(len(ids_b)) + np.repeat(in_a, n_b)
    text = np.empty((len(ids_a) + len(ids_b), _DIGITS.shape[1] + 1), np.uint8)
    text[at_a, :-1], text[at_b, :-1] = _DIGITS[ids_a], _DIGITS[ids_b]
    text[:, -1] = ord(",")
    text[at_a[shared_a], -1], text[at_b[shared_b], -1] = ord("|"), ord(";")
    used = text != 0
    ends = np.cumsum(used.sum(axis=1))
    return text[used], ends[at_b[shared_b]]


# --- documents ----------------------------------------------------------------------------------------------

_ENTRY = pa.struct([("uid", pa.int64()), ("head", pa.bool_()), ("links", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()),
                    ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_BLOCK = pa.schema([("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("links", pa.binary()),
                    ("entries", pa.list_(_ENTRY))])
_BLOCK_SQL = ("block long, pairs array<long>, counts array<long>, links binary, entries array<struct<uid: long, head: boolean, links: long, "
              "doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>")


def _block(number: int, pair: np.ndarray, entries: list[dict]) -> pa.RecordBatch:
    """Links as places in the list of the block's pairs; frequent pairs come first, so that places are small numbers."""
    coded = pa.array(pair).dictionary_encode()
    places = coded.indices.to_numpy()
    counts = np.bincount(places, minlength=len(coded.dictionary))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    links = rank[places].astype("<u2" if len(order) <= 1 << 16 else "<u4").tobytes()
    row = {"block": number, "pairs": coded.dictionary.to_numpy()[order], "counts": counts[order], "links": links, "entries": entries}
    return pa.RecordBatch.from_pylist([row], _BLOCK)


def blocks(docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS, piece_ends: int = PIECE_ENDS) -> DataFrame:
    """All documents encoded and aligned: blocks of links, and what is known of each document from itself alone.

    A block holds links of several documents, or a part of those of a long one; the document's facts are in the block
    of its first link.
    """

    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path_a, path_b)
        uid = number = TaskContext.get().partitionId() << 40
        for frame in frames:
            for batch in pieces(frame, 1, BATCH_BYTES):
                ids_a, n_a, ids_b, n_b = tokenizer.encode(batch.column(1))
                found = align(*(np.cumsum(tokenizer.sizes[ids], dtype=np.int64) for ids in (ids_a, ids_b)), piece_ends)
                ids_b = ids_b - _B
                text, group_ends = group_text(ids_a, ids_b, found.shared_a, found.shared_b)
                ends_a = np.cumsum(n_a)
                links, groups = np.searchsorted(found.link_a, ends_a), np.searchsorted(found.shared_a, ends_a)
                text_ends = np.concatenate(([0], group_ends))[groups]
                facts, first = [], 0
                for d, doc_id in enumerate(batch.column(0).to_pylist()):
                    low = int(text_ends[d - 1]) if d else 0
                    facts.append({"doc_id": doc_id, "n_a": int(n_a[d]), "n_b": int(n_b[d]), "n_groups": int(groups[d] - (groups[d - 1] if d else 0)),
                                  "n_links": int(links[d]) - first,
                                  "groups_sha256": hashlib.sha256(text[low : text_ends[d] - 1]).hexdigest() if n_a[d] else ""})
                    first = int(links[d])
                pair = ids_a[found.link_a].astype(np.int64) << 32 | ids_b[found.link_b]
                starts = np.concatenate(([0], links[:-1]))
                cuts = [*range(0, max(1, len(pair)), block_links)]
                for low in cuts:
                    high = low + block_links
                    is_head = (starts >= low) & ((starts < high) | (low == cuts[-1]))
                    own = np.maximum(0, np.minimum(links, high) - np.maximum(starts, low))
                    entries = [{"uid": uid + int(d), "head": bool(is_head[d]), "links": int(own[d]), **(facts[d] if is_head[d] else {})}
                               for d in np.flatnonzero(is_head | (own > 0))]
                    yield _block(number, pair[low:high], entries)
                    number += 1
                uid += batch.num_rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, _BLOCK_SQL)


def pair_counts(block_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, place, pair, c) of every pair of every block, and (pair, count, best) over all of them.

    B's ids are as many as its vocabulary has, whatever the corpus: the highest counts by B id are a bounded table.
    """
    held = block_rows.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("c"))
    sums = held.groupBy("pair").agg(F.sum("c").alias("count")).withColumn("b", F.expr("pair & 4294967295L"))
    highest = sums.groupBy("b").agg(F.max("count").alias("highest"))
    return held, sums.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


_OUT = [(f.name, f.type) for f in _ENTRY if f.name != "links"] + [("n_best", pa.int64()), ("count_sum", pa.int64())]
_OUT_SQL = ("uid long, head boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _summed(known: pa.Table, own: pa.Table) -> pa.Table:
    """Sums over the links of each document of one block."""
    row = own.to_pylist()[0]
    place = known.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = known.column("count").to_numpy(), known.column("best").to_numpy()
    links = np.frombuffer(row["links"], "<u2" if len(place) <= 1 << 16 else "<u4")
    ends = np.cumsum([e["links"] for e in row["entries"]])
    for name, values in (("n_best", best), ("count_sum", count)):
        upto = np.concatenate(([0], np.cumsum(values[links])))[ends]
        for e, total in zip(row["entries"], np.diff(upto, prepend=0).tolist(), strict=True):
            e[name] = total
    return pa.Table.from_pylist(row["entries"], pa.schema(_OUT))


def aligned(docs: DataFrame, path_a: str, path_b: str, **sizes: int) -> DataFrame:
    """One row for every document: tokens, groups and links, and how its links count in the whole corpus."""
    block_rows = stored(blocks(docs, path_a, path_b, **sizes), "token-links", compression="zstd")
    held, known = pair_counts(block_rows)
    met = held.join(known, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    parts = met.groupBy("of").cogroup(block_rows.select("block", "links", "entries").groupBy("block")).applyInArrow(_summed, _OUT_SQL)
    facts = F.max(F.struct("head", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")).alias("f")
    return parts.groupBy("uid").agg(facts, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).select(
        "f.doc_id", "f.n_a", "f.n_b", "f.n_groups", "f.n_links", "n_best", "count_sum", "f.groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of the two public tokenizers aligned with each other."""
    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL_A), public_tokenizers.path(MODEL_B))

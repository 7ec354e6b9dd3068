"""Ids of whole texts, looked up by word.

A tokenizer whose pieces never hold a blank behind another character gives a text the ids of its parts, wherever the
text is cut before a single blank that stands between two characters that are no white space. Such parts repeat a lot:
an Arrow batch is split on blanks and made distinct there, each new part is encoded once, and the ids of all texts are
gathered by array indexing. Parts that hold, begin or end with other white space, or runs of blanks, are kept together
with what they touch, so that every cut is one the tokenizer makes as well, and are encoded as they stand.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Parts and ids a worker remembers before it forgets those met in one piece only; the bounds cost time alone.
REMEMBERED, REMEMBERED_IDS = 600_000, 1 << 23
#: New words that are encoded in one text.
NEW_WORDS = 2000
#: Bytes of text that are encoded at a time (one text at least).
PIECE_BYTES = 1 << 23


class Encoded(NamedTuple):
    """Ids of several texts in a row, the number of ids of each, and whether all parts of a text passed the check."""

    ids: np.ndarray
    lengths: np.ndarray
    passed: np.ndarray


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of lengths[0] places, then those from starts[1] on, and so forth."""
    ends = np.cumsum(lengths, dtype=np.int32)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of the text column, one row at least."""
    sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    borders = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(borders, borders[1:]):
        if high > low:
            yield batch.slice(low, high - low)


Flat = tuple[np.ndarray, np.ndarray]  # ids of several parts in a row, and the number of ids of each


def flat(found: list) -> Flat:
    lengths = np.fromiter(map(len, found), np.int32, len(found))
    return np.fromiter((i for f in found for i in f), np.uint32, int(lengths.sum())), lengths


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((max(size, 2 * len(a)), *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class WordCache:
    """`whole` encodes texts as they stand. `words` encodes words, each with a blank before it; they hold no blank and
    neither begin nor end with white space. With `open_start` a text's first part has no blank before it; else every
    text counts as headed by one. `check` says of parts (with their blanks) and their ids which agree."""

    def __init__(self, whole: Callable[[list[str]], Flat], words: Callable[[list[str]], Flat], open_start: bool,
                 check: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        self.whole, self.words, self.open_start, self.check = whole, words, open_start, check
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.n = self.used = 0
        self.start, self.length, self.store = (np.zeros(1 << 14, t) for t in (np.int32, np.int32, np.uint32))
        #: Whether a part begins and ends with a character that is no white space, and whether it passed the check.
        self.opens, self.ends, self.good = (np.zeros(1 << 14, bool) for _ in range(3))
        #: Pieces a part was met in since it was last sorted out.
        self.met = np.zeros(1 << 14, np.int32)

    def _forget(self) -> None:
        """Keep the parts met in several pieces, if they are few enough to make room."""
        kept = np.flatnonzero(self.met[: self.n] > 1)
        lengths = self.length[kept]
        if len(kept) > REMEMBERED // 2 or lengths.sum() > REMEMBERED_IDS // 2:
            kept = kept[:0]
        keys, ids = list(self.slot), self.store[spread(self.start[kept], self.length[kept])]
        keys, found = [keys[k] for k in kept.tolist()], (ids, self.length[kept])
        flags = self.opens[kept], self.ends[kept], self.good[kept]
        self._clear()
        self._add(keys, found, *flags)

    def _add(self, keys: list[str], found: Flat, opens: np.ndarray | bool, ends: np.ndarray | bool,
             good: np.ndarray | bool | None = None) -> None:
        ids, lengths = found
        n, used = self.n + len(keys), self.used + len(ids)
        if n > len(self.start):
            for name in ("start", "length", "opens", "ends", "good", "met"):
                setattr(self, name, _grown(getattr(self, name), n))
        if used > len(self.store):
            self.store = _grown(self.store, used)
        own = slice(self.n, n)
        self.store[self.used : used] = ids
        self.length[own] = lengths
        self.start[own] = self.used + np.cumsum(lengths) - lengths
        self.opens[own], self.ends[own] = opens, ends
        if good is None:
            good = True if self.check is None else self.check([" " + k for k in keys], ids, lengths)
        self.good[own] = good
        self.slot.update(zip(keys, range(self.n, n), strict=True))
        self.n, self.used = n, used

    def _slots(self, parts: list[str]) -> np.ndarray:
        """The places of parts in the store; new ones are encoded."""
        get = self.slot.get
        places = np.fromiter((get(p, -1) for p in parts), np.int32, len(parts))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = pa.array([parts[i] for i in missing.tolist()], pa.string())
            some = pc.greater(pc.binary_length(new), 0)
            opens, ends = (pc.and_(pc.equal(trim(new), new), some).to_numpy(zero_copy_only=False) for trim in (
                pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace))
            one = pc.invert(pc.match_substring(new, " ")).to_numpy(zero_copy_only=False)
            simple = opens & ends & one
            order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
            places[missing[order]] = self.n + np.arange(len(order))
            if simple.any():
                keys = new.filter(pa.array(simple)).to_pylist()
                self._add(keys, self.words(keys), True, True)
            if not simple.all():
                keys = new.filter(pa.array(~simple)).to_pylist()
                self._add(keys, self.whole([" " + k for k in keys]), opens[~simple], ends[~simple])
        return places

    def encode(self, texts: pa.Array) -> Encoded:
        """Ids of all texts; nulls count as empty."""
        if self.n > REMEMBERED or self.used > REMEMBERED_IDS:
            self._forget()
        count = len(texts)
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        index, values = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        slots = self._slots(values)
        self.met[slots] += 1
        slots = slots[index]
        first = np.cumsum(sizes) - sizes
        # A part begins where the word and the one before it are firm, and at every text's start.
        begins = np.ones(len(slots), bool)
        np.logical_and(self.opens[slots[1:]], self.ends[slots[:-1]], out=begins[1:])
        begins[first] = True

        def text(low: int, high: int) -> str:
            return " ".join([values[i] for i in index[low:high].tolist()])

        if begins.all():
            at, part, heads = None, slots, first
        else:
            at = np.flatnonzero(begins)
            until = np.append(at[1:], len(slots))
            part = slots[at]
            joined = np.flatnonzero(until - at > 1)
            part[joined] = self._runs([text(at[j], until[j]) for j in joined])
            heads = np.searchsorted(at, first)
        sizes = np.diff(heads, append=len(part))
        lengths, starts, store = self.length[part], self.start[part], self.store
        if self.open_start:  # first parts stand without a blank
            opened = [text(i, i + 1) if at is None else text(at[h], until[h]) for i, h in zip(first, heads, strict=True)]
            ids, own = self.whole(opened)
            lengths[heads], starts[heads] = own, self.used + np.cumsum(own) - own
            store = np.concatenate([store[: self.used], ids])
        totals = np.add.reduceat(lengths, heads, dtype=np.int64) if count else np.zeros(0, np.int64)
        passed = np.logical_and.reduceat(self.good[part], heads) if count else np.zeros(0, bool)
        return Encoded(store[spread(starts, lengths)], totals, passed)

    def _runs(self, runs: list[str]) -> np.ndarray:
        """Places of parts among which some may repeat."""
        distinct = {r: k for k, r in enumerate(dict.fromkeys(runs))}
        return self._slots(list(distinct))[np.fromiter(map(distinct.__getitem__, runs), np.int64, len(runs))]


def byte_level_cache(path: str, open_start: bool, plain_specials: bool = False,
                     check: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray] | None = None) -> WordCache:
    """Ids of a byte-level BPE file of the tokenizers library. Its split never joins what stands before a blank with
    what follows, and a blank goes with the word behind it. New words are encoded many at a time, in one text, and told
    apart by the blank that heads each. With `plain_specials` the strings of special tokens are ordinary text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = plain_specials
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    level = spec["pre_tokenizer"]
    if level["type"] != "ByteLevel" or level["add_prefix_space"] or spec["normalizer"] is not None:
        raise ValueError("a byte-level file without normalizer and prefix is needed")
    names = tokenizer.get_vocab()
    heads = np.zeros(max(names.values()) + 1, bool)
    for name, i in names.items():
        heads[i] = name.startswith("\u0120")  # the byte alphabet's letter of the blank

    def whole(texts: list[str]) -> Flat:
        return flat([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def words(new: list[str]) -> Flat:
        ids, lengths = [], []
        for at in range(0, len(new), NEW_WORDS):
            own, _ = whole([" " + " ".join(new[at : at + NEW_WORDS])])
            ids.append(own)
            lengths.append(np.diff(np.flatnonzero(heads[own]), append=len(own)).astype(np.int32))
        found = np.concatenate(ids), np.concatenate(lengths)
        if len(found[1]) != len(new):
            raise ValueError("words and their ids differ in number")
        return found

    return WordCache(whole, words, open_start, check)

"""BPE encoding with bounded lookahead, and incremental decoding.

`lookahead` derives from the merge list how many symbols beyond a token can still change it. `MergeTransducer` emits
the tokens of one word as soon as that many symbols have followed, so that a word of any length is encoded within a
bounded window; `TextEncoder` finds the words of a text as the tokenizer file prescribes and remembers short ones.
`Decoder` turns ids back into text piece by piece.

Supported files: BPE models over the byte alphabet, with or without word ends, as described by the JSON file's
normalizer and split pattern. Ids equal those of the tokenizers library without special tokens added.

Results for odd rows: a null text counts as empty and gives no tokens; a null id is returned; repeated rows are
encoded one by one; an empty table gives no rows; other columns are ignored. A text is encoded whole, whatever its length.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from livetick.llm.common import batches, table

MODEL = "word_bpe_49k.json"
BATCH = 256
#: Words longer than this go through the transducer and are not remembered.
LONG_WORD = 64
#: Words a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: The byte level's split where a file asks for it; white space as the Unicode property defines it.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def split_pattern(text: str) -> regex.Pattern:
    return regex.compile(text.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Merges:
    """Vocabulary and merge list of a tokenizer file, by id."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str) -> None:
        self.word_end, self.vocab = word_end, vocab
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list | tuple) else pair.split(" ")
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        letters = byte_alphabet()
        self.inner = [vocab.get(c, -1) for c in letters]
        self.last = [vocab.get(c + word_end, -1) for c in letters] if word_end else self.inner
        self.size = {i: max(1, len(t.removesuffix(word_end) if word_end else t)) for t, i in vocab.items()}

    def symbols(self, data: bytes, closed: bool) -> list[int]:
        """Ids of single bytes; the last one carries the word end if the word is closed. Unknown ones are left out."""
        ids = [self.inner[b] for b in data]
        if closed and ids:
            ids[-1] = self.last[data[-1]]
        return [i for i in ids if i >= 0]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge pairs in order of rank, the leftmost first."""
        pairs = self.pairs
        if len(ids) <= 24:
            ids = list(ids)
            while len(ids) > 1:
                best, at = None, -1
                for i in range(len(ids) - 1):
                    found = pairs.get((ids[i], ids[i + 1]))
                    if found is not None and (best is None or found[0] < best[0]):
                        best, at = found, i
                if best is None:
                    break
                ids[at : at + 2] = [best[1]]
            return ids
        n, ids = len(ids), list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get((ids[i], ids[k])):
                    heapq.heappush(heap, (p[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (p := pairs.get((ids[h], ids[i]))):
                heapq.heappush(heap, (p[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]


def lookahead(merges: Merges) -> int:
    """Symbols beyond a place that can decide whether a token ends there.

    A merge (p, q) can only be undone from the right by an earlier merge that takes q away, (q, s), or by what keeps
    q or p from being formed, again earlier merges. `reach` is how far beyond the end of p+q such causes can lie;
    ranks fall along every chain, so one pass in order of rank finds the longest.
    """
    reach: dict[int, int] = {}  # by token: the farthest cause for its forming
    taken: dict[int, int] = {}  # by token: the farthest cause for its being taken by an earlier merge to its right
    most = 0
    for (left, right), (_, made) in sorted(merges.pairs.items(), key=lambda x: x[1][0]):
        own = max(taken.get(right, 0), reach.get(right, 0), reach.get(left, 0) - merges.size[right], 0)
        reach[made] = max(reach.get(made, 0), own)
        taken[left] = max(taken.get(left, 0), merges.size[right] + own)
        most = max(most, merges.size[right] + own)
    return most


class MergeTransducer:
    """Tokens of one word, emitted once nothing that may follow can change them."""

    def __init__(self, merges: Merges, ahead: int, window: int | None = None) -> None:
        self.merges, self.ahead = merges, ahead
        self.window = window or max(1024, 4 * ahead)
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) > self.window + self.ahead:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        end, limit = 0, len(self.held) - self.ahead
        for token in self.merges.merge(self.merges.symbols(bytes(self.held), False)):
            size = self.merges.size[token]
            if end + size > limit:
                break
            end += size
            yield token
        del self.held[:end]

    def finish(self) -> Iterator[int]:
        data, self.held = bytes(self.held), bytearray()
        yield from self.merges.merge(self.merges.symbols(data, True))


class TextEncoder:
    """Ids of whole texts, as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.ahead = lookahead(self.merges)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        splits = [p["pattern"]["Regex"] for p in parts if p["type"] == "Split"]
        self.words = split_pattern(splits[0] if splits else BYTE_LEVEL_SPLIT)
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        if len(word) <= LONG_WORD:
            found = self.merges.merge(self.merges.symbols(data, True))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
            return found
        stream = MergeTransducer(self.merges, self.ahead)
        return [*stream.feed(data), *stream.finish()]

    def stream(self, text: str | None) -> Iterator[list[int]]:
        """The ids of the text, word by word."""
        known, word = self.known, self.word
        for piece in self.cut.split(text or "") if self.cut else [text or ""]:
            if piece in self.special:
                yield [self.special[piece]]
                continue
            if self.normalizer is not None:
                piece = self.normalizer.normalize_str(piece)
            for match in self.words.finditer(piece):
                w = match.group()
                found = known.get(w)
                yield word(w) if found is None else found

    def encode(self, text: str | None) -> np.ndarray:
        known, word, out = self.known, self.word, []
        for piece in self.cut.split(text or "") if self.cut else [text or ""]:
            if piece in self.special:
                out.append(self.special[piece])
                continue
            if self.normalizer is not None:
                piece = self.normalizer.normalize_str(piece)
            for w in self.words.findall(piece):
                found = known.get(w)
                out += word(w) if found is None else found
        return np.array(out, "<u4")


class Decoder:
    """Ids to text, piece by piece.

    `joined` is what the library's decode gives for a file without a decoder: the tokens' letters, parted by blanks.
    `plain` maps letters to bytes, word ends to blanks, and bytes to text through an incremental UTF-8 machine, which
    holds at most three bytes back between pieces.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        word_end = spec["model"]["end_of_word_suffix"] or ""
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        whole = {t["content"] for t in spec["added_tokens"]}
        self.bytes = [n.encode() if n in whole else
                      bytes(byte[c] for c in (n.removesuffix(word_end) if word_end else n) if c in byte)
                      + (b" " if word_end and n.endswith(word_end) else b"") for n in self.names]

    def joined(self, pieces: Iterator[np.ndarray]) -> Iterator[str]:
        started = False
        for ids in pieces:
            if len(ids):
                text = " ".join(map(self.names.__getitem__, ids.tolist()))
                yield f" {text}" if started else text
                started = True

    def plain(self, pieces: Iterator[np.ndarray]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in pieces:
            yield machine.decode(b"".join(map(self.bytes.__getitem__, ids.tolist())))
        yield machine.decode(b"", True)


#: Ids that are decoded and hashed at a time.
PIECE = 1 << 16


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, and the ids themselves if asked for."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, decoder = TextEncoder(path), Decoder(path)
        for pdf in batches(frames, BATCH):
            rows = []
            for text in pdf["text"]:
                ids = encoder.encode(text)
                decoded = hashlib.sha256()
                for part in decoder.joined(ids[at : at + PIECE] for at in range(0, len(ids), PIECE)):
                    decoded.update(part.encode("utf-8"))
                rows.append((len(ids), hashlib.sha256(ids).hexdigest(), decoded.hexdigest(), ids.astype(np.int32)))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out if with_ids else out.drop(columns="ids")

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = "id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(of, schema)
    rest = [c for c in out.columns if c != "id"]
    return out.select(F.col("id").cast(id_type).alias("doc_id"), *rest)


def op4_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded again; digests of both."""
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))

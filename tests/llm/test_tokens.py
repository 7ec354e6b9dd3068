"""Token files and the BPE transducer against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from livetick.llm import bpe_stream, dac, words

RANDOM = random.Random(5)
STRANGE = [
    "", " ", "  ", "a\n\nb  c   d", "a \nb", " lead", "tail ", "x\n y \t z", "<|endoftext|>hi <|startoftext|>there<|endoftext|>", "'S 't we'll x é 's",
    "a\x85 b\xa0c　d", "👍🏽 👨‍👩‍👧 ½²", "a\r\n b", "İstanbul ΣΑΣ ẞ", "数据处理没有空格" * 50, "é x́", "a" * 3000, "the" * 2000,
    *["".join(RANDOM.choice([" ", "\n", "a", "b", "1", ".", "'s", "é", "\t"]) for _ in range(80)) for _ in range(60)],
    *["".join(RANDOM.choice("etaoinshr") for _ in range(3000)) for _ in range(5)],
]


@pytest.fixture(scope="module")
def texts(documents):
    return [r["text"] for r in documents.limit(120).collect()] + STRANGE


def test_pack_and_read_single_tokens():
    ids = np.array([RANDOM.choice([0, 1, 255, 256, 50_000, 1 << 16, (1 << 32) - 1]) for _ in range(3000)], np.uint32)
    segment = dac.Segment(dac.pack(np.array([4, 9]), np.array([1000, 2000]), ids))
    assert (segment.all() == ids).all()
    assert [segment.token(i) for i in range(len(ids))] == ids.tolist()
    assert (segment.document(1) == ids[1000:]).all()
    assert dac.Segment(dac.pack(np.zeros(0), np.zeros(0, int), np.zeros(0, np.uint32))).all().tolist() == []


def test_cached_encoder(texts):
    path = public_tokenizers.path(dac.MODEL)
    library, own = Tokenizer.from_file(path), dac.CachedEncoder(path)
    for _ in range(2):
        for got, want in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert got.tolist() == want.ids


#: Every Unicode white space, characters Python alone takes for one, and what may stand beside them.
WHITE = [*" \n\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x1c\x1d\x1e\x1f\u200b\u180e\ufeff"]
BESIDE = [" ", " ", " ", "a", "b", "1", "!", "'s", "é", "<|endoftext|>", "数", "👍"]


def white_space_texts(count, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(pick.choice((WHITE, BESIDE, BESIDE))) for _ in range(pick.randrange(0, 30))) for _ in range(count)]


def test_runs_of_white_space_in_any_batch():
    """Ids never depend on what else is in the batch, nor on the words known before."""
    path = public_tokenizers.path(dac.MODEL)
    library, own = Tokenizer.from_file(path), dac.CachedEncoder(path)
    texts = white_space_texts(10_000, 1) + ["a \xa0 \xa0 b", "a111\xa0 \xa0\xa0!a", "!! b! \xa0 a "]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for size, order in ((7, range(len(texts))), (5000, reversed(range(len(texts))))):
        order = list(order)
        for at in range(0, len(order), size):
            part = order[at : at + size]
            for i, got in zip(part, own.encode([texts[i] for i in part]), strict=True):
                assert got.tolist() == want[i], texts[i]


def test_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(words, "REMEMBERED", 5)
    path = public_tokenizers.path(dac.MODEL)
    library, own = Tokenizer.from_file(path), dac.CachedEncoder(path)
    for text in white_space_texts(300, 2):
        assert own.encode([text, None])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("segment_tokens", [50, 1 << 18])
def test_token_files(spark, odd, none, documents, tmp_path, segment_tokens):
    library = Tokenizer.from_file(public_tokenizers.path(dac.MODEL))
    for k, docs in enumerate((odd, none, documents)):
        path = f"file://{tmp_path}/{k}"
        dac.write(docs, path, public_tokenizers.path(dac.MODEL), segment_tokens=segment_tokens)
        got = sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in dac.read(spark, path).collect())
        rows = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
        want, start = [], 0
        for i, text in rows:
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
            want.append((start, i, len(ids), zlib.crc32(ids)))
            start += len(ids)
        assert got == want


@pytest.mark.parametrize("model", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(texts, model):
    path = public_tokenizers.path(model)
    library, own, decoder = Tokenizer.from_file(path), bpe_stream.TextEncoder(path), bpe_stream.Decoder(path)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want
        assert [i for word in own.stream(text) for i in word] == want
        pieces = [np.array(want[at : at + 7], np.uint32) for at in range(0, len(want), 7)]
        if model.startswith("word"):
            assert "".join(decoder.joined(iter(pieces))) == library.decode(want, skip_special_tokens=False)
        else:
            assert "".join(decoder.plain(iter(pieces))) == text


def test_transducer_emits_before_the_end_and_never_retracts():
    own = bpe_stream.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(60):
        word = "".join(RANDOM.choice(RANDOM.choice(["etaoin", "ab", "abcdefghijklmnopqrstuvwxyz"])) for _ in range(RANDOM.randrange(1, 2500))).encode()
        stream = bpe_stream.MergeTransducer(own.merges, own.ahead, window=64)
        early = [t for at in range(0, len(word), 100) for t in stream.feed(word[at : at + 100])]
        assert len(stream.held) <= 64 + own.ahead + 200
        assert early + list(stream.finish()) == own.merges.merge(own.merges.symbols(word, True))


def test_encoded(odd, none):
    path = public_tokenizers.path(bpe_stream.MODEL)
    library = Tokenizer.from_file(path)
    got = sorted(map(tuple, bpe_stream.encoded(odd.fillna({"doc_id": -1}), path).collect()))
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4")).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_stream.encoded(none, path).count() == 0
    assert bpe_stream.encoded(odd, path).where("doc_id IS NULL").count() == 1

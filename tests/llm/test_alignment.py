"""Alignment of two tokenizers against a walk over single bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from livetick.llm import token_alignment as ta

A, B = public_tokenizers.path(ta.MODEL_A), public_tokenizers.path(ta.MODEL_B)
RANDOM = random.Random(8)
ALPHABET = [" ", " ", " ", "\n", "\xa0", "\t", "a", "b", "th", "e", "1", "99", "!", "'s", "é", "数", "👍", "▁", "\x00", "\x85", "<s>", "<0x41>", "<|endoftext|>"]
STRANGE = ["", None, " ", "  ", "a", "▁", "a▁b c", " x", "x ", "<|endoftext|>", "<unk><s>", "aaaa " * 500, "y" * 3000, "Ünï cödé 数据 👍🏽", "a  b   c", "ＡＢ ﬁ ½ é"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    return a, b, ta.bytes_of_a(A), ta.bytes_of_b(b)


def plain_tokens(text, libraries):
    a, b, bytes_a, bytes_b = libraries
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    same = b"".join(bytes_a[i] for i in ids_a) == b"".join(bytes_b[i] for i in ids_b) == (" " + text).encode()
    return (ids_a, ids_b) if same else ([], [])


def plain_alignment(ids_a, ids_b, libraries):
    """Links and groups from the tokens that hold each byte."""
    _, _, bytes_a, bytes_b = libraries
    of_a = [k for k, i in enumerate(ids_a) for _ in bytes_a[i]]
    of_b = [k for k, i in enumerate(ids_b) for _ in bytes_b[i]]
    links = sorted(set(zip(of_a, of_b)))
    groups, start = [], (0, 0)
    for at in range(1, len(of_a) + 1):
        if at == len(of_a) or (of_a[at] != of_a[at - 1] and of_b[at] != of_b[at - 1]):
            end = of_a[at - 1] + 1, of_b[at - 1] + 1
            groups.append(",".join(map(str, ids_a[start[0] : end[0]])) + "|" + ",".join(map(str, ids_b[start[1] : end[1]])))
            start = end
    return links, ";".join(groups)


def test_tokens_equal_both_libraries(libraries):
    own = ta.PairTokenizer(A, B)
    texts = STRANGE + ["".join(RANDOM.choice(ALPHABET) for _ in range(RANDOM.randrange(40))) for _ in range(4000)]
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        ids_a, n_a, ids_b, n_b = own.encode(pa.array(part, pa.string()))
        for text, x, y in zip(part, np.split(ids_a, np.cumsum(n_a)[:-1]), np.split(ids_b - ta._B, np.cumsum(n_b)[:-1]), strict=True):
            assert (x.tolist(), y.tolist()) == plain_tokens(text, libraries), repr(text)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 16])
def test_merge_path(piece):
    for _ in range(60):
        end = RANDOM.randrange(1, 60)
        a, b = (np.array(sorted({*RANDOM.sample(range(1, end + 1), RANDOM.randrange(end)), end})) for _ in range(2))
        cuts = np.arange(len(a) + len(b) + 1)
        order = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
        assert ta.diagonals(a, b, cuts).tolist() == [sum(side == 0 for _, side in order[:d]) for d in cuts]
        found = ta.align(a, b, piece)
        ends = sorted({*a.tolist(), *b.tolist()})
        assert list(zip(found.link_a, found.link_b)) == [(int((a < e).sum()), int((b < e).sum())) for e in ends]
        assert list(zip(found.shared_a, found.shared_b)) == [(a.tolist().index(e), b.tolist().index(e)) for e in ends if e in a and e in b]


def brute(rows, libraries):
    found, counts = [], Counter()
    for doc_id, text in rows:
        ids = plain_tokens(text, libraries)
        links, groups = plain_alignment(*ids, libraries)
        pairs = [(ids[0][i], ids[1][j]) for i, j in links]
        counts.update(pairs)
        found.append((doc_id, *ids, pairs, groups))
    highest = Counter()
    for (_, b), c in counts.items():
        highest[b] = max(highest[b], c)
    return sorted(((i, len(a), len(b), groups.count(";") + 1 if a else 0, len(pairs), sum(counts[p] == highest[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                    hashlib.sha256(groups.encode()).hexdigest() if a else "") for i, a, b, pairs, groups in found), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_links": 50, "piece_ends": 13}])
def test_documents(spark, odd, none, documents, libraries, sizes):
    strange = spark.createDataFrame([(100 + k, t) for k, t in enumerate(STRANGE)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(strange).unionByName(documents.where("doc_id < 40").select("doc_id", "text"))
    got = sorted((tuple(r) for r in ta.aligned(docs.selectExpr("*", "1 AS block", "2 AS uid", "3 AS pair"), A, B, **sizes).collect()), key=repr)
    assert got == brute([tuple(r) for r in docs.collect()], libraries)
    assert ta.aligned(none, A, B, **sizes).count() == 0

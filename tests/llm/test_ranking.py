"""Ranking of bags against a term-by-term search."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from livetick.llm import bag_rank

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
RANDOM = random.Random(4)


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item_id, text in items:
        found = []
        for i, bag, n in bags:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            found += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item_id, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms():
    texts = ["", None, "Ab-cD 9zéÉ \x7f~x　y", "\x00\x01a", "   ", "数据 B数", "a" * 5000 + "!" + "b"]
    found, owner = bag_rank.terms_of(pa.array(["skip", *texts], pa.string()).slice(1))
    for k, text in enumerate(texts):
        assert found.filter(pa.array(owner == k)).to_pylist() == terms(text)
    assert len(bag_rank.terms_of(pa.array([], pa.string()))[0]) == 0 == len(bag_rank.terms_of(pa.array([None], pa.string()))[0])


VOCABULARY = ["a", "the", "the", "x1", "Ünï", "cat", "CAT", "dog", "zeta", "é"]


def some_text(n):
    return " ".join(RANDOM.choice(VOCABULARY) for _ in range(n))


@pytest.mark.parametrize("classes, items_each, items_letters", [(1024, 256, 4_000_000), (3, 2, 30)])
def test_search(spark, odd, none, monkeypatch, classes, items_each, items_letters):
    monkeypatch.setattr(bag_rank, "CLASS_BLOCK", classes)
    monkeypatch.setattr(bag_rank, "ITEM_BLOCK", items_each)
    monkeypatch.setattr(bag_rank, "parts_of", lambda b, f=bag_rank.parts_of: f(b, items_letters))
    docs = [(i, some_text(RANDOM.randrange(0, 7))) for i in range(150)] + [(i, "cat dog") for i in range(300, 400)] + [(310, "dog cat"), (310, "cat dog"), (None, "cat dog")]
    docs += [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "Cat the dog the"), (2, "nowhere at-all"), (3, None), (4, ""), (None, "zeta"), (5, "ÜNÏ ünï Ünï x1"), (5, "one two, THREE words long"), (6, "the"), (6, "the")]
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], "doc_id long, text string, n int, m int, bag int, hash int").repartition(5)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, doc_id string")
    assert rows(bag_rank.search(table, bench)) == brute(docs, items)
    assert rows(bag_rank.search(table, bench, top=3)) == brute(docs, items, 3)
    assert rows(bag_rank.search(none, bench)) == [] == rows(bag_rank.search(table, bench.limit(0)))


def test_sums_beyond_doubles_are_exact():
    items = bag_rank.Items([1], ["a " * 5])
    block = bag_rank.ItemBlock(items, np.array([1 << 33]), 0, 1)
    assert block.matrix.dtype == np.int64
    assert block.scores(np.array([0]), np.array([0]), np.array([999_983]), 1).tolist() == [[5 * (1 << 33) * 999_983]]

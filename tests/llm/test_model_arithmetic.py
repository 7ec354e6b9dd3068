"""The fitted models against the same arithmetic written out plainly."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from livetick.llm import quality_qda, toxic_kn
from livetick.llm.boosting import BINS, Trees

RANDOM = random.Random(17)


# --- quadratic discriminant ---------------------------------------------------------------------------------


def plain_qda(x, y, asked, shrink):
    center, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    logs = []
    for k in (0, 1):
        own = (x[y == k] - center) / scale
        cov = np.cov(own.T, bias=True)
        cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        gap = (asked - center) / scale - own.mean(0)
        logs.append(math.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    return 1 / (1 + np.exp(-(logs[1] - logs[0]) / quality_qda.TEMPERATURE))


def test_discriminant_equals_log_densities():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 4)), rng.normal(1, 2, size=(90, 4)) @ rng.normal(size=(4, 4))])
    y = np.repeat([0, 1], [60, 90])
    sums = np.stack([x[y == k].sum(0) for k in (0, 1)])
    products = np.stack([x[y == k].T @ x[y == k] for k in (0, 1)])
    model = quality_qda.Discriminant(np.array([60.0, 90.0]), sums, products)
    assert np.allclose(model.score(x), plain_qda(x, y, x, quality_qda.SHRINK), atol=1e-9)


def test_quality_query_equals_a_fit_of_all_labelled_rows(documents, labels):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    marked = defaultdict(set)
    for r in labels.collect():
        if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0:
            marked[r["doc_id"]].add(r["quality"])
    learn = [(i, m.pop()) for i, m in marked.items() if len(m) == 1 and i in rows]
    statistics = {i: quality_qda.statistics(t) for i, t in rows.items()}
    ids = sorted(rows)
    want = plain_qda(np.array([statistics[i] for i, _ in learn]), np.array([q for _, q in learn]), np.array([statistics[i] for i in ids]), quality_qda.SHRINK)
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in quality_qda.scored(documents, labels).collect()}
    for i, score in zip(ids, want, strict=True):
        held, own, predicted = got[i]
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0) and own == pytest.approx(score, abs=1e-6) and predicted == int(own >= quality_qda.CUTOFF)


# --- boosted trees ------------------------------------------------------------------------------------------


def plain_tree(b, g, h, ridge, rate, rows, depth):
    """Best cut of every node by trying each; the leaf value of every row."""
    if depth == 0:
        return {i: rate * g[rows].sum() / (h[rows].sum() + ridge) for i in rows}
    best, split = 1e-9, None
    for f in range(b.shape[1]):
        gains = []
        for cut in range(BINS):
            left, right = [i for i in rows if b[i, f] <= cut], [i for i in rows if b[i, f] > cut]
            if h[left].sum() < 1 or h[right].sum() < 1:
                gains.append(0.0)
                continue
            gains.append(sum(g[side].sum() ** 2 / (h[side].sum() + ridge) for side in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge))
        if max(gains) > best:
            best, split = max(gains) + 1e-9, (f, int(np.argmax(gains)))
    sides = [rows, []] if split is None else [[i for i in rows if b[i, split[0]] <= split[1]], [i for i in rows if b[i, split[0]] > split[1]]]
    out = {}
    for side in sides:
        if side:
            out |= plain_tree(b, g, h, ridge, rate, side, depth - 1)
    return out


def test_trees_equal_a_search_over_every_cut():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(90, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = Trees(x, y, rounds=4, depth=3)
    b, margin = trees.binned(x), np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        values = plain_tree(b, y - p, p * (1 - p), 1.0, 0.2, list(range(len(y))), 3)
        margin = margin + np.array([values[i] for i in range(len(y))])
    assert np.allclose(trees.margin(x), margin, atol=1e-9)


# --- class-conditional letter models ------------------------------------------------------------------------


def grams_of(words):
    out = Counter()
    for word in words:
        text = toxic_kn._BORDER + word + toxic_kn._BORDER
        for k in range(1, toxic_kn.ORDER + 1):
            out.update(text[a : a + k] for a in range(k == 1, len(text) - k + 1))
    return out


class PlainModels:
    """Interpolated modified Kneser-Ney by recursion over dictionaries."""

    def __init__(self, counted):
        self.raw = [Counter(), Counter()]
        grams = set(counted[0]) | set(counted[1])
        for g in grams:
            for c in (0, 1):
                if len(g) == toxic_kn.ORDER or g[0] == toxic_kn._BORDER:
                    self.raw[c][g] = counted[c][g]
                else:
                    self.raw[c][g] = sum(len(h) == len(g) + 1 and h[1:] == g and counted[c][h] > 0 for h in grams)
        for g in grams:
            if len(g) <= toxic_kn.SHARED:
                both = self.raw[0][g] + self.raw[1][g]
                self.raw[0][g] = self.raw[1][g] = both
        self.grams = grams
        self.d = {(k, c): toxic_kn.discounts(np.array([float(self.raw[c][g]) for g in sorted(grams) if len(g) == k])) for k in range(1, toxic_kn.ORDER + 1) for c in (0, 1)}
        self.letters = sum(len(g) == 1 for g in grams)

    def held(self, g, c):
        n = self.raw[c][g]
        return min(self.d[len(g), c][min(max(n, 1), 3) - 1], n) if n else 0.0

    def weight(self, context, c):
        own = [g for g in self.grams if len(g) == len(context) + 1 and g[:-1] == context]
        total = sum(self.raw[c][g] for g in own)
        return max(sum(self.held(g, c) for g in own) / total if total else 1.0, 1e-6), total, bool(own)

    def prob(self, g, c):
        lower = 1 / (self.letters + 1) if len(g) == 1 else self.prob(g[1:], c)
        weight, total, _ = self.weight(g[:-1], c)
        return max((self.raw[c][g] - self.held(g, c)) / total + weight * lower if total else lower, 1e-12)

    def ratio(self, word):
        text, value = toxic_kn._BORDER + word + toxic_kn._BORDER, 0.0
        for at in range(1, len(text)):
            for k in range(min(toxic_kn.ORDER, at + 1), 0, -1):
                g = text[at + 1 - k : at + 1]
                if g in self.grams:
                    value += math.log(self.prob(g, 0)) - math.log(self.prob(g, 1))
                    break
                if k > 1 and self.weight(g[:-1], 0)[2]:
                    value += math.log(self.weight(g[:-1], 0)[0]) - math.log(self.weight(g[:-1], 1)[0])
        return value / (len(word) + 1)


def test_letter_models_equal_the_recursion():
    words = [["".join(RANDOM.choice("abcd" if c else "abef") for _ in range(RANDOM.randrange(1, 6))) for _ in range(25)] for c in (0, 1)]
    counted = [grams_of(w) for w in words]
    grams = sorted(set(counted[0]) | set(counted[1]))
    models = toxic_kn.LetterModels(grams, np.array([[counted[0][g], counted[1][g]] for g in grams]))
    plain = PlainModels(counted)
    asked = words[0][:5] + words[1][:5] + ["abcdef", "fedcba", "zz", "a", "abz", "éa"]
    assert models.ratios(asked) == pytest.approx([plain.ratio(w) for w in asked], abs=1e-9)

"""Toxicity of documents by two class-conditional Kneser-Ney models over the letters of words.

Both models are interpolated modified Kneser-Ney letter models of order `ORDER` inside words (a word starts and ends
with a border letter). Orders above `SHARED` are counted per class; the orders up to `SHARED` are counted over both
classes together, so that an expression neither class has shown is smoothed alike by both. The toxic and ordinary
log-likelihoods of a word are compared after division by its length. A document is judged by its largest three word
ratios, by what its words have above a mild ratio and by its mean ratio, through a logistic curve fitted on labelled rows the models have not seen.

The fit reads at most `SAMPLE` labelled documents outside the held-out fold (those first by a hash of the id), a bound
that is a parameter, and keeps all their n-grams. Every text is scored whole.

Results for odd rows: a null or empty text, or one without words, has ratios 0; a null id is scored and returned;
repeated rows are scored one by one; an empty table gives no rows; columns other than id and text are ignored by
`scored` and kept by `keep_civil`. Ids labelled both ways take no part in the fit. Without labels of both classes the
score is the share of label 1 among them (0.0 without any label).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetick.llm.common import agreed_labels, batches, fold, mix, sampled, table

FOLDS, HELD_OUT, CUTOFF = 3, 1, 0.7
ORDER, SHARED = 5, 1
SAMPLE = 30_000
#: One labelled row in so many is kept from the counts for the logistic curve.
CURVE = 4
BATCH = 256
#: Numbers by which a document is judged, and the word ratio from which a word counts as marked.
FEATURES, MILD = 8, 0.3
#: Word ratios a worker remembers before it starts afresh.
REMEMBERED = 400_000

_WORD = re.compile(r"\w+")
_BORDER = "\x01"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def gram_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of letters; the row length is part of it."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for j in range(codes.shape[1]):
        h = (h * np.uint64(0x100000001B3)) ^ codes[:, j].astype(np.uint64)
    return mix(h)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words between borders, one after the other, and the place of each letter in its word."""
    text = _BORDER + _BORDER.join(words) + _BORDER
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    place = np.arange(1, len(codes)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return codes, np.concatenate(([0], place))


def windows(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k letters that end at each place."""
    return codes[at[:, None] + np.arange(1 - k, 1)[None, :]]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): how often each word stands in texts of either class."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(frames, BATCH):
            both = [Counter(), Counter()]
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                both[label].update(words_of(text))
            words = list(both[0].keys() | both[1].keys())
            yield pd.DataFrame({"word": words, "toxic": [both[1][w] for w in words], "ordinary": [both[0][w] for w in words]})

    parts = docs.select("text", "label").mapInPandas(count, "word string, toxic long, ordinary long")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) for all orders, counted over running words."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(frames, 20_000):
            if not len(pdf):
                continue
            names = pdf["word"].tolist()
            codes, place = letters(names)
            weights = np.repeat(pdf[["toxic", "ordinary"]].to_numpy(), [len(w) + 1 for w in names], axis=0)
            for k in range(1, ORDER + 1):
                at = np.flatnonzero(place >= max(1, k - 1))
                rows = windows(codes, at, k)
                _, first, back = np.unique(gram_hash(rows), return_index=True, return_inverse=True)
                sums = np.stack([np.bincount(back, weights[at - 1, c], len(first)) for c in (0, 1)])
                text = rows[first].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                yield pd.DataFrame({"gram": [text[i * k : i * k + k] for i in range(len(first))],
                                    "toxic": sums[0].astype(np.int64), "ordinary": sums[1].astype(np.int64)})

    parts = words.mapInPandas(count, "gram string, toxic long, ordinary long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more; 0.5 each where counts of counts are missing."""
    n = [max(int((counts == i).sum()), 0) for i in range(1, 5)]
    if min(n) == 0:
        return np.full(3, 0.5)
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)], 0.05, [0.95, 1.9, 2.9])


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class LetterModels:
    """Both class models as sorted hash arrays: log ratio of every known n-gram, and of every context's backoff weight."""

    def __init__(self, grams: list[str], counts: np.ndarray) -> None:
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        self.keys, self.ratio, self.contexts, self.weight = [], [], [], []
        below: tuple[np.ndarray, np.ndarray] | None = None
        by_order = []
        for k in range(1, ORDER + 1):
            own = np.flatnonzero(sizes == k)
            joined = "".join(grams[i] for i in own)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, k)
            by_order.append((codes, counts[own].astype(float)))
        for k in range(1, ORDER + 1):
            codes, raw = by_order[k - 1]
            if k < ORDER and len(by_order[k][0]):  # lower orders count the distinct letters in front
                longer, seen = by_order[k]
                kinds, back = np.unique(gram_hash(longer[:, 1:]), return_inverse=True)
                place = _find(kinds, gram_hash(codes))
                cont = np.stack([np.bincount(back, seen[:, c] > 0, len(kinds)) for c in (0, 1)], 1)
                raw = np.where(codes[:, :1] == ord(_BORDER), raw, np.where(place[:, None] >= 0, cont[place], 0))
            if k <= SHARED:
                raw = np.repeat(raw.sum(1, keepdims=True), 2, axis=1)
            keys = gram_hash(codes)
            order = np.argsort(keys)
            keys, codes, raw = keys[order], codes[order], raw[order]
            context, back = np.unique(gram_hash(codes[:, :-1]) if k > 1 else np.zeros(len(codes), np.uint64), return_inverse=True)
            prob, weight = np.zeros_like(raw), np.zeros((len(context), 2))
            lower = np.full(raw.shape, 1 / max(len(codes) + 1, 1)) if k == 1 else self._lower(below, codes)
            for c in (0, 1):
                d = discounts(raw[:, c])[np.clip(raw[:, c].astype(int), 1, 3) - 1]
                held = np.where(raw[:, c] > 0, np.minimum(d, raw[:, c]), 0)
                total = np.bincount(back, raw[:, c], len(context))
                free = np.bincount(back, held, len(context))
                gamma = np.where(total > 0, free / np.maximum(total, 1), 1.0)
                weight[:, c] = gamma
                prob[:, c] = np.where(total[back] > 0, (raw[:, c] - held) / np.maximum(total[back], 1), 0) + gamma[back] * lower[:, c]
            prob, weight = np.maximum(prob, 1e-12), np.maximum(weight, 1e-6)
            self.keys.append(keys)
            self.ratio.append(np.log(prob[:, 0]) - np.log(prob[:, 1]))
            self.contexts.append(context)
            self.weight.append(np.log(weight[:, 0]) - np.log(weight[:, 1]))
            below = (keys, prob, context, weight, below)

    @staticmethod
    def _lower(level: tuple | None, codes: np.ndarray) -> np.ndarray:
        """Probability of the last letter after a history one shorter, under both models."""
        out, todo, scale = np.full((len(codes), 2), 1e-6), np.arange(len(codes)), np.ones((len(codes), 2))
        short = codes[:, 1:]
        while level is not None and len(todo):
            keys, prob, context, weight, next_level = level
            place = _find(keys, gram_hash(short[todo]))
            hit = place >= 0
            out[todo[hit]] = prob[place[hit]] * scale[todo[hit]]
            todo = todo[~hit]
            if short.shape[1] > 1:
                known = _find(context, gram_hash(short[todo, :-1]))
                scale[todo] *= np.where(known[:, None] >= 0, weight[known], 1.0)
            short, level = short[:, 1:], next_level
        return out

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word, divided by its letters and border."""
        if not words or not len(self.keys[0]):
            return np.zeros(len(words))
        codes, place = letters(words)
        todo = np.flatnonzero(place > 0)
        value = np.zeros(len(codes))
        for k in range(ORDER, 0, -1):
            able = place[todo] >= k - 1
            at = todo[able]
            found = _find(self.keys[k - 1], gram_hash(windows(codes, at, k)))
            value[at[found >= 0]] += self.ratio[k - 1][found[found >= 0]]
            missed = at[found < 0]
            if k > 1 and len(missed):
                known = _find(self.contexts[k - 1], gram_hash(windows(codes, missed - 1, k - 1)))
                value[missed] += np.where(known >= 0, self.weight[k - 1][known], 0.0)
            todo = np.concatenate((todo[~able], missed))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return np.add.reduceat(value[1:], np.concatenate(([0], np.cumsum(sizes)[:-1]))) / sizes


class WordRatios:
    """Remembers word ratios within a bound."""

    def __init__(self, models: LetterModels) -> None:
        self.models, self.known = models, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """FEATURES of each text: largest three word ratios, excess over MILD, and means over words and letters."""
        split = [words_of(t) for t in texts]
        new = list({w for own in split for w in own if w not in self.known})
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list({w for own in split for w in own})
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.known.update(zip(part, self.models.ratios(part).tolist(), strict=True))
        out, get = np.zeros((len(texts), FEATURES)), self.known.__getitem__
        for i, words in enumerate(split):
            n = len(words)
            if not n:
                continue
            values = np.fromiter(map(get, words), float, n)
            sizes = np.fromiter(map(len, words), float, n) + 1
            top = np.unique(values if n < 4 else values[values >= np.partition(values, -3)[-3]])[::-1][:3]
            excess = np.maximum(values - MILD, 0).sum()
            out[i, : len(top)] = np.maximum(top, 0)
            out[i, 3:] = [excess / np.sqrt(n), 50 * excess / n, 50 * (values > MILD).mean(), np.log1p(n) / 5,
                          5 * (values @ sizes) / sizes.sum()]
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * 1e-2 * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) * 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """The fitted models and curve; `share` answers where one class is missing."""

    def __init__(self, models: LetterModels | None, weights: np.ndarray | None, share: float) -> None:
        self.models, self.weights, self.share = models, weights, share

    def udf(self):
        models, weights, share = self.models, self.weights, self.share

        @F.pandas_udf("double")
        def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ratios = WordRatios(models) if models is not None else None
            for texts in series:
                if ratios is None:
                    yield pd.Series(np.full(len(texts), share))
                    continue
                found = [ratios.features(texts.iloc[at : at + BATCH].tolist()) for at in range(0, len(texts), BATCH)]
                x = np.concatenate(found) if found else np.zeros((0, FEATURES))
                yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -500, 500))))

        return score


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """Count both models in Spark over the sampled labelled documents and fit the curve on those set apart."""
    learn = agreed_labels(labels.where(fold("doc_id", FOLDS) != HELD_OUT), label)
    picked = sampled(learn, sample, "doc_id")
    apart = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(CURVE)) == 0
    # At most `sample` small rows, so that the texts stay where they are.
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label", apart.alias("apart"))
    counted = gram_counts(word_counts(known.where(~F.col("apart"))))
    # All n-grams of the sample: those that are rare in it are what is smoothed.
    kept = counted.orderBy("gram").toArrow()
    counts = np.stack([kept.column("toxic").to_numpy(), kept.column("ordinary").to_numpy()], 1)
    tally = {r["label"]: r["n"] for r in picked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = tally.get(1, 0) / max(sum(tally.values()), 1)
    if len(tally) < 2 or not len(counts) or not counts.sum(0).all():
        return Scorer(None, None, share)
    models = LetterModels(kept.column("gram").to_pylist(), counts)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratios = WordRatios(models)
        for pdf in batches(frames, BATCH):
            x = ratios.features(pdf["text"].tolist())
            yield pd.DataFrame({"x": list(x), "label": pdf["label"].to_numpy()})

    seen = known.where("apart").mapInPandas(features, "x array<double>, label int").toArrow()
    x = np.array(seen.column("x").to_pylist(), dtype=float).reshape(-1, FEATURES)
    y = seen.column("label").to_numpy() if len(seen) else np.zeros(0)
    if len(set(y.tolist())) < 2:  # too few rows set apart: the largest ratio alone, half way at one nat a letter
        return Scorer(models, np.array([8.0] + [0.0] * (FEATURES - 1) + [-8.0]), share)
    return Scorer(models, logistic(x, y), share)


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`."""
    score = fit(docs, labels, label).udf()
    out = docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows the models reject."""
    return docs.where(fit(docs, labels).udf()("text") < CUTOFF)


def op9_toxic_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned outside the held-out fold of the labels."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

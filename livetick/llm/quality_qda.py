"""Quality of documents by a regularised quadratic discriminant over transformed text statistics.

Every text is reduced to a vector of statistics (`FEATURES`). Per class, mean and covariance come from sums over
all labelled rows outside the held-out fold, added up in Spark; covariances are shrunk towards a multiple of the
identity and kept as Cholesky factors. A score is the tempered difference of the two Mahalanobis log densities.

Results for odd rows: a null or empty text is scored like any other (all counts zero); a null id is scored and
returned; repeated rows are scored one by one; an empty table gives no rows; columns other than id and text are
ignored by `scored` and kept by `keep_good`. Ids labelled both ways take no part in the fit. Without labelled rows
of both classes there is nothing to compare: the score is then the share of label 1 (1.0 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetick.llm.common import agreed_labels, batches, cut, fold, table

FOLDS, HELD_OUT, CUTOFF = 5, 0, 0.3
SHRINK = 0.05
#: Statistics of one text are correlated, so that raw log-density differences are overconfident.
TEMPERATURE = 4.0
BATCH = 256

_SENTENCE, _MARK = set(b".,;:'\"()-?"), set(b"!")
FEATURES = [
    "words", "upper", "lower", "digit", "space", "sentence", "bar", "exclaim", "symbol",
    "vocabulary", "repeats", "word_mean", "word_spread", "lines",
]


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros((256, 8))
    for i in range(256):
        blank = i in (9, 10, 11, 12, 13, 32)
        plain = 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128
        other = i > 32 and not plain and i not in _SENTENCE and i not in _MARK and i != ord("|")
        kinds[i] = [65 <= i <= 90, 97 <= i <= 122 or i >= 128, 48 <= i <= 57, blank, i in _SENTENCE,
                    i == ord("|"), i in _MARK, other]
    return kinds


_KINDS = _byte_kinds()


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text, in the order of FEATURES."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KINDS
    shares = np.log((counts + 2) / (len(data) + 200))
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lengths = np.minimum(lengths, 20)
    repeats = sum(map(str.__eq__, words[1:], words)) / (n + 20)
    lines = text.count("\n") + 1
    return np.array([
        np.log1p(n), *shares, np.log1p(len(set(words))) - 0.9 * np.log1p(n), np.sqrt(repeats),
        np.log((lengths.sum() + 50) / (n + 10)), np.log1p(lengths.std()), np.log(lines / (n + 20)),
    ])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(frames, BATCH):
            yield pd.DataFrame({"id": pdf["id"], "features": [statistics(t) for t in pdf["text"]]})

    pairs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = pairs.mapInPandas(of, "id string, features array<double>")
    return out.select(F.col("id").cast(id_type).alias(id_col), "features")


class Discriminant:
    """Means, Cholesky factors and priors of both classes."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = SHRINK) -> None:
        self.counts = counts
        self.ready = bool((counts > 1).all())
        if not self.ready:
            return
        total = counts.sum()
        self.center = sums.sum(0) / total
        spread = np.sqrt(np.maximum(np.diagonal(products.sum(0)) / total - self.center**2, 0))
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        self.parts = []
        for n, s, p in zip(counts, sums, products, strict=True):
            mean = (s / n - self.center) / self.scale
            second = (p - np.outer(s, self.center) - np.outer(self.center, s)) / n + np.outer(self.center, self.center)
            cov = second / np.outer(self.scale, self.scale) - np.outer(mean, mean)
            cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            # The inverse of a small triangular factor turns every later distance into one product.
            self.parts.append((mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n / total)))

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.ready:
            total = self.counts.sum()
            return np.full(len(features), self.counts[1] / total if total else 1.0)
        z = (features - self.center) / self.scale
        low, high = (prior - halflog - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1)
                     for mean, inverse, halflog, prior in self.parts)
        return 1 / (1 + np.exp(-np.clip((high - low) / TEMPERATURE, -500, 500)))


def fit(labelled: DataFrame, size: int = len(FEATURES)) -> Discriminant:
    """Fit over all rows of (label, features); tasks send one row per class and sum, Spark adds them up."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + size + size * size))
        for pdf in frames:
            x, y = np.array(pdf["features"].tolist(), dtype=float).reshape(-1, size), pdf["label"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        yield pd.DataFrame({"label": np.repeat([0, 1], total.shape[1]), "cell": np.tile(np.arange(total.shape[1]), 2),
                            "value": total.ravel()})

    summed = labelled.select("label", "features").mapInPandas(moments, "label int, cell int, value double")
    total = np.zeros((2, 1 + size + size * size))  # so many rows come to the driver whatever the input
    for row in summed.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():
        total[row["label"], row["cell"]] = row["value"]
    return Discriminant(total[:, 0], total[:, 1 : 1 + size], total[:, 1 + size :].reshape(2, size, size))


def learned(features: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on the labels outside the held-out fold; `features` has (doc_id, features)."""
    learn = agreed_labels(labels.where(fold("doc_id", FOLDS) != HELD_OUT), label)
    return fit(features.join(learn, "doc_id"))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`; `labels` outside the held-out fold are learned."""
    features = cut(with_statistics(docs))
    model = learned(features, labels, label)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        x = np.array(column.tolist(), dtype=float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    out = features.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score("features").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows the classifier rejects. Only texts pass through Python and nothing of them is shuffled."""
    model = learned(with_statistics(docs), labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))))

    return docs.where(score("text") >= CUTOFF)


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document, learned outside the held-out fold of the labels."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

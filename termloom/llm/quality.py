"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a fixed list of statistics (shares of kinds of characters, words, repeats
and lines), transformed to logarithms so that they are nearer to normal. Both classes get a
mean and a covariance shrunk towards a scaled identity; the covariances' Cholesky factors
are computed once and kept in the model. A document's score is the logistic of the
difference of the two classes' log densities (Mahalanobis distance and determinant, both
from the factors) and log priors.

The moments are sums over all labelled rows outside the held-out fold, made by a grouped
aggregation; the driver gets one row per class.

Defined cases: null and empty texts have the statistics of the empty text and are scored
like any other; rows of ``labels`` with null labels or ids teach nothing; several labels of
a document each count; with fewer than two classes labelled every score is the smoothed
share of label 1; repeated rows get a row each; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import held_out, materialize, short

SHRINKAGE = 0.1
THRESHOLD = 0.5
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_STOPS = b".,;:'\"()-?"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS)
STATISTICS = ("words", "word_length", "upper", "lower", "digits", "stops", "marks", "wide", "distinct", "repeats", "lines", "line_repeats", "capitals", "singles")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of STATISTICS."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    words = raw.split()
    k = len(words)
    lines = [x for x in raw.split(b"\n") if x]
    shares = [n - len(raw.translate(None, part)) for part in (_UPPER, _LOWER, _DIGIT, _STOPS, _MARKS)]
    wide = n - len(raw.decode("utf-8", "replace"))
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    capitals = sum(map(bytes.isupper, words))
    singles = sum(len(w) == 1 for w in words)
    share = lambda part, whole: np.log((part + 0.5) / (whole + 20.0))
    return [
        np.log1p(k),
        np.log((n + 1) / (k + 1)),
        *(share(s, n) for s in shares),
        share(wide, n),
        np.log((distinct + 1) / (k**0.8 + 1)),
        share(repeats, k),
        share(len(lines), k),
        share(len(lines) - len(set(lines)), len(lines)),
        share(capitals, k),
        share(singles, k),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Log priors, means and inverse Cholesky factors by class; ``share`` where it can't be fitted."""

    share: float
    priors: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None  # inverses of the lower Cholesky factors
    halves: np.ndarray | None = None  # half log determinants

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.priors is None:
            return np.full(len(x), self.share)
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.factors[c].T
            density.append(self.priors[c] - self.halves[c] - 0.5 * (z * z).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """The model from each class's count, sum vector and sum of outer products."""
    share = float((counts[1] + 1) / (counts.sum() + 2))
    if counts.min() < 2:
        return Discriminant(share)
    d = sums.shape[1]
    means = sums / counts[:, None]
    factors, halves = [], []
    for c in (0, 1):
        cov = products[c] / counts[c] - np.outer(means[c], means[c])
        weight = shrinkage + (1 - shrinkage) * d / (d + counts[c])
        cov = (1 - weight) * cov + weight * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        halves.append(np.log(np.diag(lower)).sum())
    return Discriminant(share, np.log(counts / counts.sum()), means, np.array(factors), np.array(halves))


def document_statistics(docs: DataFrame, *ids: str) -> DataFrame:
    """(ids..., x): the statistics of every text, beside the columns named ``ids``."""
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            x = pa.array([statistics(t) for t in batch.column(len(ids)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], x], names=[*ids, "x"])

    return docs.select(*ids, "text").mapInArrow(run, f"{shape}, x array<double>")


def learn(found: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all labelled rows outside the held-out fold."""
    d = len(STATISTICS)
    taught = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    rows = found.join(taught, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *sums).collect()
    counts, totals, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        c = int(r["quality"])
        counts[c] = r["n"]
        totals[c] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[c, i, j] = products[c, j, i] = r[f"p{i}_{j}"]
    return fit(counts, totals, products)


def score(found: DataFrame, model: Discriminant, key: str) -> DataFrame:
    """(key, score) from a table of statistics."""
    kind = found.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=[key, "score"])

    return found.select(key, "x").mapInArrow(run, f"`{key}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    found = materialize(document_statistics(docs, "doc_id"), "quality-statistics")
    scored = score(found, learn(found, labels), "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def rejected(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The values of the column ``key`` of the rows that the classifier, taught by their doc_id's
    labels, does not accept."""
    found = materialize(document_statistics(docs, "doc_id", key), "quality-statistics")
    return score(found, learn(found, labels), key).where(F.col("score") < THRESHOLD).select(key)

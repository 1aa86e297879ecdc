"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Statistics of the whole text are transformed to about normal shape.  Each class has a mean and a
covariance, shrunk towards the diagonal of the pooled covariance; the Cholesky factors are cached in the
model, and a score is the logistic of the difference of the log densities plus the log prior odds.
The sums behind means and covariances run over all labelled training rows, on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _stats as S
from ._core import staged, text_of, word_blocks

FEATURES = ("length", "symbols", "upper", "digits", "bars", "bangs", "word_length", "repeated", "distinct", "adjacent", "dup_lines")
SHRINKAGE = 0.05
FLOOR = 1e-3
THRESHOLD = 0.3


def features(words) -> np.ndarray:
    """Rows by FEATURES: counts as logarithms, ratios as arc sines of square roots."""
    h = words.hashes()
    n = words.count.astype(float)
    chars, symbols = S.byte_counts(words, "chars_symbols")
    upper, digits = S.byte_counts(words, "upper_digits")
    bars, bangs = S.byte_counts(words, "bars_bangs")
    n_lines, dup = S.lines(words)
    one = np.maximum(n, 1)
    letters = np.maximum(chars, 1)
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / b, 0, 1)))
    columns = (np.log1p(n), np.log1p(symbols / one), share(upper, letters), share(digits, letters), share(bars, one), share(bangs, one), np.log1p(chars / one), share(S.repeated_words(words, h), one), share(S.distinct_words(words, h), one), share(S.adjacent_repeats(words, h), one), share(dup, np.maximum(n_lines, 1)))
    return np.stack(columns, 1)


def _scan(batches):
    for b in batches:
        for lo, hi, words in word_blocks(b.column(1)):
            x = features(words)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), flat], ["doc_id", "x"])


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row of docs; null text is empty."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(_scan, "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log prior odds."""

    means: np.ndarray
    inverse_factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for k in range(len(self.means)):
            z = (x - self.means[k]) @ self.inverse_factors[k].T
            logs.append(-0.5 * ((z * z).sum(1) + self.log_dets[k]))
        gap = logs[1] - logs[0] if len(logs) == 2 else np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(gap + self.log_odds, -500, 500)))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> QuadraticDiscriminant:
    """Fit on (x, y) rows with y 0 or 1.  If a class has no rows, every score is the smoothed prior."""
    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = [F.get("x", i) for i in range(k)]
    sums = labelled.where(F.col("y").isin(0, 1)).groupBy("y").agg(F.count("*").alias("n"), F.array(*[F.sum(a) for a in at]).alias("s"), F.array(*[F.sum(at[i] * at[j]) for i, j in pairs]).alias("q"))
    got = {r["y"]: r for r in sums.collect()}  # two rows
    n = [got[y]["n"] if y in got else 0 for y in (0, 1)]
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if not all(n):
        return QuadraticDiscriminant(np.zeros((0, k)), np.zeros((0, k, k)), np.zeros(0), log_odds)
    means, covs = [], []
    for y in (0, 1):
        mean = np.array(got[y]["s"]) / n[y]
        square = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[y]["q"], strict=True):
            square[i, j] = square[j, i] = v / n[y]
        means.append(mean)
        covs.append(square - np.outer(mean, mean))
    pooled = np.diag((n[0] * covs[0].diagonal() + n[1] * covs[1].diagonal()) / sum(n))
    factors = [np.linalg.cholesky((1 - shrinkage) * (c + c.T) / 2 + shrinkage * pooled + FLOOR * np.eye(k)) for c in covs]
    return QuadraticDiscriminant(np.array(means), np.array([np.linalg.inv(f) for f in factors]), np.array([2 * np.log(f.diagonal()).sum() for f in factors]), log_odds)


def _scorer(model: QuadraticDiscriminant):
    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return run


def _filter(model: QuadraticDiscriminant, threshold: float, column: str):
    def run(batches):
        for b in batches:
            keep = np.concatenate([model.scores(features(w)) >= threshold for _, _, w in word_blocks(b.column(b.schema.get_field_index(column)))]) if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(keep))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least threshold, unchanged; nothing but sums is shuffled."""
    x = staged(document_features(docs), "quality-features")
    model = fit(_training(x, labels, label_col))
    return docs.mapInArrow(_filter(model, threshold, "text"), docs.schema)


def _training(x: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    known = labels.select(labels["doc_id"].cast("bigint").alias("l_id"), labels[label_col].cast("int").alias("y")).where("y is not null and l_id is not null")
    return x.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("l_id")).select("x", "y")


def held_out(doc_id):
    """True for rows labels are never learnt from: crc32 of the id as text (null: empty) is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD, shrinkage: float = SHRINKAGE) -> DataFrame:
    """Score every whole text; returns doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Labels join by doc_id; a null label, a null id and held-out rows teach nothing, a label repeated
    for an id counts as often as it stands there.  Empty and null texts get the score of a text
    without words.  Repeated rows get equal scores.  An empty table gives an empty table; without
    labels of both classes the score is the smoothed prior (0.5 without any).  Other columns are
    ignored, whatever their names.
    """
    x = staged(document_features(docs), "quality-features")
    scored = x.mapInArrow(_scorer(fit(_training(x, labels, label_col), shrinkage)), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))

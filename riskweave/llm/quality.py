"""Quality by regularised quadratic discriminant analysis over document statistics.

Every document is reduced to a row of transformed statistics in one pass over the texts.
The rows of the labelled training documents give counts, means and second moments of both
classes (sums, so partial sums add up); each class covariance is shrunk towards a scaled
identity and the pooled covariance.  A document's score is the logistic of the difference of
the two Gaussian log densities, with the Cholesky factors worked out once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import documents, windows

STATISTICS = ["words", "word_length", "upper", "digits", "points", "symbols", "calls", "distinct", "repeats",
              "same_lines", "short_words", "line_length", "capitalised", "bare_marks"]
ROW = "doc_id long, x array<double>"
WORDS, LINES, LETTERS = 10, 5, 60
_CLASS = np.zeros(256, np.int64)   # 1 lower case and bytes above ASCII, 2 upper case, 3 digit, 4 point, 5 symbol, 6 call
for _group, _letters in ((1, b"abcdefghijklmnopqrstuvwxyz"), (1, bytes(range(128, 256))), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                         (3, b"0123456789"), (4, b".,;:'\"()-"), (5, b"#$%&*+/<=>@[\\]^_`{|}~"), (6, b"!?")):
    _CLASS[list(_letters)] = _group


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text: logarithms of sizes, square roots of shares.  An empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    _, lower, upper, digits, points, symbols, calls = np.bincount(_CLASS, by, 7).tolist()
    marks = lower + upper + digits + points + symbols + calls
    # shares of few words, lines or letters say little: WORDS, LINES and LETTERS plain ones are added
    shares = {
        "upper": upper / (lower + upper + LETTERS), "digits": digits / (marks + LETTERS), "points": points / (marks + LETTERS),
        "symbols": symbols / (marks + LETTERS), "calls": calls / (marks + LETTERS), "repeats": sum(map(eq, words, words[1:])) / (n + WORDS),
        "same_lines": (len(lines) - len(set(lines))) / (len(lines) + LINES), "short_words": sum(map((4).__gt__, map(len, words))) / (n + WORDS),
        "capitalised": sum(map(bytes.istitle, words)) / (n + WORDS), "bare_marks": sum(not w.isalnum() and len(w) == 1 for w in words) / (n + WORDS),
    }
    sizes = {"words": np.log1p(n), "word_length": np.log((marks + LETTERS) / (n + WORDS)),
             "distinct": np.log((len(set(words)) + WORDS) / (n + WORDS)), "line_length": np.log((len(raw) + LETTERS) / (len(lines) + LINES))}
    return [float(np.sqrt(shares[s]) if s in shares else sizes[s]) for s in STATISTICS]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for window in windows(batches):
        yield pa.RecordBatch.from_arrays([window.column("doc_id"), pa.array(map(statistics, window.column("text").to_pylist()), pa.list_(pa.float64()))], ["doc_id", "x"])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text (null: empty), a row for every row."""
    return documents(docs).mapInArrow(_rows, ROW)


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, half its log determinant."""

    prior: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    half_log: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        z = [np.sum(((x - self.mean[k]) @ self.inverse[k].T) ** 2, axis=1) for k in (0, 1)]
        log = [self.prior[k] - self.half_log[k] - z[k] / 2 for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x, label = np.array(batch.column("x").to_pylist(), float).reshape(-1, d), np.array(batch.column("label").to_pylist())
        for k in (0, 1):
            own = x[label == k]
            sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    at = np.indices(sums.shape)
    yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel()), pa.array(at[1].ravel()), pa.array(sums.ravel())], ["label", "place", "value"])


def fit(rows: DataFrame, labels: DataFrame, shrink: float = 0.05, floor: float = 1e-4) -> Model | None:
    """Fit on every labelled row; None when a class has fewer than two.

    labels: doc_id and quality (0 or 1; other values and nulls do not count).  Only the sums of
    moments reach the driver: 2 * (1 + d + d * d) numbers for d statistics, however many rows.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label"))
    both = rows.join(known, "doc_id").select("x", "label")
    parts = both.mapInArrow(_moments, "label long, place long, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    d = len(STATISTICS)
    sums = np.zeros((2, 1 + d + d * d))
    for r in parts.collect():
        sums[r.label, r.place] = r.value
    n = sums[:, 0]
    if n.min() < 2:
        return None
    mean = sums[:, 1:1 + d] / n[:, None]
    own = [sums[k, 1 + d:].reshape(d, d) / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    inverse, half = [], []
    for k in (0, 1):
        cov = (1 - shrink) * own[k] + shrink / 2 * pooled + (shrink / 2 * np.trace(own[k]) / d + floor) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor))
        half.append(np.log(np.diag(factor)).sum())
    return Model(np.log(n / n.sum()), mean, np.array(inverse), np.array(half))


def _scored(batches: Iterable[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
        score = np.full(len(x), 0.5) if model is None else model.score(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of statistics; without a model each score is 0.5."""
    return rows.mapInArrow(partial(_scored, model=model), "doc_id long, score double")


def _good(batches: Iterable[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    for window in windows(batches):
        x = np.array([statistics(t or "") for t in window.column("text").to_pylist()])
        yield window.filter(pa.array(model.score(x) >= least))


def filtered(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents, all their columns, whose text scores at `least` or above; a null text scores as empty."""
    return docs.mapInArrow(partial(_good, model=model, least=least), docs.schema)

"""Quality classifier: regularised quadratic discriminant over document statistics.

A whole text becomes a vector of transformed statistics. Each class is a Gaussian whose covariance is
shrunk towards the pooled covariance and towards its own diagonal. A text's score comes from the difference
of the two log densities; the Cholesky factors are computed once and go to the tasks with the model. Class
counts, sums and products are summed over all labelled rows on the executors.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.llm.tables import crc_remainder, id_and_text, in_slices, summed
from alarmlens.runtime import materialize

FEATURES = 18
_CLASS = np.zeros(256, np.int64)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b" \t\n\r\x0b\x0c")] = 4
_CLASS[list(b".,;:'\"-()?")] = 5
_CLASS[128:] = 6  # parts of characters beyond ASCII; 0 is every other symbol


def _odds(part: float, whole: float, usual: float, weight: float = 40.0) -> float:
    """Log odds of a share. ``weight`` imaginary units with the usual share keep short texts from looking extreme."""
    return math.log((part + weight * usual) / (whole - part + weight * (1 - usual)))


def _ratio(part: float, whole: float, usual: float, weight: float = 10.0) -> float:
    return math.log((part + weight * usual) / (whole + weight))


def statistics(text: str) -> list[float]:
    """Counts and shares of the whole text, as logarithms and log odds; finite for every text."""
    raw = text.encode("utf-8", "surrogatepass")
    bytes_seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=bytes_seen, minlength=7)
    total = float(len(raw))
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    lower = Counter(w.lower() for w in counts)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    lines = raw.split(b"\n")
    line_counts = Counter(lines)
    sentences = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    shares = bytes_seen[bytes_seen > 0] / max(total, 1.0)
    upper_words = sum(c for w, c in counts.items() if len(w) > 1 and w == w.upper() and w != w.lower())
    return [
        math.log((lengths.sum() + 50.0) / (n + 10.0)),
        math.log((lengths.std() * n + 35.0) / (n + 10.0)),
        math.log1p(max(float(lengths.max()), 12.0)),
        _odds(kinds[2], total, 0.02),
        _odds(kinds[3], total, 0.005),
        _odds(kinds[0], total, 0.01),
        _odds(kinds[5], total, 0.03),
        _odds(kinds[4], total, 0.16),
        _odds(kinds[6], total, 0.05),
        _odds(bytes_seen[ord("!")], total, 0.002),
        _ratio(len(counts), n, 0.8, 20.0),
        _ratio(len(lower), len(counts), 0.95, 20.0),
        _odds(max(counts.values(), default=0), n, 0.06, 20.0),
        _odds(repeated, n, 0.01, 20.0),
        _odds(upper_words, n, 0.01, 20.0),
        _ratio(len(line_counts), len(lines), 0.98, 4.0),
        _ratio(sentences, n, 0.1, 20.0),
        float((4.2 * 100 - (shares * np.log2(shares)).sum() * total) / (total + 100)),
    ]


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, x)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, x array<double>")


@dataclass
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # Cholesky factor of the shrunk covariance
    log_weight: float  # log prior minus half the log determinant


@dataclass
class Discriminant:
    center: np.ndarray
    scale: np.ndarray
    classes: dict[int, Gaussian]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1. With one class seen, that class; with none, a half."""
        if len(self.classes) < 2:
            return np.full(len(x), {0: 0.0, 1: 1.0}.get(next(iter(self.classes), -1), 0.5))
        z = np.clip((x - self.center) / self.scale, -8, 8)
        logs = {}
        for label, g in self.classes.items():
            distance = np.linalg.solve(g.factor, (z - g.mean).T)  # Mahalanobis: |L^-1 (z - m)|^2
            logs[label] = g.log_weight - 0.5 * (distance**2).sum(axis=0)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _moments(rows: DataFrame) -> DataFrame:
    """Per class: count, sums and products of ``(label, x)`` rows, as ``(place, value)``."""
    size = 1 + FEATURES + FEATURES**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist())
            for label in (0, 1):
                own = x[labels == label]
                total[label] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(2 * size), pa.int32()), pa.array(total.ravel())], names=["place", "value"]
        )

    return rows.select("label", "x").mapInArrow(run, "place int, value double")


def fit(rows: DataFrame, towards_pooled: float = 0.2, towards_diagonal: float = 0.1) -> Discriminant:
    """Fit from ``(label, x)``, label 0 or 1."""
    size = 1 + FEATURES + FEATURES**2
    found = summed(_moments(rows))
    total = np.array([found.get(i, 0.0) for i in range(2 * size)]).reshape(2, size)
    counts = total[:, 0]
    n = counts.sum()
    sums, products = total[:, 1 : 1 + FEATURES], total[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES)
    center = sums.sum(axis=0) / max(n, 1)
    spread = products.sum(axis=0).diagonal() / max(n, 1) - center**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, covariances = {}, {}
    for label in (0, 1):
        if counts[label]:
            mean = sums[label] / counts[label]
            covariances[label] = (products[label] / counts[label] - np.outer(mean, mean)) / np.outer(scale, scale)
            means[label] = (mean - center) / scale
    pooled = sum(counts[k] * c for k, c in covariances.items()) / max(n, 1)
    classes = {}
    for label, own in covariances.items():
        mixed = (1 - towards_pooled) * own + towards_pooled * pooled
        mixed = (1 - towards_diagonal) * mixed + towards_diagonal * np.diag(mixed.diagonal())
        factor = np.linalg.cholesky(mixed + 1e-3 * np.eye(FEATURES))
        weight = math.log(counts[label] / n) - np.log(factor.diagonal()).sum()
        classes[label] = Gaussian(means[label], factor, weight)
    return Discriminant(center, scale, classes)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    threshold: float = 0.3,
) -> DataFrame:
    """Per row: id, held_out, score, predicted. Fitted on labelled rows whose id's crc32 modulo ``folds`` is not 0.

    Null texts count as empty and get a score like any other. Rows with null ids are scored, never learned from; labels
    other than 0 and 1 are left out. Repeated rows give repeated rows.
    """
    x = materialize(measured(docs, id_col, text_col), "statistics")
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & (crc_remainder("id", folds) != 0))
        .distinct()
    )
    model = fit(x.join(known, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(1).to_pylist()).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows))], names=["id", "score"])

    scored = x.mapInArrow(run, "id long, score double")
    return scored.select(
        F.col("id").alias(id_col),
        (crc_remainder("id", folds) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

"""Bounded samples of labelled documents, and a calibrated score from a few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_column: str, parts: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % parts == remainder, F.lit(False))


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    longest: int,
    id_column: str = "doc_id",
    text: str = "text",
    parts: int = 5,
) -> tuple[dict[int, list[bytes]], dict[int, int]]:
    """Texts of at most `per_class` training rows of each label, in an order by hash, and all rows by label.

    Only rows whose crc32 of the id as text is no multiple of `parts` are used. Null labels and ids
    are left out; of several labels of an id the largest counts. Texts over `longest` bytes are not
    drawn into the sample, and rows beyond `per_class` of a label stay on the executors, however many a drawn
    id has; so the driver gets at most 2 x per_class x longest bytes.
    """
    marked = (
        labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label"))
        .where("_id is not null and _label in (0, 1)")
        .where(~held_out("_id", parts, 0))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    totals = {row[0]: row[1] for row in marked.groupBy("_label").count().collect()}
    chosen = [
        marked.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for k in (0, 1)
    ]
    rows = documents.select(F.col(id_column).alias("_id"), F.col(text).cast("binary").alias("_text"))
    rows = rows.where(F.octet_length("_text") <= longest)
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_text")]
    texts = [rows.join(F.broadcast(ids), "_id").orderBy(*order).limit(per_class) for ids in chosen]
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for row in texts[0].union(texts[1]).orderBy(*order).collect():
        found[row["_label"]].append(bytes(row["_text"]))
    return found, totals


class Calibration:
    """A weighted logistic regression on standardised features, with a small ridge."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> None:
        self.mean, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-9
        x, weights = self._spread(features), weights / weights.mean()
        self.beta = np.zeros(x.shape[1])
        penalty = ridge * len(x) * np.eye(x.shape[1])
        penalty[0, 0] = 1e-9
        for _ in range(50):
            p = self._squash(x @ self.beta)
            slope = x.T @ (weights * (labels - p)) - penalty @ self.beta
            curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
            step = np.linalg.solve(curve, slope)
            self.beta += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break

    def _spread(self, features: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(features), 1)), (features - self.mean) / self.scale], axis=1)

    @staticmethod
    def _squash(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    def score(self, features: np.ndarray) -> np.ndarray:
        return self._squash(self._spread(features) @ self.beta)


def class_weights(labels: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights that give a sample drawn by class the shares of the classes in all rows."""
    drawn = np.bincount(labels, minlength=2)
    share = np.array([totals.get(k, 0) / max(1, drawn[k]) for k in (0, 1)])
    return share[labels]

"""Bounded samples of labelled rows for classifiers, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def place() -> Column:
    """Where an id falls among 2^30 places, by hash."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))


def lowest(df: DataFrame, place: Column, most: int, rows: int) -> DataFrame:
    """The ``most`` rows with the lowest places (below 2^30) of a frame of ``rows`` rows.

    Rows far above the bound are left out first, so that the tasks together hand over
    about twice ``most`` rows however many tasks there are.
    """
    bound = min(1.0, (2 * most + 50) / max(1, rows))
    return df.where(place < F.lit(int(bound * (1 << 30)))).orderBy(place, *df.columns).limit(most)


def labelled(documents: DataFrame, labels: DataFrame, label: str, keep: Column, most: dict[int, int]) -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """([(doc_id, label, text)], rows of each label): at most ``most[label]`` rows of each label, collected.

    Only rows of ``labels`` that satisfy ``keep`` count; which of them are taken
    depends on a hash of the id alone. An id with several labels takes the largest;
    an id with several documents takes each. The ids are broadcast: at most
    ``sum(most.values())`` integers.
    """
    own = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isin(*most)).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    ids = [r for k, n in most.items() for r in lowest(own.where(F.col("label") == k), place(), n, counts.get(k, 0)).collect()]
    if not ids:
        return [], counts
    chosen = documents.sparkSession.createDataFrame(ids, "doc_id long, label int")
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    return sorted(tuple(r) for r in rows.collect()), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept last) of a ridge logistic regression, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    beta, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def probability(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, beta = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ beta[:-1] + beta[-1], -30, 30)))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve; ties count half."""
    _, rank, n = np.unique(score, return_inverse=True, return_counts=True)
    mid = np.cumsum(n) - (n - 1) / 2
    pos = int(y.sum())
    return float((mid[rank][y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))

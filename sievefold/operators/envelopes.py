"""Boundaries around the bulk of the rows: robust covariance by concentration over all rows, and a kernel boundary of all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievefold.functions.scaling import order_statistic, percentiles
from sievefold.operators import boundary
from sievefold.operators.rowid import seeded_sample
from sievefold.sources.store import Scratch


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariance in one aggregate of bounded width."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    means = np.array([v if v is not None else 0.0 for v in row[:k]], float)
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k:], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return means, cov


def mahalanobis_score(columns: Sequence[str], means: np.ndarray, inverse: np.ndarray) -> Column:
    """A quadratic form as one expression."""
    d = [F.col(c) - float(m) for c, m in zip(columns, means, strict=True)]
    total = sum((float(inverse[i, j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def sample_matrix(df: DataFrame, key: str, columns: Sequence[str], n: int, seed: int) -> np.ndarray:
    """At most n rows for a start; n is the documented bound on what the driver holds."""
    rows = seeded_sample(df.select(key, *columns), key, n, seed).select(*[F.col(c).cast("double") for c in columns]).toArrow()
    return np.column_stack([c.to_numpy() for c in rows.columns]) if rows.num_rows else np.zeros((0, len(columns)))


def _voted(scored: DataFrame, contamination: float) -> DataFrame:
    cut = percentiles(scored, ["score"], [1 - contamination])[0][0]
    return scored.withColumn("vote", (F.col("score") > F.lit(cut).cast("double")).cast("int"))


# robust covariance --------------------------------------------------------------


#: Added to the diagonal, so that columns in a plane have an inverse.
RIDGE = 1e-9


def log_determinant(cov: np.ndarray) -> float:
    return float(np.linalg.slogdet(cov + RIDGE * np.eye(len(cov)))[1])


def concentrate(x: np.ndarray, seed: int = 42, starts: int = 20, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the half of a sample with the least determinant: concentration from several random starts."""
    rng = np.random.default_rng(seed)
    n, k = x.shape
    half, best = (n + k + 1) // 2, (np.inf, x.mean(0), np.zeros((k, k)))
    for _ in range(starts):
        rows = rng.choice(n, min(n, k + 2), replace=False)
        for _ in range(steps):
            mean, cov = x[rows].mean(0), np.atleast_2d(np.cov(x[rows], rowvar=False)) if len(rows) > 1 else np.zeros((k, k))
            d = ((x - mean) @ np.linalg.pinv(cov + RIDGE * np.eye(k)) * (x - mean)).sum(1)
            nearest = np.sort(np.argsort(d, kind="stable")[:half])
            if len(rows) == len(nearest) and (np.sort(rows) == nearest).all():
                break
            rows = nearest
        mean, cov = x[rows].mean(0), np.atleast_2d(np.cov(x[rows], rowvar=False)) if len(rows) > 1 else np.zeros((k, k))
        if (size := log_determinant(cov)) < best[0]:
            best = size, mean, cov
    return best[1], best[2]


@dataclass
class Robust:
    """Centre and covariance of the tightest half of all rows, with the log-determinant after each step."""

    mean: np.ndarray
    cov: np.ndarray
    steps: list[float]

    @property
    def inverse(self) -> np.ndarray:
        return np.linalg.pinv(self.cov + RIDGE * np.eye(len(self.cov)))


def robust_covariance(df: DataFrame, key: str, columns: Sequence[str], sample: int = 5_000, seed: int = 42, most: int = 50) -> Robust:
    """Concentration over all rows from the best half of a sample.

    A step finds the h-th least distance of all rows to the present centre by a rank search, and the mean and
    covariance of the rows up to it in one aggregate. The determinant never rises; steps end when it no
    longer falls. ``sample`` bounds what the driver holds for the start; with no rows the centre is 0.
    """
    k, n = len(columns), df.count()
    start = sample_matrix(df, key, columns, sample, seed)
    if not n:
        return Robust(np.zeros(k), np.zeros((k, k)), [])
    found = Robust(*concentrate(start, seed), [])
    half = min(n, (n + k + 1) // 2)
    for _ in range(most):
        measured = df.select(*columns, mahalanobis_score(columns, found.mean, found.inverse).alias("_d"))
        limit = order_statistic(measured, "_d", half - 1, n)
        mean, cov = covariance(measured.filter(F.col("_d") <= limit), columns)
        size = log_determinant(cov)
        if found.steps and size >= found.steps[-1] - 1e-12:
            break
        found = Robust(mean, cov, [*found.steps, size])
    return found


def envelope(df: DataFrame, key: str, columns: Sequence[str], contamination: float = 0.05, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(key, score, vote): robust distance with 0/1 votes above the quantile of all rows' distances. Columns hold no nulls."""
    wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    found = robust_covariance(wide, key, columns, seed=seed)
    return _voted(wide.select(key, mahalanobis_score(columns, found.mean, found.inverse).alias("score")), contamination)


# kernel boundary ----------------------------------------------------------------


def one_class(df: DataFrame, key: str, columns: Sequence[str], contamination: float = 0.05, scratch: Scratch | None = None) -> DataFrame:
    """(key, score, vote): kernel boundary, gamma 1 / columns, fitted to all rows (``boundary.py``).

    A vote is above the quantile of all rows' scores.
    """
    scratch = scratch or Scratch(df.sparkSession)
    found = boundary.fit(df, columns, contamination, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(-found.values(x), boundary.DIGITS))], names=[key, "score"])

    inner = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    scored = inner.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, score double")
    return _voted(scratch.table(scored, "boundary"), contamination)

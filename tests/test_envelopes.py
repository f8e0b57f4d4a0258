"""Robust covariance over all rows, and the kernel boundary."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievefold.functions import scaling
from sievefold.operators import envelopes


def table(spark, x):
    columns = [f"c{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "key long, " + ", ".join(f"{c} double" for c in columns)), columns


def spread(seed, n=900, out=250):
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(3, 3))
    return np.concatenate([rng.normal(size=(n, 3)) @ turn, rng.normal(30, 0.5, (out, 3))])


def test_determinant_never_rises_and_the_bulk_is_found(spark):
    """A fifth of the rows lie far off in a group; from a start of 40 rows all rows decide."""
    x = spread(1)
    frame, columns = table(spark, x)
    found = envelopes.robust_covariance(frame, "key", columns, sample=40)
    assert len(found.steps) >= 2 and all(b < a for a, b in zip(found.steps, found.steps[1:], strict=False))
    assert np.abs(found.mean - x[:900].mean(0)).max() < 0.3 and np.abs(x.mean(0) - x[:900].mean(0)).max() > 5
    d = np.sqrt(((x - found.mean) @ found.inverse * (x - found.mean)).sum(1))
    assert d[:900].max() < d[900:].min()


def test_equals_the_local_fit_on_a_small_table(spark):
    x = spread(2, 300, 60)
    frame, columns = table(spark, x)
    order = [r["key"] for r in frame.orderBy(F.md5(F.concat(F.lit("42:"), "key")), "key").collect()]
    mean, cov = envelopes.concentrate(x[order])
    found = envelopes.robust_covariance(frame, "key", columns)
    assert np.allclose(found.mean, mean) and np.allclose(found.cov, cov, rtol=1e-6)
    assert found.steps[-1] <= envelopes.log_determinant(cov) + 1e-9


def test_rank_search_equals_sorting(spark, monkeypatch):
    """With few values held at once, each step's limit is found by narrowing; the result is the same."""
    frame, columns = table(spark, spread(3))
    whole = envelopes.robust_covariance(frame, "key", columns, sample=50)
    monkeypatch.setattr(envelopes, "order_statistic", lambda df, c, k, n: scaling.order_statistic(df, c, k, n, held=10))
    small = envelopes.robust_covariance(frame, "key", columns, sample=50)
    assert np.allclose(whole.mean, small.mean) and np.allclose(whole.cov, small.cov) and len(whole.steps) == len(small.steps)


def test_envelope_votes(spark):
    x = spread(4)
    frame, columns = table(spark, x)
    got = {r["key"]: r for r in envelopes.envelope(frame, "key", columns, 0.25).collect()}
    scores = np.array([got[k]["score"] for k in range(len(x))])
    assert [got[k]["vote"] for k in range(len(x))] == (scores > np.percentile(scores, 75)).astype(int).tolist()
    assert all(got[k]["vote"] for k in range(900, 1150))


@pytest.mark.parametrize("x", [np.zeros((0, 2)), np.zeros((1, 2)), np.ones((30, 2)), np.column_stack([np.arange(30.0), np.arange(30.0)])])
def test_few_equal_and_flat_rows(spark, x):
    frame, columns = table(spark, x)
    for method in (envelopes.envelope, envelopes.one_class):
        got = method(frame, "key", columns).collect()
        assert len(got) == len(x) and all(np.isfinite(r["score"]) for r in got)


def test_kernel_boundary_meets_its_conditions(spark):
    """Rows inside score alike at most the boundary's level; the planted ones lie outside, and votes are a share of all rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(600, 2)), [[6, 6], [-6, 5], [0, 9]]])
    frame, columns = table(spark, x)
    got = {r["key"]: r for r in envelopes.one_class(frame, "key", columns).collect()}
    assert all(got[k]["vote"] for k in (600, 601, 602)) and sum(r["vote"] for r in got.values()) <= 31
    assert min(got[k]["score"] for k in (600, 601, 602)) >= np.quantile([r["score"] for r in got.values()], 0.98)

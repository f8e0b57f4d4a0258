"""Exact percentiles found by narrowing, against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievefold.functions import scaling

PS = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
N = 20_000
rng = np.random.default_rng(4)
COLUMNS = {
    "even": rng.random(N),
    "heavy": rng.standard_cauchy(N) ** 3,
    "same": np.full(N, 7.25),
    "few": rng.integers(0, 3, N).astype(float),
    "third": np.where(rng.random(N) < 0.34, 5.0, rng.normal(5, 1e-9, N)),
    "wide": rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324], N) * rng.random(N),
    "infinite": np.where(rng.random(N) < 0.1, -np.inf, np.where(rng.random(N) < 0.1, np.inf, rng.random(N))),
    "ends": np.r_[-np.inf, np.inf, rng.random(N - 2)],
    "only infinite": rng.choice([-np.inf, np.inf], N),
}


@pytest.fixture(scope="module")
def frame(spark):
    names = list(COLUMNS)
    rows = [(*(float(COLUMNS[n][k]) for n in names), float("nan") if k % 10 == 0 else float(k), None, 3.5 if k == 77 else None) for k in range(N)]
    schema = ", ".join(f"`{n}` double" for n in [*names, "nan", "none", "one"])
    return spark.createDataFrame(rows, schema).repartition(7).persist()


def want(values, p):
    """numpy's own interpolation, but for equal neighbours, which need none."""
    s = np.sort(values)
    at = p * (len(s) - 1)
    low, high = float(s[math.floor(at)]), float(s[math.ceil(at)])
    return low if low == high else low * (math.ceil(at) - at) + high * (at - math.floor(at))


def close(a, b):
    return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-12)


@pytest.mark.parametrize("held", [10, 5_000, 1_000_000])
def test_against_numpy(frame, held):
    every = [F.col(f"`{n}`") for n in COLUMNS]
    got = scaling.percentiles(frame, every, PS, held)
    for n, found in zip(COLUMNS, got, strict=True):
        for p, v in zip(PS, found, strict=True):
            if held < N or np.isfinite(COLUMNS[n]).all():
                assert close(v, want(COLUMNS[n], p)), (n, p, v)


@pytest.mark.parametrize("held", [10, 1_000_000])
def test_nan_nulls_and_few_values(frame, held):
    nan, none, one = scaling.percentiles(frame, ["nan", "none", "one"], (0.0, 0.5, 0.85, 0.95, 1.0), held)
    plain = [float(k) for k in range(N) if k % 10]
    s = np.r_[plain, [math.inf] * (N - len(plain))]
    assert nan[:3] == [want(s, p) for p in (0.0, 0.5, 0.85)] and all(map(math.isnan, nan[3:]))
    assert none == [None] * 5 and one == [3.5] * 5
    assert scaling.percentiles(frame.limit(0), ["even"], (0.5,), held) == [[None]]
    assert scaling.percentiles(frame, [], (0.5,), held) == []


def test_rounds_serve_all_columns_and_ranks(frame, monkeypatch):
    """As many aggregates for nine columns and seven ranks as for one."""
    calls = []
    own = type(frame).agg
    monkeypatch.setattr(type(frame), "agg", lambda self, *a: calls.append(1) or own(self, *a))
    scaling.percentiles(frame, ["even"], (0.5,), 1000)
    once = len(calls)
    scaling.percentiles(frame, [F.col(f"`{n}`") for n in COLUMNS], PS, 63_000)
    assert once <= 4 and len(calls) - once <= 4  # a count, a round of two, what is left

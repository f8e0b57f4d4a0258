"""The kernel boundary is that of all rows, whatever is held at once."""

from __future__ import annotations

import numpy as np
import pytest
from test_envelopes import table

from sievefold.operators import boundary, envelopes
from sievefold.sources.store import Scratch


def exact_scores(x: np.ndarray, nu: float) -> np.ndarray:
    """Scores by the whole kernel matrix of all rows. That both bounds meet proves them, whatever found them."""
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / x.shape[1])
    value, vector = np.linalg.eigh(kernel)
    own = vector[:, value > 1e-12] * np.sqrt(value[value > 1e-12])
    assert np.abs(own @ own.T - kernel).max() < 1e-9
    w, rho = boundary.interior(own, np.full(len(x), 1 / (nu * len(x))), np.zeros(own.shape[1]), 1.0)
    assert w @ w - rho + np.maximum(rho - own @ w, 0).sum() / (nu * len(x)) < 1e-10
    return -own @ w


def skewed(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.exponential(size=n), rng.uniform(-1.7, 1.7, n)])


def test_scores_are_those_of_all_rows(spark):
    """More rows than the sample of 1,000 that the boundary was once fitted on."""
    x = skewed(1500, 1)
    frame, columns = table(spark, x)
    got = {r["key"]: r for r in envelopes.one_class(frame, "key", columns).collect()}
    scores, want = np.array([got[k]["score"] for k in range(len(x))]), exact_scores(x, 0.05)
    assert np.abs(scores - want).max() < 1e-5
    votes = np.array([got[k]["vote"] for k in range(len(x))])
    assert (votes == (want > np.percentile(want, 95) + 1e-6)).all() and 50 < votes.sum() < 75  # rows on the boundary all score as the quantile


@pytest.mark.parametrize("nu", [0.05, 0.5])
def test_what_is_held_does_not_matter(spark, nu):
    """Cells of all rows, of a band, and few rows one by one lead to the boundary that all rows held at once give."""
    x = skewed(4000, 2)
    frame, columns = table(spark, x)
    whole = boundary.fit(frame, columns, nu, Scratch(spark), held=4000)
    few = boundary.fit(frame, columns, nu, Scratch(spark), held=150)
    assert len(whole.gaps) == 1 and max(whole.gaps[-1], few.gaps[-1]) <= boundary.GAP
    assert np.abs(whole.values(x) - few.values(x)).max() < 1e-5 and abs(whole.rho - few.rho) < 1e-5
    assert (whole.values(x) < whole.rho - 1e-5).sum() <= nu * len(x) <= (whole.values(x) < whole.rho + 1e-5).sum()


def test_a_bad_start_is_mended(spark):
    """With very few rows held, cells say little, and a round's solution is gone to in part only."""
    x = skewed(1200, 3)
    frame, columns = table(spark, x)
    few = boundary.fit(frame, columns, 0.2, Scratch(spark), held=40)
    assert few.gaps[-1] <= boundary.GAP and np.abs(-few.values(x) - exact_scores(x, 0.2)).max() < 1e-5


def test_the_level_lies_where_its_share_of_rows_ends():
    """Were the level off, a band would need all rows up to it; it is moved, each time to a small part of what it was off."""
    x = skewed(3000, 7)
    marks = boundary.Landmarks(np.zeros((0, 2)), 0.5)
    marks.extend(x, boundary.TOLERANCE)
    w = marks.features(x).mean(0)
    want = np.sort(marks.features(x) @ w)[149]
    for start in (want + 0.2, want - 0.2, want + 2):
        now, moves = boundary.Boundary(marks, w, start), 0
        while True:
            seen = boundary.Measured()
            seen.add(x, np.ones(len(x)), now, now)
            if not seen.wider(seen.within(50, 150), 50):
                break
            now, moves = boundary.Boundary(marks, w, now.rho - seen.off(150)), moves + 1
        assert 0 < moves < 10 and abs(now.rho - want) < 0.03


def test_copies_weigh_as_rows(spark):
    x = skewed(300, 4)
    once, columns = table(spark, x)
    thrice, _ = table(spark, np.repeat(x, 3, 0))
    a, b = (boundary.fit(f, columns, 0.1, Scratch(spark)) for f in (once, thrice))
    assert np.abs(a.values(x) - b.values(x)).max() < 1e-5


def test_landmarks_serve_all_rows(spark):
    """Rows far off one by one, which few rows chosen beforehand would miss, have the kernel exactly too."""
    x = np.concatenate([skewed(2000, 5), [[1000.0, 0], [1000.5, 0], [-5e4, 3], [1e6, 1e6]]])
    frame, columns = table(spark, x)
    found = boundary.landmarks(frame.repartition(3), columns, 0.5)
    features = found.features(x)
    assert (1 - (features**2).sum(1)).max() <= boundary.TOLERANCE and len(found.points) < 400
    assert np.abs(features @ features.T - found.kernel(x, x)).max() <= 2 * boundary.TOLERANCE


def test_missing_and_infinite_rows_are_left_out(spark):
    x = skewed(100, 6)
    frame, columns = table(spark, x)
    more, _ = table(spark, np.concatenate([x, [[np.nan, 0], [np.inf, 0]]]))
    a, b = (boundary.fit(f, columns, 0.1, Scratch(spark)) for f in (frame, more))
    assert np.abs(a.values(x) - b.values(x)).max() < 1e-6
    assert len(envelopes.one_class(more, "key", columns, 0.1).collect()) == 102

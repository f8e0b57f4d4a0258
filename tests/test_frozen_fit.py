"""What a batch leaves to a stream is found in one fit, and small chunks are scored as large batches are."""

from __future__ import annotations

import numpy as np

from sievefold.functions.scaling import percentiles
from sievefold.operators import detectors, forest
from sievefold.streaming import consensus as streaming


def test_one_fit_gives_the_limit_of_the_batch(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(1000, 2))
    batch = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "row_id long, a double, b double").persist()
    votes = detectors.chunk_votes(batch, "row_id", ["a", "b"])
    want = percentiles(votes.selectExpr("method_specific_scores['isolation_forest'] AS s"), ["s"], [0.95])[0][0]
    fits, own = [], detectors.ChunkScores.fit.__func__
    monkeypatch.setattr(detectors.ChunkScores, "fit", classmethod(lambda *a, **more: fits.append(1) or own(*a, **more)))
    frozen = streaming.Frozen.fit(batch, "row_id", ["a", "b"])
    assert (frozen.limit, frozen.rows, len(fits)) == (want, 1000, 1)
    empty = streaming.Frozen.fit(batch.limit(0), "row_id", ["a", "b"])
    assert (empty.limit, empty.rows) == (0.0, 0)


def test_few_rows_go_down_all_trees_as_many_do(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    nodes = [(t, *n[:3], n[4]) for t in range(20) for n in forest.grow(x[rng.permutation(300)[:64]], "f", t, forest.height_of(64), 1)]
    model = forest.Forest.of([(t, k, f, at, d) for t, k, f, at, d in nodes], 20, 64)
    few = model.score(x)
    monkeypatch.setattr(forest, "FEW", 0)
    assert (few == model.score(x)).all() and len(np.unique(few)) > 100

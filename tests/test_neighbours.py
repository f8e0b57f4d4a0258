"""Neighbours, k-nearest scores and local outlier factors over all rows, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from sievefold.operators import neighbours
from sievefold.operators.neighbours import NearestRules


def table(spark, x, key=int):
    columns = [f"c{k}" for k in range(x.shape[1])]
    kind = "long" if key is int else "string"
    return spark.createDataFrame([(key(k), *map(float, v)) for k, v in enumerate(x)], f"key {kind}, " + ", ".join(f"{c} double" for c in columns)), columns


def brute(x, keys, k):
    """The k nearest other rows of each row by distance, then key."""
    out = {}
    for i, key in enumerate(keys):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted((float(d[j]), keys[j]) for j in range(len(x)) if j != i)
        out[key] = order[:k]
    return out


def same(got, want):
    return len(got) == len(want) and all(g["key"] == w[1] and abs(g["distance"] - w[0]) < 1e-9 for g, w in zip(got, want, strict=True))


RULES = [NearestRules(), NearestRules(block=8, pivots=9, held=2, passing=3), NearestRules(block=1, pivots=3)]


@pytest.mark.parametrize("rules", RULES)
def test_nearest_with_copies_and_ties(spark, rules):
    """A third of the rows are one point; whole numbers make many ties, which go by key."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 6, (120, 2)), np.full((60, 2), 3), rng.integers(0, 2, (10, 2)) * 1000]).astype(float)
    frame, columns = table(spark, x)
    want = brute(x, list(range(len(x))), 5)
    got = neighbours.nearest(frame, "key", columns, 5, rules).collect()
    assert len(got) == len(x)
    assert all(same(r["near"], want[r["key"]]) for r in got)


def test_nearest_of_few_rows_and_text_keys(spark):
    for n in (0, 1, 2, 4):
        x = np.arange(n * 3.0).reshape(n, 3)
        frame, columns = table(spark, x, str)
        want = brute(x, [str(k) for k in range(n)], 3)
        got = neighbours.nearest(frame, "key", columns, 3, NearestRules(block=2)).collect()
        assert len(got) == n and all(same(r["near"], want[r["key"]]) for r in got)


def test_most_pairs_of_blocks_are_skipped(spark):
    """Forty groups far apart: a block meets few others, and nothing is lost."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 100, (40, 8))[rng.integers(0, 40, 2400)] + rng.normal(0, 1, (2400, 8))
    frame, columns = table(spark, x)
    found = neighbours.Neighbours(frame, "key", columns, 10, NearestRules(block=30, pivots=64))
    assert found.blocks.count() >= 80 and found.share_met() < 0.25
    want = brute(x, list(range(len(x))), 10)
    assert all(same(r["near"], want[r["key"]]) for r in found.nearest().collect())


def test_close_points_far_from_the_origin(spark):
    """Where the quick form of a distance loses all digits, the exact one decides."""
    rng = np.random.default_rng(6)
    x = 1e7 + rng.integers(0, 50, (200, 4)) * 1e-3
    frame, columns = table(spark, x)
    want = brute(x, list(range(len(x))), 4)
    assert all(same(r["near"], want[r["key"]]) for r in neighbours.nearest(frame, "key", columns, 4, NearestRules(block=32)).collect())


@pytest.mark.parametrize("block", [40, 4096])
def test_knn(spark, block):
    x = np.random.default_rng(3).normal(size=(300, 5))
    frame, columns = table(spark, x)
    apart = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)
    cut = np.percentile(apart[:, 15], 95)
    for r in neighbours.knn(frame, "key", columns, rules=NearestRules(block=block)).collect():
        assert abs(r["score"] - apart[r["key"], 14]) < 1e-9 and r["vote"] == int(apart[r["key"], 14] > cut)


def test_lof(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(20, 0.1, (100, 2)), [[10, 10], [20, 22]], np.full((40, 2), 5.0)])
    frame, columns = table(spark, x)
    near = brute(x, list(range(len(x))), 20)
    radius = {i: n[-1][0] for i, n in near.items()}
    density = {i: 1 / (np.mean([max(d, radius[j]) for d, j in n]) + 1e-10) for i, n in near.items()}
    want = np.array([np.mean([density[j] for _, j in near[i]]) / density[i] for i in range(len(x))])
    cut = np.percentile(want, 95)
    got = {r["key"]: r for r in neighbours.lof(frame, "key", columns, rules=NearestRules(block=32, pivots=6)).collect()}
    assert all(np.isclose(got[i]["score"], want[i], rtol=1e-9) and got[i]["vote"] == int(want[i] > cut) for i in range(len(x)))
    assert got[250]["vote"] == got[251]["vote"] == 1  # alone, and near a dense group
    assert neighbours.lof(frame.limit(0), "key", columns).count() == 0
    assert [r["score"] for r in neighbours.lof(frame.limit(1), "key", columns).collect()] == [1.0]


def test_blocks_of_few_columns_meet_those_around_them(spark):
    """Eight times the rows, and a block still meets about nine; with two pivots' rings it met most of all."""
    for n in (1000, 8000):
        frame, columns = table(spark, np.random.default_rng(7).random((n, 2)))
        found = neighbours.Neighbours(frame, "key", columns, 5, NearestRules(block=16, pivots=2))
        assert found.share_met() * found.blocks.count() < 15


def test_scores_without_a_graph(spark):
    """One search for both scores equals the graphs' scores, with points of more copies than neighbours and a few far away."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), np.full((40, 2), 3.0), rng.integers(0, 4, (60, 2)), [[1e3, 0], [0, -1e4]]])
    frame, columns = table(spark, x)
    boxes, wide = NearestRules(block=16), NearestRules(block=16, pivots=6, boxes=0)
    lof, knn = ({r["key"]: r for r in f.collect()} for f in neighbours.lof_and_knn(frame, "key", columns, 20, 15, rules=boxes))
    for got, want in ((lof, neighbours.lof(frame, "key", columns, rules=wide)), (knn, neighbours.knn(frame, "key", columns, rules=wide))):
        want = {r["key"]: r for r in want.collect()}
        assert len(got) == len(want) == len(x)
        assert all(np.isclose(got[k]["score"], w["score"], rtol=1e-9) and got[k]["vote"] == w["vote"] for k, w in want.items())


def test_a_task_holds_one_group(spark):
    """However groups and chunks are numbered, no task gets the blocks of two, so batches don't grow with the input."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    frame, columns = table(spark, np.random.default_rng(4).random((400, 6)))
    found = neighbours.Neighbours(frame, "key", columns, 3, NearestRules(block=8, pivots=3, held=2, passing=4))
    made = found._met(found.blocks, (), lambda block, near, row: pa.RecordBatch.from_arrays([row.column("b")], names=["b"]), "b long")
    tasks = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 20 and max(tasks) <= 2

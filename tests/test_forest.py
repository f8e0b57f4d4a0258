"""Isolation forests: whose rows trees grow from, how they grow and how they score."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from sievefold.operators import forest


def table(spark, x):
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "key long, a double, b double").repartition(5)


def hashed(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_trees_take_the_rows_of_least_hash_and_split_them(spark):
    """Every tree against its own rows, found here among all; 3,000 rows, so that the bound sifts most."""
    x = np.random.default_rng(1).normal(size=(3000, 2))
    x[:, 1] = np.round(x[:, 1])
    rows = forest.fit_trees(table(spark, x), "key", {"all": ["a", "b"], "one": ["b"]}, trees=7, seed=3).collect()
    h = np.array([hashed(3, k) % forest.PRIME for k in range(3000)], np.int64)
    samples = []
    for tree in range(7):
        a, b = 1 + hashed(3, "a", tree) % (forest.PRIME - 1), hashed(3, "b", tree) % forest.PRIME
        own = np.lexsort((np.arange(3000), (h * a + b) % forest.PRIME))[:256]
        samples.append(set(own.tolist()))
        for name, columns in (("all", [0, 1]), ("one", [1])):
            nodes = {r["node"]: r for r in rows if r["tree"] == tree and r["forest"] == name}
            assert nodes[1]["size"] == 256
            at = {1: own}
            for node in sorted(nodes):
                r, inside = nodes[node], at[node]
                assert r["size"] == len(inside)
                if r["feature"] is None:
                    assert node.bit_length() - 1 == 8 or len(inside) < 2 or (x[inside][:, columns] == x[inside[0]][columns]).all()
                    assert abs(r["depth"] - (node.bit_length() - 1 + float(forest.average_path(len(inside))))) < 1e-12
                else:
                    v = x[inside][:, columns[r["feature"]]]
                    assert v.min() <= r["threshold"] <= v.max()
                    at[2 * node], at[2 * node + 1] = inside[v < r["threshold"]], inside[v >= r["threshold"]]
            assert all(2 * n in nodes and 2 * n + 1 in nodes for n, r in nodes.items() if r["feature"] is not None)
    assert len(set.union(*samples)) > 1000  # trees don't share a sample


def test_one_shuffle_serves_all_columns(spark):
    frame = table(spark, np.random.default_rng(2).normal(size=(100, 2)))
    plan = forest.fit_trees(frame, "key", {"all": ["a", "b"], "a": ["a"], "b": ["b"]}, trees=5, n=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scores(spark):
    x = np.concatenate([np.random.default_rng(4).normal(size=(400, 2)), [[30, 30]]])
    frame = table(spark, x)
    made = forest.fit_forests(frame, "key", {"all": ["a", "b"], "a": ["a"]}, trees=25)
    slow = made["all"].score(x)
    assert (slow > 0).all() and (slow < 1).all() and slow.argmax() == 400
    one = made["a"]
    probes = np.r_[x[:, 0], one.threshold[one.feature >= 0], -1e300, 1e300][:, None]
    assert (one.score(probes) == one.score(probes, one.steps())).all()
    got = {r["key"]: r for r in forest.score_forests(frame, "key", {"all": ["a", "b"], "a": ["a"]}, made, "b").collect()}
    assert all(got[k]["score_0"] == slow[k] and got[k]["b"] == x[k, 1] for k in range(401))
    votes = forest.fit_score(frame, "key", ["a", "b"], 0.05, trees=25).collect()
    assert sum(r["vote"] for r in votes) == sum(r["score"] > np.percentile(slow, 95) for r in votes) <= 21
    assert max(votes, key=lambda r: r["score"])["key"] == 400


def test_few_equal_and_no_rows(spark):
    assert forest.fit_score(table(spark, np.zeros((0, 2))), "key", ["a", "b"]).count() == 0
    for n in (1, 2, 3, 300):
        same = forest.fit_score(table(spark, np.ones((n, 2))), "key", ["a", "b"], trees=3).collect()
        assert len(same) == n and len({r["score"] for r in same}) == 1 and not any(r["vote"] for r in same)
    two = forest.fit_score(table(spark, np.array([[0.0, 0], [1, 1]])), "key", ["a", "b"], trees=9).collect()
    assert len({r["score"] for r in two}) == 1


def test_text_keys_and_results_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(6).normal(size=(700, 2))
    named = table(spark, x).withColumn("key", F.concat(F.lit("k"), F.col("key")))
    first = {r["key"]: r["score"] for r in forest.fit_score(named, "key", ["a", "b"], trees=5).collect()}
    again = {r["key"]: r["score"] for r in forest.fit_score(named.repartition(2, "a"), "key", ["a", "b"], trees=5).collect()}
    assert first == again and len(set(first.values())) > 100

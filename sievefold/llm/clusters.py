"""Exact k-means on whole numbers, by kd-trees that filter centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.llm.negatives import whole_numbers
from sievefold.llm.shared import Scratch

#: Components beyond this could make a squared distance that doesn't fit in a long.
LARGEST = 1 << 26
#: A tree as a row of a table; two-dimensional arrays lie flat.
ROW = "ids array<long>, points array<int>, first array<int>, size array<int>, child array<int>, low array<int>, high array<int>, total array<long>"


@dataclass(frozen=True)
class ClusterRules:
    """Vectors of a tree and of a leaf don't change the result."""

    k: int = 40
    rounds: int = 5
    width: int = 64
    scale: int = 256
    seed: int = 2
    tree: int = 2048
    leaf: int = 32


@dataclass
class Tree:
    """Points in the order of leaves, and nodes by level: their stretch of points, box, sum and first child (-1 at a leaf)."""

    order: np.ndarray
    points: np.ndarray
    first: np.ndarray
    size: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, leaf: int) -> Tree:
        """Nodes are cut at the median of the widest side of their box; equal points are never cut apart from need."""
        order = np.arange(len(x))
        first, size, child, low, high = [0], [len(x)], [], [], []
        at = 0
        while at < len(first):
            rows = order[first[at] : first[at] + size[at]]
            inside = x[rows]
            low.append(inside.min(0))
            high.append(inside.max(0))
            spread = high[-1] - low[-1]
            if len(rows) <= leaf or not spread.any():
                child.append(-1)
            else:
                half = len(rows) // 2
                order[first[at] : first[at] + size[at]] = rows[np.argpartition(inside[:, int(spread.argmax())], half)]
                child.append(len(first))
                first += [first[at], first[at] + half]
                size += [half, len(rows) - half]
            at += 1
        points = x[order]
        ends = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(points, 0)])
        start, count = np.array(first), np.array(size)
        return cls(order, points, start, count, np.array(child), np.array(low), np.array(high), ends[start + count] - ends[start])

    def held(self, node: int) -> slice:
        return slice(self.first[node], self.first[node] + self.size[node])

    def filter(self, c: np.ndarray) -> Iterator[tuple[int, int | np.ndarray]]:
        """(node, the nearest centroid's number): one number for whole nodes where one is left, else leaves with one for each point.

        A centroid is dropped from a node if even the corner of the box that favours it most is strictly nearer
        to the one nearest to the middle of the box; so ties are left to the leaves, where the smaller number wins.
        """
        nodes, left = np.zeros(1, int), np.ones((1, len(c)), bool)
        while len(nodes):
            low, high = self.low[nodes][:, None], self.high[nodes][:, None]
            middle = ((2 * c[None] - low - high) ** 2).sum(2)
            nearest = np.where(left, middle, np.iinfo(np.int64).max).argmin(1)
            best = c[nearest][:, None]
            away = c[None] - best
            left &= (away * (c[None] + best - 2 * np.where(away > 0, high, low))).sum(2) <= 0
            one = left.sum(1) == 1
            for n, k in zip(nodes[one].tolist(), left[one].argmax(1).tolist(), strict=True):
                yield n, k
            ends = ~one & (self.child[nodes] < 0)
            for n, some in zip(nodes[ends].tolist(), left[ends], strict=True):
                some = np.flatnonzero(some)
                inside = self.points[self.held(n)]
                yield n, some[distances(inside, c[some]).argmin(1)]
            inner = ~one & ~ends
            nodes = np.concatenate([self.child[nodes[inner]], self.child[nodes[inner]] + 1])
            left = np.concatenate([left[inner], left[inner]])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers, exact: in doubles where all sums stay below 2**53, else in longs."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) ** 2 * 4 * x.shape[1] < 1 << 53:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def _trees(df: DataFrame, id_col: str, vector_col: str, rules: ClusterRules, scratch: Scratch) -> DataFrame:
    """A written table with a kd-tree for each ``tree`` vectors of a task."""
    inner = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("x"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = inner.filter((F.size("x") == rules.width) & ~F.exists("x", bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rules.tree):
                part = batch.slice(at, rules.tree)
                whole = whole_numbers(part.column("x"), rules.scale, rules.width)
                if np.abs(whole).max(initial=0) > LARGEST:
                    raise OverflowError(f"a component times {rules.scale} is beyond {LARGEST}")
                tree = Tree.build(whole.astype(np.int64), rules.leaf)
                narrow = [tree.points, tree.first, tree.size, tree.child, tree.low, tree.high]
                arrays = [part.column("id").take(pa.array(tree.order)), *(pa.array(a.ravel().astype(np.int32)) for a in narrow), pa.array(tree.total.ravel())]
                kinds = [pa.int64()] + [pa.int32()] * 6 + [pa.int64()]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.cast(kind)) for a, kind in zip(arrays, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(lists, names=[f.split()[0] for f in ROW.split(", ")])

    return scratch.table(kept.mapInArrow(run, ROW), "trees")


def _read(batch: pa.RecordBatch, k: int, width: int) -> tuple[pa.Array, Tree]:
    """The tree in a row of the table, with the ids of its points."""
    plain = lambda c: batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lambda c: plain(c).reshape(-1, width)
    ids = batch.column("ids")[k].values
    return ids, Tree(np.arange(len(ids)), flat("points"), plain("first"), plain("size"), plain("child"), flat("low"), flat("high"), flat("total"))


def _starts(df: DataFrame, id_col: str, vector_col: str, rules: ClusterRules) -> np.ndarray:
    """The first centroids: of the vectors that take part, the ``k`` with the least hashes of their ids."""
    kept = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("x"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = kept.filter((F.size("x") == rules.width) & ~F.exists("x", bad) & F.col("id").isNotNull())
    rank = F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(rank, "id", "x").limit(rules.k).select("x").toArrow().combine_chunks()
    column = first.column("x").combine_chunks() if first.num_rows else pa.array([], pa.list_(pa.float64()))
    return whole_numbers(column, rules.scale, rules.width).astype(np.int64)


def _moved(trees: DataFrame, c: np.ndarray) -> np.ndarray:
    """Centroids after one round: each the floor of the mean of its vectors, an empty one as it was.

    A task sends one row for each centroid and component, whatever it read.
    """
    k, width = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                _, tree = _read(batch, at, width)
                for node, own in tree.filter(c):
                    if isinstance(own, int):
                        count[own] += tree.size[node]
                        total[own] += tree.total[node]
                    else:
                        count += np.bincount(own, minlength=k)
                        np.add.at(total, own, tree.points[tree.held(node)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * width)), pa.array(np.repeat(count, width)), pa.array(total.ravel())], names=["cell", "n", "total"])

    cells = trees.mapInArrow(run, "cell long, n long, total long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = c.copy()
    for r in cells.filter("n > 0").collect():  # k * width rows
        new[r["cell"] // width, r["cell"] % width] = int(r["total"]) // r["n"]
    return new


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rules: ClusterRules = ClusterRules(), scratch: Scratch | None = None) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Components are floor(scale * x). ``rounds`` times each vector goes to the nearest centroid, the one
    with the smaller number among equals, and each centroid to the floor of its vectors' mean; then vectors are
    assigned once more. All sums and distances are exact. kd-trees over ``tree`` vectors
    each are built once and written; a round is one pass over them that hands ``k`` centroids to tasks and
    gets a row for each centroid and component from each task. Nothing is shuffled by cluster, so one cluster, or one vector in very many
    copies (a box of no width, assigned whole), costs no more than others.

    Vectors that are null, of another length, or with a component that is null or not finite take no part.
    Null ids are assigned but start no centroid; repeated rows count each, as starts too; with fewer
    vectors than ``k`` there are so many centroids, and with none (or an empty table) no rows. Other columns are
    ignored. A component beyond 2**26 after scaling raises. The result reads tables in ``scratch``.
    """
    scratch = scratch or Scratch(df.sparkSession)
    c = _starts(df, id_col, vector_col, rules)
    if not len(c):
        kinds = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return df.sparkSession.createDataFrame([], kinds)
    trees = _trees(df, id_col, vector_col, rules, scratch)
    for _ in range(rules.rounds):
        c = _moved(trees, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, tree = _read(batch, at, c.shape[1])
                near = np.zeros(len(ids), np.int32)
                for node, own in tree.filter(c):
                    near[tree.held(node)] = own
                far = ((tree.points - c[near]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(near), pa.array(far)], names=["id", "cluster", "distance"])

    assigned = scratch.table(trees.mapInArrow(run, "id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    named = [(k, s, sum(sums.values()), digest(c[k])) for k, s in sorted(sums.items())]
    small = df.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Isolation forests: each tree grows from rows of its own, chosen by hash from all rows, where they are gathered; trees are rows of a table."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievefold.functions.scaling import percentiles
from sievefold.sources.store import Scratch

#: Rows are told apart by their hash modulo this prime, and ordered anew for each tree.
PRIME = (1 << 31) - 1
#: Scores are compared to so many digits.
DIGITS = 9
#: So few rows go down all trees at once; for more, a tree at a time stays in the cache.
FEW = 1024
TREES = "forest string, tree int, node long, feature int, threshold double, size long, depth double"


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    inner = np.maximum(n, 3)
    many = 2 * (np.log(inner - 1) + 0.5772156649) - 2 * (inner - 1) / inner
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def digest(*parts: object) -> str:
    """What decides at random: the same in any engine that has MD5."""
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def tree_numbers(trees: int, seed: int) -> list[tuple[int, int]]:
    """(a, b) of each tree; it takes the rows with the least (a * hash + b) modulo ``PRIME``."""
    return [(1 + int(digest(seed, "a", t)[:8], 16) % (PRIME - 1), int(digest(seed, "b", t)[:8], 16) % PRIME) for t in range(trees)]


def row_hash(key: Column, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") % PRIME


def height_of(psi: int) -> int:
    return math.ceil(math.log2(max(psi, 2)))


def grow(x: np.ndarray, forest: str, tree: int, height: int, seed: int) -> list[tuple]:
    """(node, feature, threshold, size, depth) of a tree; node k has children 2k and 2k + 1, a leaf no feature and its rows' mean path as depth."""
    out: list[tuple] = []
    todo = [(1, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        wide = np.flatnonzero(high > low).tolist()
        if level >= height or len(rows) < 2 or not wide:
            out.append((node, None, None, len(rows), level + float(average_path(len(rows)))))
            continue
        f = min(wide, key=lambda k: digest(seed, forest, tree, node, k))
        at = float(low[f] + (high[f] - low[f]) * (int(digest(seed, forest, tree, node)[:13], 16) / 2**52))
        out.append((node, f, at, len(rows), None))
        below = x[rows, f] < at
        todo += [(2 * node, rows[below], level + 1), (2 * node + 1, rows[~below], level + 1)]
    return out


def fit_trees(df: DataFrame, key: str, forests: Mapping[str, Sequence[str]], trees: int = 100, seed: int = 42, psi: int = 256, n: int | None = None) -> DataFrame:
    """The trees of one forest or many, as a table (``TREES``).

    ``forests`` names the columns of each. A tree's rows are the ``psi`` with the least hash of
    their own, of all rows: a narrow pass sends on those under a bound that twice as many are expected to
    meet, keyed by their tree with all columns, and a task grows that tree of every forest. One shuffle
    of 2 * psi * trees rows at most, whatever the input. ``key`` is unique and columns hold no nulls. An
    empty table has no trees; ``n`` is the number of rows if known.
    """
    columns = sorted({c for cs in forests.values() for c in cs})
    n = df.count() if n is None else n
    psi = min(psi, n)
    bound = PRIME if n <= 2 * psi else PRIME * 2 * psi // n
    a, b = (np.array(c, np.int64) for c in zip(*tree_numbers(trees, seed), strict=True))
    kind = df.schema[key].dataType.simpleString()
    inner = df.select(F.col(key).alias("key"), row_hash(F.col(key), seed).alias("h"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = (batch.column("h").to_numpy()[:, None] * a + b) % PRIME
            rows, tree = np.nonzero(u < bound)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(u[rows, tree]), batch.column("key").take(take), batch.column("x").take(take)], names=["tree", "u", "key", "x"])

    places = {name: [columns.index(c) for c in cs] for name, cs in forests.items()}

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values(["u", "key"])["x"].tolist()[:psi])
        rows = [(name, tree, *node) for name, at in places.items() for node in grow(x[:, at], name, tree, height_of(psi), seed)]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in TREES.split(", ")]).astype({"feature": "Int32"})

    return inner.mapInArrow(pick, f"tree int, u long, key {kind}, x array<double>").groupBy("tree").applyInPandas(build, TREES)


@dataclass
class Forest:
    """A forest as tasks hold it: each tree's features (-1 at a leaf), thresholds and depths by node number."""

    feature: np.ndarray
    threshold: np.ndarray
    depth: np.ndarray
    psi: int

    @classmethod
    def of(cls, rows: Sequence[tuple], trees: int, psi: int) -> Forest:
        """From rows (tree, node, feature, threshold, depth). Nodes that no row of the sample reached are empty leaves."""
        size = 2 << height_of(psi)
        feature, threshold = np.full((trees, size), -1), np.zeros((trees, size))
        depth = np.tile(np.floor(np.log2(np.maximum(np.arange(size), 1))), (trees, 1))
        for tree, node, f, at, d in rows:
            if f is None:
                depth[tree, node] = d
            else:
                feature[tree, node], threshold[tree, node] = f, at
        return cls(feature, threshold, depth, psi)

    def _depths(self, x: np.ndarray) -> np.ndarray:
        """Summed over the trees. Rows go down to the last level; below a leaf all nodes have its depth, so no row is left behind."""
        levels, n = height_of(self.psi), len(x)
        columns, rows, total = np.ascontiguousarray(x.T).ravel(), np.arange(n), np.zeros(n)
        if n <= FEW:
            feature, threshold, depth = (a.ravel() for a in self._handed)
            root = np.arange(len(self.feature))[:, None] * self.feature.shape[1]
            node = np.ones((len(self.feature), n), np.intp)
            for _ in range(levels):
                at = root + node
                node = 2 * node + (columns[feature[at] * n + rows] >= threshold[at])
            for found in depth[root + node]:  # in the trees' order, as below
                total += found
            return total
        for feature, threshold, depth in zip(*self._handed, strict=True):
            node = np.ones(n, np.intp)
            for _ in range(levels):
                node = 2 * node + (columns[feature[node] * n + rows] >= threshold[node])
            total += depth[node]
        return total

    @functools.cached_property
    def _handed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._filled()

    def _filled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, thresholds and depths of all trees, leaves' depths handed down to all below them."""
        depth, first = self.depth.copy(), 1
        leaf = self.feature < 0
        while 2 * first < self.depth.shape[1]:
            nodes = np.arange(first, 2 * first)
            for child in (2 * nodes, 2 * nodes + 1):
                depth[:, child] = np.where(leaf[:, nodes], depth[:, nodes], depth[:, child])
                leaf[:, child] |= leaf[:, nodes]
            first *= 2
        return np.where(self.feature < 0, 0, self.feature), np.where(self.feature < 0, np.inf, self.threshold), depth

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Of a forest of one column: where its depth changes, and its depths between."""
        breaks = np.unique(self.threshold[self.feature >= 0])
        return breaks, self._depths(np.r_[-np.inf, breaks][:, None])

    def score(self, x: np.ndarray, steps: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """In (0, 1), higher is more anomalous. With ``steps``, of a forest of one column, a search in place of the trees."""
        total = self._depths(x) if steps is None else steps[1][np.searchsorted(steps[0], x[:, 0], "right")]
        return np.round(2.0 ** (-total / len(self.feature) / max(float(average_path(self.psi)), 1e-12)), DIGITS)


def fit_forests(df: DataFrame, key: str, forests: Mapping[str, Sequence[str]], trees: int = 100, seed: int = 42, psi: int = 256, n: int | None = None) -> dict[str, Forest]:
    """The forests of ``fit_trees``, brought to the driver: trees * 511 rows for each at most. None of an empty table."""
    n = df.count() if n is None else n
    if not n:
        return {}
    rows: dict[str, list[tuple]] = {name: [] for name in forests}
    for r in fit_trees(df, key, forests, trees, seed, psi, n).collect():
        rows[r["forest"]].append((r["tree"], r["node"], r["feature"], r["threshold"], r["depth"]))
    return {name: Forest.of(found, trees, min(psi, n)) for name, found in rows.items()}


def score_forests(df: DataFrame, key: str, columns: Mapping[str, Sequence[str]], forests: Mapping[str, Forest], *keep: str) -> DataFrame:
    """(key, what to keep, score_0, score_1, ...) of each row and each forest, in one narrow pass."""
    needed = sorted({c for cs in columns.values() for c in cs})
    named = {c: f"x{k}" for k, c in enumerate(needed)}
    inner = df.select(F.col(key).alias("key"), F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("_")]).alias("kept"), *[F.col(c).cast("double").alias(x) for c, x in named.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = {name: forests[name].steps() if len(cs) == 1 else None for name, cs in columns.items()}
        for batch in batches:
            if batch.num_rows:
                found = [forests[name].score(np.column_stack([batch.column(named[c]).to_numpy(zero_copy_only=False) for c in cs]), steps[name]) for name, cs in columns.items()]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("kept"), *map(pa.array, found)], names=["key", "kept", *(f"score_{k}" for k in range(len(found)))])

    kinds = ", ".join(f"score_{k} double" for k in range(len(columns)))
    out = inner.mapInArrow(run, f"key {inner.schema['key'].dataType.simpleString()}, kept {inner.schema['kept'].dataType.simpleString()}, {kinds}")
    return out.select(F.col("key").alias(key), *[F.col("kept").getField(c).alias(c) for c in keep], *[f"score_{k}" for k in range(len(columns))])


def fit_score(df: DataFrame, key: str, columns: Sequence[str], contamination: float = 0.05, trees: int = 50, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(key, score, vote); a vote is above the quantile of all rows' scores.

    Scores are written once; the result reads them. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(df.sparkSession)
    model = fit_forests(df, key, {"all": columns}, trees, seed)
    if not model:
        return df.select(key, F.lit(0.0).alias("score"), F.lit(0).alias("vote"))
    scored = scratch.table(score_forests(df, key, {"all": columns}, model), "forest")
    cut = percentiles(scored, ["score_0"], [1 - contamination])[0][0]
    return scored.select(key, F.col("score_0").alias("score"), (F.col("score_0") > cut).cast("int").alias("vote"))

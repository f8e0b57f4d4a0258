"""Connected components of a graph given by edges, by label spreading and shortcuts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.sources.store import Scratch

#: Rounds grow with the logarithm of the longest path; no graph comes near this.
ROUNDS = 200
#: Nodes that a task holds at most while it joins the edges it reads.
HELD = 500_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of one task as edges from each node to the least that they reach."""
    parent: dict = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    def forest(kind: pa.DataType) -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield forest(kind)
    if parent:
        yield forest(kind)


def _settled(e: DataFrame) -> bool:
    """Every node of an edge is a root or has one edge, to a root."""
    ends = e.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return nodes.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0))).isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of an edge that isn't a root itself.

    ``edges`` has a and b of one orderable type. Each task first joins the edges that it reads
    among themselves. Then each round replaces the edges
    by edges to the smallest neighbour, once from larger neighbours and once
    from smaller ones, until each node has one edge to a root. Neighbour minima are partial
    aggregates; they and each round's edges are written to ``scratch``, so that lineage
    stays short and edges meet minima in a join of two exchanges, where the
    edges of a node with very many are dealt over tasks as a skewed key. Edges of a
    node to itself are ignored, nulls must not occur, and no edges give no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        linked = both.join(least, "a")
        if large:
            out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    kind = edges.schema["a"].dataType.simpleString()
    joined = edges.filter(F.col("a") != F.col("b")).select("a", "b").mapInArrow(contract, f"a {kind}, b {kind}")
    e = scratch.table(joined.distinct(), "edges")
    for _ in range(ROUNDS):
        if _settled(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        e = scratch.table(star(star(e, True), False), "edges")
    raise RuntimeError(f"components have not settled after {ROUNDS} rounds")

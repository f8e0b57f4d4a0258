"""Exact nearest neighbours among all rows; blocks that can't hold any are not met.

Of few columns, cells and blocks are boxes of a kd-tree: a sample gives the cells, and
each cell is halved into blocks where it is gathered. A block has few blocks around it, so work and what is sent
grow with the rows.

Of more columns, a few rows serve as pivots. Points go to their nearest pivot's cell and, along
their distance from it, into blocks. A block keeps the least and greatest distance of its
points from every pivot, which by the triangle inequality bound the distances between
two blocks from below, and how far its points must look, from above. Only pairs of
blocks whose bounds allow a neighbour are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievefold.functions.scaling import percentiles
from sievefold.operators.ordered import in_order
from sievefold.operators.rowid import with_row_id
from sievefold.sources.store import Scratch

#: Bounds are widened by this share, far above what doubles lose.
SLACK = 1e-9


@dataclass(frozen=True)
class NearestRules:
    """Points of a block, pivots at most, blocks that a task holds while others pass, others that pass one such group, columns up to which blocks are boxes, and their cells at most. None changes the result."""

    block: int = 512
    pivots: int = 128
    held: int = 32
    passing: int = 128
    boxes: int = 4
    cells: int = 4096


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from pivots without the cancellation of the quick form, since bounds rest on them."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def gaps(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least distances that intervals of distances from the same pivots allow; the last axis is the pivot."""
    return np.maximum(np.maximum(low - other_high, other_low - high), 0).max(-1) * (1 - SLACK)


def box_gaps(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least distances between boxes; the last axis is the column."""
    return np.sqrt((np.maximum(np.maximum(low - other_high, other_low - high), 0) ** 2).sum(-1)) * (1 - SLACK)


@dataclass
class Tree:
    """Splits of a kd-tree in levels: a point below ``at`` in column ``column`` of node k goes to 2k, others to 2k + 1."""

    levels: int
    column: np.ndarray
    at: np.ndarray

    @classmethod
    def grow(cls, x: np.ndarray, levels: int) -> Tree:
        """Each node is halved in its widest column; where rows of the sample agree in all columns, all go one way."""
        column, at = np.zeros(1 << levels, int), np.full(1 << levels, np.inf)
        rows = {1: np.arange(len(x))}
        for node in range(1, 1 << levels):
            own = rows.pop(node)
            below = np.ones(len(own), bool)
            if len(own) and (wide := np.ptp(x[own], axis=0)).max() > 0:
                v = x[own, int(wide.argmax())]
                middle = np.partition(v, len(v) // 2)[len(v) // 2]
                column[node], at[node] = int(wide.argmax()), middle if middle > v.min() else v[v > middle].min()
                below = v < at[node]
            rows[2 * node], rows[2 * node + 1] = own[below], own[~below]
        return cls(levels, column, at)

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), int)
        for _ in range(self.levels):
            node = 2 * node + (x[np.arange(len(x)), self.column[node]] >= self.at[node])
        return node - (1 << self.levels)


def halved(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows of each piece of ``most`` points at most, pieces beside each other next to each other."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        order = rows[np.argpartition(x[rows, int(np.ptp(x[rows], axis=0).argmax())], len(rows) // 2)]
        todo += [order[len(rows) // 2 :], order[: len(rows) // 2]]
    return out


def candidates(x: np.ndarray, y: np.ndarray, k: int, own: bool, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) with all pairs that may be among the k least of a row, distances exact to rounding.

    A row looks no farther than its ``reach``; only one that has none yet seeks its k least here. The quick form of the squares errs by no more than ``slack``; what lies that close to the k-th is measured again.
    """
    found = []
    slack = 8e-16 * (x.shape[1] + 4) * (float((x * x).sum(1).max(initial=0)) + float((y * y).sum(1).max(initial=0)))
    for at in range(0, len(x), 256):
        part = squared(x[at : at + 256], y)
        if own:
            part[np.arange(len(part)), at + np.arange(len(part))] = np.inf
        take = min(k, len(y) - own)
        if take < 1:
            break
        far = reach[at : at + 256]
        limit = np.where(far < 0, -1 - 4 * slack, np.minimum(far, 1e150) ** 2 * (1 + SLACK))
        if len(free := np.flatnonzero(np.isinf(far))):
            limit[free] = np.partition(part[free], take - 1, axis=1)[:, take - 1]
        rows, cols = np.nonzero(part <= np.where(np.isfinite(limit), limit, -1)[:, None] + 2 * slack)
        for i in range(0, len(rows), 1 << 16):
            a, b = rows[i : i + (1 << 16)] + at, cols[i : i + (1 << 16)]
            found.append((a, b, np.sqrt(((x[a] - y[b]) ** 2).sum(1))))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Found:
    """The k nearest rows of each point so far: by distance, then key. A point stands for ``copies`` rows of its own, which need not be found."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, k: int):
        self.x, self.k = x, k
        self.missing = np.maximum(k - (copies - 1), 0)
        self.reach = np.where(self.missing > 0, np.inf, -1.0)
        self.copies = np.minimum(copies - 1, k)
        self.point, self.distance, self.key, self.value = np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0)

    def meet(self, points: np.ndarray, y: np.ndarray, keys: np.ndarray, first: np.ndarray, own: bool, values: np.ndarray | None = None) -> None:
        """Meets the rows of y, of which row j stands for the keys from first[j] to first[j + 1] and has a value, with some of the points."""
        a, b, d = candidates(self.x[points], y, self.k, own, self.reach[points])
        if not len(a):
            return
        times = first[b + 1] - first[b]
        at = np.repeat(first[b], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        touched = np.zeros(len(self.x), bool)
        touched[points[a]] = True
        old = touched[self.point]
        point = np.r_[self.point[old], np.repeat(points[a], times)]
        distance = np.r_[self.distance[old], np.repeat(d, times)]
        key = np.concatenate([self.key[old], keys[at]]) if len(self.key) else keys[at]
        value = np.r_[self.value[old], np.zeros(len(at)) if values is None else np.repeat(values[b], times)]
        order = np.lexsort((key, distance, point))
        start = np.searchsorted(point[order], np.arange(len(self.x)))
        rank = np.arange(len(order)) - start[point[order]]
        kept = order[rank < self.missing[point[order]]]
        whole = np.r_[self.point[~old], point[kept]]
        by = np.argsort(whole, kind="stable")  # two runs in order
        self.point, self.distance, self.value = whole[by], np.r_[self.distance[~old], distance[kept]][by], np.r_[self.value[~old], value[kept]][by]
        self.key = np.concatenate([self.key[~old], key[kept]])[by] if len(self.key) else key[kept][by]
        count = np.bincount(self.point, minlength=len(self.x))
        full = (count == self.missing) & (self.missing > 0)
        self.reach[full] = self.distance[np.cumsum(count)[full] - 1]

    def _first(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Among the k nearest rows of each point: how many are copies of it, how many there are, where the others start, and which of those count."""
        copies, count = np.minimum(self.copies, k), np.bincount(self.point, minlength=len(self.x))
        start = np.cumsum(count) - count
        used = np.arange(len(self.point)) - start[self.point] < (k - copies)[self.point]
        return copies, np.minimum(copies + count, k), start, used

    def distance_to(self, k: int, rank: np.ndarray | int | None = None) -> np.ndarray:
        """To the row of a rank from 0 among the k nearest, by default the last; 0 if there are none."""
        copies, n, start, _ = self._first(k)
        rank = np.broadcast_to(n - 1 if rank is None else rank, n.shape)
        out, there = np.zeros(len(n)), (rank >= copies) & (rank < n) & (rank >= 0)
        out[there] = self.distance[(start + rank - copies)[there]]
        return out

    def averages(self, k: int, own: np.ndarray, floor: bool) -> np.ndarray:
        """Means over the k nearest rows of their values, or of the greater of value and distance; a copy's value is the point's ``own``. 0 over none."""
        copies, n, _, used = self._first(k)
        each = np.maximum(self.distance, self.value) if floor else self.value
        total = copies * own + np.bincount(self.point[used], each[used], len(self.x))
        return total / np.maximum(n, 1)


def _numpy(keys: pa.Array) -> np.ndarray:
    return np.array(keys.to_pylist(), object) if pa.types.is_string(keys.type) else keys.to_numpy(zero_copy_only=False)


@dataclass
class Block:
    """A block as tasks read it from a batch."""

    x: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    values: np.ndarray | None

    @classmethod
    def read(cls, batch: pa.RecordBatch, k: int, width: int) -> Block:
        keys = batch.column("keys")[k].values
        values = batch.column("value")[k].values.to_numpy() if "value" in batch.schema.names else None
        return cls(batch.column("points")[k].values.to_numpy().reshape(-1, width), _numpy(keys.flatten()), np.r_[0, np.cumsum(keys.value_lengths().to_numpy())].astype(int), values)


class Neighbours:
    """The k nearest other rows of each row, and how much of the work bounds have saved."""

    def __init__(self, df: DataFrame, key: str, columns: Sequence[str], k: int, rules: NearestRules = NearestRules(), scratch: Scratch | None = None):
        self.df, self.key, self.width, self.k, self.rules = df, key, len(columns), k, rules
        self.scratch = scratch or Scratch(df.sparkSession)
        self.kind = df.schema[key].dataType.simpleString()
        self.rows = df.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
        self.dealt = None
        self.points = self.scratch.table(self._points(), "points")
        self.n_points = self.points.count()
        self.boxed = self.width <= rules.boxes
        self.pivots = None if self.boxed else self._pivots()
        self.gaps = box_gaps if self.boxed else gaps
        self.blocks = self.scratch.table(self._boxes() if self.boxed else self._blocks(), "blocks")
        self.pairs = self.scratch.table(self._pairs(), "pairs")

    def share_met(self) -> float:
        """The pairs of blocks that were met, of all."""
        blocks = self.blocks.count()
        return self.pairs.count() / max(1, blocks * blocks)

    def _points(self) -> DataFrame:
        """(x, keys): distinct points with the least k + 1 of their keys, which is all that a row can need of them."""
        first = self.rows.withColumn("m", F.row_number().over(Window.partitionBy("x").orderBy("key"))).filter(F.col("m") <= self.k + 1)
        return first.groupBy("x").agg(F.sort_array(F.collect_list("key")).alias("keys"))

    def _pivots(self) -> np.ndarray:
        """A bounded sample, by hash."""
        n = max(1, min(self.rules.pivots, self.n_points // self.rules.block))
        found = self.points.orderBy(F.xxhash64("x"), "x").limit(n).select("x").collect()
        return np.array([r["x"] for r in found], float).reshape(-1, self.width)

    def _tree(self) -> Tree:
        """From a bounded sample, by hash."""
        cells = min(self.rules.cells, self.n_points // (8 * self.rules.block) + 1)
        share = min(1.0, 16 * cells / max(1, self.n_points))
        x = self.points.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("x").toArrow().column("x")
        return Tree.grow(x.combine_chunks().flatten().to_numpy().reshape(-1, self.width), (cells - 1).bit_length())

    def _boxes(self) -> DataFrame:
        """(b, cell, points, keys, low, high, top): as ``_blocks``, with low and high in each column."""
        tree, k, width, block = self._tree(), self.k, self.width, self.rules.block

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = tree.cells(batch.column("x").flatten().to_numpy().reshape(-1, width))
                    yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("keys"), pa.array(cell.astype(np.int32))], names=["x", "keys", "cell"])

        def cut(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            x, cell = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width), table.column("cell")[0].as_py()
            all_keys, parts = table.column("keys").combine_chunks(), halved(x, block)
            keys, low, high, top = [], [], [], []
            for rows in parts:
                own, lists = x[rows], all_keys.take(pa.array(rows))
                first = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(int)
                found = Found(own, np.diff(first), k)
                found.meet(np.arange(len(own)), own, _numpy(lists.flatten()), first, True)
                keys.append(lists)
                low.append(own.min(0))
                high.append(own.max(0))
                top.append(float(found.reach.max()))
            ends = pa.array(np.r_[0, np.cumsum([len(rows) for rows in parts])].astype(np.int32))
            points = [pa.array(x[rows].ravel()) for rows in parts]
            numbers = [pa.array([(cell << 20) + i for i in range(len(parts))], pa.int64()), pa.array([cell] * len(parts), pa.int32())]
            lists = [pa.array(points, pa.list_(pa.float64())), pa.ListArray.from_arrays(ends, pa.concat_arrays(keys)), pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64()))]
            return pa.table([*numbers, *lists, pa.array(top, pa.float64())], names=["b", "cell", "points", "keys", "low", "high", "top"])

        placed = self.points.mapInArrow(place, f"x array<double>, keys array<{self.kind}>, cell int")
        return placed.groupBy("cell").applyInArrow(cut, f"b long, cell int, points array<double>, keys array<array<{self.kind}>>, low array<double>, high array<double>, top double")

    def _blocks(self) -> DataFrame:
        """(b, cell, points, keys, low, high, top): points of a block, their keys, their least and greatest distance from
        each pivot, and the greatest distance that one of them must look."""
        pivots, k, width = self.pivots, self.k, self.width

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = squared(batch.column("x").flatten().to_numpy().reshape(-1, width), pivots)
                    cell = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("keys"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["x", "keys", "cell", "d"])

        placed = self.points.mapInArrow(place, f"x array<double>, keys array<{self.kind}>, cell int, d double").withColumn("spread", F.xxhash64("x"))
        ordered = in_order(placed, ["cell", "d", "spread"], self.scratch)
        # cells lie in ranges in order, so there are no more stretches than ranges and cells together
        stretches = ordered.groupBy("_part", "cell").agg(F.min("_place").alias("start"), F.count("*").alias("n"))
        pieces = F.greatest(F.lit(1), F.floor(F.col("n") / self.rules.block))  # of one to two times ``block`` points
        number = F.shiftleft("_part", 32) + F.shiftleft(F.col("cell").cast("long"), 20) + F.floor((F.col("_place") - F.col("start")) * pieces / F.col("n"))
        grouped = ordered.join(F.broadcast(stretches), ["_part", "cell"]).groupBy(number.alias("b"), "cell").agg(F.collect_list(F.struct("x", "keys")).alias("rows"))
        flat = grouped.select("b", "cell", F.flatten("rows.x").alias("points"), F.col("rows.keys").alias("keys"))

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low, high, top = [], [], []
                for i in range(batch.num_rows):
                    block = Block.read(batch, i, width)
                    found = Found(block.x, np.diff(block.first), k)
                    found.meet(np.arange(len(block.x)), block.x, block.keys, block.first, True)
                    d = apart(block.x, pivots)
                    low.append(d.min(0))
                    high.append(d.max(0))
                    top.append(float(found.reach.max()))
                if low:
                    arrays = [pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64())), pa.array(top, pa.float64())]
                    yield pa.RecordBatch.from_arrays([*map(batch.column, ("b", "cell", "points", "keys")), *arrays], names=["b", "cell", "points", "keys", "low", "high", "top"])

        return flat.mapInArrow(bounds, f"b long, cell int, points array<double>, keys array<array<{self.kind}>>, low array<double>, high array<double>, top double")

    def _pairs(self) -> DataFrame:
        """(a, b, gap): blocks that may hold neighbours of a block's points. Pairs of cells, of which
        there are ``pivots`` squared at most, are sifted first; only blocks of cells that are left meet."""
        if self.boxed:
            return self._pairs_of_boxes()
        spark, n = self.df.sparkSession, len(self.pivots)
        ends = self.blocks.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("p", "e")).groupBy("cell", "p").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high"))
        low, high, top = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.full(n, -1.0)
        for r in ends.collect():  # pivots squared
            low[r["cell"], r["p"]], high[r["cell"], r["p"]] = r["low"], r["high"]
        for r in self.blocks.groupBy("cell").agg(F.max("top").alias("top")).collect():
            top[r["cell"]] = r["top"]
        there = np.flatnonzero(np.isfinite(low).any(1)).tolist()
        near = [(a, b) for a in there for b in there if gaps(low[a], high[a], low[b], high[b]) <= top[a]]
        cells = F.broadcast(spark.createDataFrame(near, "ca int, cb int"))
        side = lambda own, *more: self.blocks.select(F.col("b").alias(own), F.col("cell").alias(f"c{own}"), F.col("low").alias(f"low_{own}"), F.col("high").alias(f"high_{own}"), *more)
        met = side("a", "top").join(cells, "ca").join(side("b"), "cb")
        over = lambda x, y: F.array_max(F.zip_with(x, y, lambda p, q: p - q))
        gap = F.greatest(over("low_a", "high_b"), over("low_b", "high_a"), F.lit(0.0)) * (1 - SLACK)
        return met.withColumn("gap", gap).filter(F.col("gap") <= F.col("top")).select("a", "b", "gap")

    def _pairs_of_boxes(self) -> DataFrame:
        """(a, b, gap): each block finds the cells it may look into, of which there are ``cells`` at most, then their blocks."""
        n = int(self.blocks.agg(F.coalesce(F.max("cell"), F.lit(0))).first()[0]) + 1
        low, high = np.full((n, self.width), np.inf), np.full((n, self.width), -np.inf)
        for r in self.blocks.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("p", "e")).groupBy("cell", "p").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high")).collect():
            low[r["cell"], r["p"]], high[r["cell"], r["p"]] = r["low"], r["high"]

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    near = np.flatnonzero(box_gaps(batch.column("low")[i].values.to_numpy(), batch.column("high")[i].values.to_numpy(), low, high) <= batch.column("top")[i].as_py())
                    if len(near):
                        same = pa.array(np.full(len(near), i))
                        yield pa.RecordBatch.from_arrays([*(c.take(same) for c in batch.columns), pa.array(near.astype(np.int32))], names=["a", "low", "high", "top", "cell"])

        looking = self.blocks.select(F.col("b").alias("a"), "low", "high", "top").mapInArrow(look, "a long, low array<double>, high array<double>, top double, cell int")
        met = looking.join(self.blocks.select("b", "cell", F.col("low").alias("low_b"), F.col("high").alias("high_b")), "cell")
        sides = [F.greatest(F.get("low", F.lit(c)) - F.get("high_b", F.lit(c)), F.get("low_b", F.lit(c)) - F.get("high", F.lit(c)), F.lit(0.0)) for c in range(self.width)]
        gap = F.sqrt(sum((v * v for v in sides[1:]), sides[0] * sides[0])) * (1 - SLACK)
        return met.withColumn("gap", gap).filter(F.col("gap") <= F.col("top")).select("a", "b", "gap")

    def _deal(self) -> tuple[DataFrame, DataFrame, int, int]:
        """(a, g) of each block and its group, (g, b, users, gap, chunk) of each block that passes a group, and the numbers of chunks and tasks."""
        if self.dealt:
            return self.dealt
        spark = self.df.sparkSession
        # blocks that follow each other are held together, so a block that several of them need is sent once
        places = with_row_id(self.blocks.select(F.col("b").alias("a")), ["a"], "place", self.scratch)
        groups = self.scratch.table(places.select("a", F.floor(F.col("place") / self.rules.held).cast("long").alias("g")), "groups")
        passing = self.pairs.join(groups, "a").groupBy("g", "b").agg(F.collect_list("a").alias("users"), F.min("gap").alias("gap"))
        passing = self.scratch.table(passing, "passing")
        n_passing, n_groups = passing.count(), max(1, -(-self.blocks.count() // self.rules.held))
        chunks = 1 if self.boxed else max(1, -(-n_passing // (self.rules.passing * n_groups)))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_groups * chunks)
        self.dealt = groups, passing.withColumn("chunk", F.pmod(F.xxhash64("b"), F.lit(chunks)).cast("int")), chunks, parts
        return self.dealt

    def _met(self, blocks: DataFrame, more: Sequence[str], out: Callable[[Block, Found, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
        """What ``out`` makes of each held block, its neighbours and its row, once the blocks that may hold some have passed it."""
        width, pivots, k, boxed, apart_by = self.width, self.pivots, self.k, self.boxed, self.gaps
        groups, dealt, chunks, parts = self._deal()
        held = ["points", "keys", "low", "high", *more]
        alone = F.array().cast("array<bigint>").alias("users")
        own = dealt.select("g", "chunk").distinct().join(groups.withColumnRenamed("a", "b"), "g").join(blocks, "b").select("g", "chunk", "b", alone, F.lit(-1.0).alias("gap"), *held)
        others = dealt.join(blocks, "b").select("g", "chunk", "b", "users", "gap", *held)
        # a task of its own for each group and chunk, so that no batch holds the blocks of several
        task = F.pmod(F.col("g") * chunks + F.col("chunk"), F.lit(parts)).cast("int")
        stream = own.unionAll(others).repartitionById(parts, task).sortWithinPartitions("g", "chunk", "gap")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None
            mine: dict[int, tuple[Block, Found, np.ndarray, pa.RecordBatch]] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    if now != (now := (batch.column("g")[i].as_py(), batch.column("chunk")[i].as_py())):
                        yield from (out(block, found, row) for block, found, _, row in mine.values())
                        mine = {}
                    number, met = batch.column("b")[i].as_py(), Block.read(batch, i, width)
                    if batch.column("gap")[i].as_py() < 0:
                        found = Found(met.x, np.diff(met.first), k)
                        if boxed:  # reaches are short before others pass; elsewhere several tasks hold the block, and one meets it with itself
                            found.meet(np.arange(len(met.x)), met.x, met.keys, met.first, True, met.values)
                        mine[number] = met, found, met.x if boxed else apart(met.x, pivots), batch.slice(i, 1)
                        continue
                    low, high = (batch.column(c)[i].values.to_numpy() for c in ("low", "high"))
                    for a in batch.column("users")[i].as_py():
                        if boxed and a == number:
                            continue
                        _, found, at, _ = mine[a]
                        near = np.ones(len(found.x), bool) if a == number else (apart_by(at, at, low, high) <= found.reach)
                        if len(points := np.flatnonzero(near)):
                            found.meet(points, met.x, met.keys, met.first, a == number, met.values)
            yield from (out(block, found, row) for block, found, _, row in mine.values())

        return stream.mapInArrow(run, schema)

    def nearest(self) -> DataFrame:
        """(key, near): the k nearest other rows of each row as (distance, key), nearest first, equally near ones by key."""
        k = self.k

        def out(block: Block, found: Found, row: pa.RecordBatch) -> pa.RecordBatch:
            kind = row.schema.field("keys").type.value_type.value_type
            key, lists = pa.array(block.keys[block.first[:-1]], kind), np.r_[0, np.cumsum(np.bincount(found.point, minlength=len(found.x)))].astype(np.int32)
            near = pa.StructArray.from_arrays([pa.array(found.distance), pa.array(found.key if len(found.key) else [], kind)], names=["distance", "key"])
            return pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(lists), near)], names=["key", "near"])

        near_type = f"array<struct<distance:double,key:{self.kind}>>"
        met = self._met(self.blocks, (), out, f"key {self.kind}, near {near_type}")
        of_point = met.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        named = self.points.select(F.xxhash64("x").alias("h"), "x", "keys", F.col("keys")[0].alias("first"))
        found = self.scratch.table(named.join(of_point.withColumnRenamed("key", "first"), "first", "left").select("h", "x", "keys", "near"), "found")
        copies = lambda own: F.transform(F.filter("keys", lambda c: c != own), lambda c: F.struct(F.lit(0.0).alias("distance"), c.alias("key")))
        every = F.concat(copies(F.col("key")), F.coalesce("near", F.array().cast(near_type)))
        whole = self.rows.withColumn("h", F.xxhash64("x")).join(found, ["h", "x"])
        return whole.select(F.col("key").alias(self.key), F.slice(F.array_sort(every), 1, k).alias("near"))

    def scores(self, lof_k: int | None, knn_k: int | None) -> DataFrame:
        """(key, lof, knn, others) of each row, where blocks are boxes. Blocks pass three times, with nothing,
        with the distance to each point's k-th neighbour and with its density, and the neighbours are found again each time, so lists of
        neighbours are never sent. All copies of a point have the same values."""
        width, radius_k = self.width, lof_k or self.k

        def blocks(row: pa.RecordBatch, *new: np.ndarray) -> pa.RecordBatch:
            names = ["b", "points", "keys", "low", "high"]
            more = ["knn", "others"] if "knn" in row.schema.names else []
            kept = [row.column(c) for c in (*names, *more)]
            fresh = ["value"] if more else ["value", "knn", "others"]
            return pa.RecordBatch.from_arrays([*kept, *(pa.array([v], pa.list_(pa.float64())) for v in new)], names=[*names, *more, *fresh])

        def radii(block: Block, found: Found, row: pa.RecordBatch) -> pa.RecordBatch:
            if not knn_k:
                return blocks(row, found.distance_to(radius_k), np.zeros(0), np.zeros(0))
            _, n, *_ = found._first(knn_k)
            far = found.distance_to(knn_k)
            return blocks(row, found.distance_to(radius_k), np.where(n < knn_k, far, found.distance_to(knn_k, knn_k - 2)), far)

        def densities(block: Block, found: Found, row: pa.RecordBatch) -> pa.RecordBatch:
            return blocks(row, 1 / (found.averages(lof_k, block.values, True) + 1e-10))

        def factors(block: Block, found: Found, row: pa.RecordBatch) -> pa.RecordBatch:
            none = found._first(lof_k)[1] == 0
            return blocks(row, np.where(none, 1.0, found.averages(lof_k, block.values, False) / block.values))

        def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    flat = batch.column("points")[i].values
                    n = len(flat) // width
                    lists = [batch.column(c)[i].values if len(batch.column(c)[i].values) == n else pa.nulls(n, pa.float64()) for c in ("value", "knn", "others")]
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat), *lists], names=["x", "lof", "knn", "others"])

        doubles = "array<double>"
        frame = f"b long, points {doubles}, keys array<array<{self.kind}>>, low {doubles}, high {doubles}, "
        first = self.scratch.table(self._met(self.blocks, (), radii, f"{frame}value {doubles}, knn {doubles}, others {doubles}"), "radii")
        last = first
        for out in (densities, factors) if lof_k else ():
            last = self.scratch.table(self._met(last, ("value", "knn", "others"), out, f"{frame}knn {doubles}, others {doubles}, value {doubles}"), "passed")
        found = last.select("points", "value", "knn", "others").mapInArrow(points, "x array<double>, lof double, knn double, others double")
        whole = self.rows.withColumn("h", F.xxhash64("x")).join(found.withColumn("h", F.xxhash64("x")), ["h", "x"])
        return self.scratch.table(whole.select(F.col("key").alias(self.key), "lof", "knn", "others"), "scores")


def nearest(df: DataFrame, key: str, columns: Sequence[str], k: int, rules: NearestRules = NearestRules(), scratch: Scratch | None = None) -> DataFrame:
    """(key, near) of each row: its k nearest other rows, all if fewer, as (distance, key).

    Exact, among all rows, in Euclidean distance; ``key`` is unique and columns hold no nulls or NaN. Rows at one point
    are one point with a few keys, so copies, however many, cost nothing and form no group. Each pair of
    blocks that bounds don't rule out is compared once, nearest first. A task holds ``held`` blocks while others pass, so where
    nothing is ruled out each block is sent once for every ``held`` blocks; it sends neighbours once it has met them. An empty table gives an empty result. The result reads tables in ``scratch``.
    """
    return Neighbours(df, key, columns, k, rules, scratch).nearest()


def knn(df: DataFrame, key: str, columns: Sequence[str], k: int = 15, contamination: float = 0.05, rules: NearestRules = NearestRules(), scratch: Scratch | None = None) -> DataFrame:
    """(key, score, vote). The score is the distance to the k-th nearest row, the row itself among them; a vote is above
    the quantile of the distances to the k-th nearest other row. With fewer rows the farthest counts, and a row alone scores 0.
    """
    scratch = scratch or Scratch(df.sparkSession)
    if len(columns) <= rules.boxes:
        return lof_and_knn(df, key, columns, None, k, contamination, rules, scratch)[1]
    far = F.coalesce(F.try_element_at("near.distance", F.lit(-1)), F.lit(0.0))
    score = F.when(F.size("near") < k, far).otherwise(F.coalesce(F.get("near.distance", F.lit(k - 2)), F.lit(0.0)))
    each = scratch.table(nearest(df, key, columns, k, rules, scratch).select(key, score.alias("score"), far.alias("others")), "knn")
    cut = percentiles(each, ["others"], [1 - contamination])[0][0]
    return each.select(key, "score", (F.col("score") > F.lit(cut).cast("double")).cast("int").alias("vote"))


def lof_and_knn(df: DataFrame, key: str, columns: Sequence[str], lof_k: int | None = 20, knn_k: int | None = 15, contamination: float = 0.05, rules: NearestRules = NearestRules(), scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``lof`` and ``knn`` give, from one search, of ``rules.boxes`` columns at most."""
    found = Neighbours(df, key, columns, max(lof_k or 0, knn_k or 0), rules, scratch).scores(lof_k, knn_k)
    cuts = [c[0] for c in percentiles(found, ["lof", "others"], [1 - contamination])]
    return tuple(found.select(key, F.col(c).alias("score"), (F.col(c) > F.lit(cut).cast("double")).cast("int").alias("vote")) for c, cut in zip(("lof", "knn"), cuts, strict=True))


def lof(df: DataFrame, key: str, columns: Sequence[str], k: int = 20, contamination: float = 0.05, rules: NearestRules = NearestRules(), scratch: Scratch | None = None) -> DataFrame:
    """(key, score, vote): how much denser a row's k nearest other rows lie than itself; a vote is above the scores' quantile.

    The graph of neighbours is written once. A join with each neighbour's k-th distance gives
    reach distances and densities, a second with densities the factor. Neighbours that very many rows share
    (the least keys among copies) are keys that Spark deals over tasks: both sides of a join are tables.
    A row alone has factor 1. Of few columns, ``Neighbours.scores`` sends no graph.
    """
    scratch = scratch or Scratch(df.sparkSession)
    if len(columns) <= rules.boxes:
        return lof_and_knn(df, key, columns, k, None, contamination, rules, scratch)[0]
    graph = scratch.table(nearest(df, key, columns, k, rules, scratch).withColumnRenamed(key, "key"), "graph")
    edges = graph.select("key", F.explode("near").alias("e")).select("key", F.col("e.distance").alias("distance"), F.col("e.key").alias("to"))
    radius = graph.select(F.col("key").alias("to"), F.try_element_at("near.distance", F.lit(-1)).alias("radius"))
    density = edges.join(radius, "to").groupBy("key").agg((1 / (F.avg(F.greatest("distance", "radius")) + 1e-10)).alias("density"))
    density = scratch.table(density, "density")
    around = scratch.table(edges.join(density.withColumnRenamed("key", "to"), "to").groupBy("key").agg(F.avg("density").alias("around")), "around")
    scored = graph.select("key").join(density, "key", "left").join(around, "key", "left")
    scored = scratch.table(scored.select(F.col("key").alias(key), F.coalesce(F.col("around") / F.col("density"), F.lit(1.0)).alias("score")), "lof")
    cut = percentiles(scored, ["score"], [1 - contamination])[0][0]
    return scored.withColumn("vote", (F.col("score") > F.lit(cut).cast("double")).cast("int"))

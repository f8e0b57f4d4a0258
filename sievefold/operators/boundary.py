"""A kernel boundary (one-class support vectors) fitted to all rows.

The kernel exp(-gamma |x - y|^2) is taken through landmarks: points of the table, added until for every row
what they leave of the kernel is at most ``TOLERANCE``, which bounds the error of the kernel between any two rows. Rows
are then short vectors, and the fit is

    least |w|^2 / 2 - rho + sum of max(0, rho - w.x) / (nu n) over all n rows.

Rows on one side of the boundary enter only by their sum, so only rows near it need to be held one by one. A round
sums the others up, holds the near ones and solves that exactly by an interior point method. Its optimum bounds the whole
table's from below, and the sum over all rows at its solution bounds it from above; the fit ends when both meet within ``GAP``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.sources.store import Scratch

#: What landmarks may leave of the kernel of any row with itself.
TOLERANCE = 1e-8
#: Between the bounds of the optimum; scores are then within sqrt(2 * GAP) of the exact ones, and in practice far nearer.
GAP = 1e-9
#: Scores are compared to so many digits, so that rows on the boundary, which all score alike, do so in doubles too.
DIGITS = 7
#: Landmarks that a task sends in one pass at most; further passes send the rest.
SENT = 256
#: Numbers of a block of rows by landmarks in a task, and of all held rows by landmarks in the driver.
BLOCK, ENTRIES = 1 << 20, 1 << 22
#: Bounds of distances from the boundary by which rows are counted: 1 and down by the root of 2.
MARKS = 2.0 ** (-np.arange(80) / 2)
#: Shares of the way to a round's solution that are tried, all in the pass that measures it.
PARTS = 2.0 ** -np.arange(12)
#: A band has so many times fewer rows than the one before, until its rows are held one by one.
NARROWER = 8
#: Rounds after which a fit that has not ended raises.
MOST = 100


@dataclass
class Landmarks:
    """Points by which the kernel is taken, and the inverse of its triangular root on them."""

    points: np.ndarray
    gamma: float
    inverse: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def kernel(self, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        """By differences, since far rows lose digits in the quick form."""
        y, d = self.points if y is None else y, 0.0
        for a, b in zip(x.T, y.T, strict=True):
            d = d + (a[:, None] - b[None, :]) ** 2
        return np.exp(-self.gamma * d)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Short vectors whose products are the kernel."""
        return self.kernel(x) @ self.inverse.T

    def blocks(self, x: np.ndarray) -> Iterator[slice]:
        size = max(1, BLOCK // max(64, len(self.points)))
        return (slice(at, at + size) for at in range(0, len(x), size))

    def extend(self, x: np.ndarray, tolerance: float, most: int | None = None) -> np.ndarray:
        """Takes the row of which most is left until no more than ``tolerance`` is left of any; returns what was added."""
        r = first = len(self.points)
        features = self.features(x)
        left = 1 - (features**2).sum(1)
        end = r + (len(x) if most is None else min(most, len(x)))
        while r < end:
            j = int(np.argmax(left))
            if not left[j] > tolerance:
                break
            if r == features.shape[1]:
                features = np.concatenate([features, np.zeros((len(x), max(16, r - first)))], 1)
                grown = np.zeros((features.shape[1],) * 2)
                grown[:r, :r] = self.inverse[:r, :r]
                self.inverse, self.points = grown, np.concatenate([self.points[:r], np.zeros((len(grown) - r, x.shape[1]))])
            root, own = np.sqrt(left[j]), features[j, :r].copy()
            self.inverse[r, :r], self.inverse[r, r], self.points[r] = -(own @ self.inverse[:r, :r]) / root, 1 / root, x[j]
            features[:, r] = (self.kernel(x, x[j : j + 1])[:, 0] - features[:, :r] @ own) / root
            left -= features[:, r] ** 2
            left[j], r = 0.0, r + 1
        self.points, self.inverse = self.points[:r].copy(), self.inverse[:r, :r].copy()
        return self.points[first:]

    def copy(self) -> Landmarks:
        return Landmarks(self.points.copy(), self.gamma, self.inverse.copy())


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:width]])


def landmarks(points: DataFrame, columns: Sequence[str], gamma: float, tolerance: float = TOLERANCE) -> Landmarks:
    """Landmarks of all rows: tasks add what theirs lack and send it, until no task lacks any."""
    k, found = len(columns), Landmarks(np.zeros((0, len(columns))), gamma)

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = found.copy(), len(found.points)
        for batch in batches:
            x = _matrix(batch, k) if batch.num_rows else np.zeros((0, k))
            for part in own.blocks(x):
                if len(own.points) < first + SENT:
                    own.extend(x[part], tolerance, first + SENT - len(own.points))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in own.points[first:].T], names=list(columns))

    while True:
        sent = points.select(*columns).mapInArrow(lacking, ", ".join(f"{c} double" for c in columns)).toArrow()
        if not sent.num_rows:
            return found
        x = np.column_stack([c.to_numpy() for c in sent.columns])
        for part in list(found.blocks(x)):
            found.extend(x[part], tolerance)


# the exact fit of held rows -------------------------------------------------------


def interior(x: np.ndarray, top: np.ndarray, pull: np.ndarray, total: float, tolerance: float = 1e-12, most: int = 100) -> tuple[np.ndarray, float]:
    """(w, rho) of the least |w|^2 / 2 with w = x'a + ``pull``, 0 <= a <= ``top`` and the sum of a ``total``.

    Predictor and corrector steps; each solves a system as wide as x. They end at ``tolerance``, or where doubles allow no further step.
    """
    if total >= top.sum() * (1 - 1e-12):
        w = x.T @ top + pull
        return w, float((x @ w).max())
    a = top * (total / top.sum())
    f = x @ (x.T @ a + pull)
    rho = float(np.average(f, weights=top))
    start = max(float(np.abs(f - rho).mean()), 1e-3)
    z, u = np.maximum(f - rho, 0) + start, np.maximum(rho - f, 0) + start
    for _ in range(most):
        e, off = top - a, x @ (x.T @ a + pull) - rho - z + u
        mean = (z @ a + u @ e) / (2 * len(a))
        if 2 * len(a) * mean <= tolerance and np.abs(off).max() <= 1e-10:
            break
        d = z / a + u / e
        scaled = x / d[:, None]
        try:
            root = np.linalg.inv(np.linalg.cholesky(np.eye(x.shape[1]) + x.T @ scaled))
        except np.linalg.LinAlgError:
            break
        solve = lambda y: y / d - scaled @ (root.T @ (root @ (scaled.T @ y)))  # noqa: E731, B023
        one = solve(np.ones(len(a)))

        def step(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
            y = solve(low / a - high / e - off)  # noqa: B023
            level = (total - a.sum() - y.sum()) / one.sum()  # noqa: B023
            da = y + level * one  # noqa: B023
            return da, level, (low - z * da) / a, (high + u * da) / e  # noqa: B023

        def length(da: np.ndarray, dz: np.ndarray, du: np.ndarray) -> float:
            return 1 / max(1.0, *(float(np.max(-v / at)) for v, at in ((da, a), (-da, e), (dz, z), (du, u))))  # noqa: B023

        da, level, dz, du = step(-z * a, -u * e)
        go = length(da, dz, du)
        aim = mean * (((z + go * dz) @ (a + go * da) + (u + go * du) @ (e - go * da)) / (2 * len(a) * mean)) ** 3
        da, level, dz, du = step(aim - z * a - dz * da, aim - u * e + du * da)
        go = 0.995 * length(da, dz, du)
        if not go > 1e-9:
            break
        a, rho, z, u = a + go * da, rho + go * level, z + go * dz, u + go * du
    return x.T @ (a * (total / a.sum())) + pull, rho


# rounds over all rows -----------------------------------------------------------


@dataclass
class Boundary:
    """Where the boundary lies; ``gaps`` are the distances between the bounds after each round that held rows one by one."""

    landmarks: Landmarks
    w: np.ndarray
    rho: float
    gaps: list[float] = field(default_factory=list)

    def toward(self, other: Boundary, part: float) -> Boundary:
        return Boundary(self.landmarks, self.w + part * (other.w - self.w), self.rho + part * (other.rho - self.rho), self.gaps)

    def values(self, x: np.ndarray, *others: Boundary) -> np.ndarray:
        """w.x of each row; with others, a column for each."""
        beta = np.column_stack([b.landmarks.inverse.T @ b.w for b in (self, *others)])
        out = [self.landmarks.kernel(x[part]) @ beta for part in self.landmarks.blocks(x)]
        out = np.concatenate(out) if out else np.zeros((0, 1 + len(others)))
        return out if others else out[:, 0]


@dataclass
class Measured:
    """Of all rows: the sums of what lies below the boundary after each part of the way from the former, how far it moved at most, and rows and weights by mark on both sides."""

    below: np.ndarray = field(default_factory=lambda: np.zeros(len(PARTS)))
    moved: float = 0.0
    rows: np.ndarray = field(default_factory=lambda: np.zeros((2, len(MARKS) + 1)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((2, len(MARKS) + 1)))

    def add(self, x: np.ndarray, weight: np.ndarray, now: Boundary, former: Boundary) -> None:
        t = now.values(x, former)
        under, before = now.rho - t[:, 0], former.rho - t[:, 1]
        self.below += [float(weight @ np.maximum(before + part * (under - before), 0)) for part in PARTS]
        self.moved = max(self.moved, float(np.abs(under - before).max()))
        mark = np.searchsorted(-MARKS, -np.abs(under), "right")  # so many marks are no less
        for side in (0, 1):
            at = (under > 0) == bool(side)
            self.rows[side] += np.bincount(mark[at], minlength=len(MARKS) + 1)
            self.weights[side] += np.bincount(mark[at], weight[at], len(MARKS) + 1)

    def numbers(self) -> list[float]:
        return [self.moved, *self.below, *self.rows.ravel(), *self.weights.ravel()]

    @classmethod
    def joined(cls, parts: np.ndarray) -> Measured:
        """Of the numbers of all tasks."""
        sums = parts[:, 1:].sum(0)
        return cls(sums[: len(PARTS)], float(parts[:, 0].max()), *sums[len(PARTS) :].reshape(2, 2, -1))

    def within(self, most: float, share: float) -> float:
        """The widest mark with at most so many rows within it, but wide enough for the boundary to lie there: less than the share below it, more with it."""
        for at in range(len(MARKS), 0, -1):
            wider = at == 1 or self.rows[:, at - 1 :].sum() > most
            if wider and self.weights[1, :at].sum() < share < self.weights[1].sum() + self.weights[0, at:].sum():
                return float(MARKS[at - 1])
        return np.inf

    def wider(self, width: float, most: float) -> bool:
        """Whether more rows than that lie within the width."""
        return bool(self.rows[:, int((MARKS >= width).sum()) :].sum() > most)

    def off(self, share: float) -> float:
        """About how far below the boundary the least rows of that weight end; 0 if that is nearer than the last mark."""
        ends = np.cumsum(np.r_[self.weights[1], self.weights[0, ::-1]])
        at = int(np.searchsorted(ends, share))
        side, mark = (1, at) if at < len(MARKS) + 1 else (-1, 2 * len(MARKS) + 1 - at)
        return side * float(MARKS[0] if mark == 0 else 0.85 * MARKS[mark - 1]) if mark < len(MARKS) else 0.0


@dataclass(frozen=True)
class _Table:
    """Distinct rows with their weights, over tasks."""

    points: DataFrame
    columns: Sequence[str]
    scratch: Scratch

    def _pass(self, run: Callable[[np.ndarray, np.ndarray], None], end: Callable[[], list[list[float]]], names: Sequence[str]) -> DataFrame:
        k = len(self.columns)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from run(_matrix(batch, k), batch.column(k).to_numpy()) or ()
            yield from end()

        return self.points.select(*self.columns, "weight").mapInArrow(task, names)

    def measure(self, now: Boundary, former: Boundary) -> Measured:
        found = Measured()

        def end() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([found.numbers()])], names=["n"])

        parts = self._pass(lambda x, weight: found.add(x, weight, now, former), end, "n array<double>").collect()  # a row for each task
        return Measured.joined(np.array([r["n"] for r in parts]))

    def gather(self, now: Boundary, width: float, name: str) -> tuple[_Table, np.ndarray, float]:
        """The rows within ``width`` of the boundary, and the sum and weight of those further below it."""
        total = np.zeros(len(now.w) + 1)
        names = [*self.columns, "weight", "total"]

        def run(x: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
            for part in now.landmarks.blocks(x):
                kernel = now.landmarks.kernel(x[part])
                under = now.rho - kernel @ (now.landmarks.inverse.T @ now.w)
                far = under > width
                total[:-1] += (weight[part] * far) @ kernel
                total[-1] += weight[part][far].sum()
                near = np.flatnonzero(np.abs(under) <= width)
                kept = [pa.array(c) for c in x[part][near].T]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(weight[part][near]), pa.nulls(len(near), pa.list_(pa.float64()))], names=names)

        def end() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([*(pa.array([0.0]) for _ in names[:-1]), pa.array([total.tolist()])], names=names)

        kinds = ", ".join(f"{c} double" for c in names[:-1]) + ", total array<double>"
        band = self.scratch.table(self._pass(run, end, kinds), name)
        sums = np.sum([r["total"] for r in band.filter("total IS NOT NULL").select("total").collect()], 0)  # a row for each task
        return _Table(band.filter("total IS NULL").drop("total"), self.columns, self.scratch), now.landmarks.inverse @ sums[:-1], float(sums[-1])

    def held(self, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Rows and weights, and whether they are the rows themselves: beyond ``most`` they are the means of the finest cells that are few enough."""
        rows, exact = self.points, self.points.count() <= most
        if not exact:
            sides = 2.0 ** np.arange(8, -24, -1)
            cell = lambda side: [F.floor(F.col(c) / float(side)) for c in self.columns]
            counts = rows.agg(*[F.approx_count_distinct(F.xxhash64(*cell(s))) for s in sides]).first()
            fit = [s for s, n in zip(sides, counts, strict=True) if n <= most]
            rows = rows.groupBy(*(cell(fit[-1]) if fit else [])).agg(*[(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c) for c in self.columns], F.sum("weight").alias("weight"))
        x = rows.select(*self.columns, "weight").toArrow()
        columns = [c.to_numpy() for c in x.columns]
        return np.column_stack(columns[:-1]), columns[-1], exact


def fit(df: DataFrame, columns: Sequence[str], nu: float, scratch: Scratch, held: int | None = None) -> Boundary:
    """The boundary of all rows without NaN and infinities, gamma 1 / columns.

    Copies of a row are one row with a weight. The first round holds the means of cells of all rows; then
    rows near the boundary are held, as means of finer cells, and once at most ``held`` are left, each by itself.
    Of the way to a round's solution the best part is gone. Where the solution lies beyond the rows that were held, the next band is wider.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        rows = rows.filter(F.abs(F.col(c)) < float("inf"))
    table = _Table(scratch.table(rows.groupBy(*columns).agg(F.count("*").cast("double").alias("weight")), "points"), columns, scratch)
    size, n = table.points.agg(F.count("*"), F.sum("weight")).first()
    marks = landmarks(table.points, columns, 1 / len(columns))
    now = Boundary(marks, np.zeros(len(marks.points)), 0.0)
    if not size:
        return now
    share, most = nu * n, held or max(2 * len(now.w), ENTRIES // len(now.w))
    near, pull, settled, width = table, np.zeros(len(now.w)), 0.0, np.inf
    band, best = float(size), np.inf
    for number in range(MOST):
        x, weight, exact = near.held(most)
        new = Boundary(marks, *interior(marks.features(x), weight / share, pull / share, 1 - settled / share), now.gaps)
        seen = table.measure(new, now)
        ways = [now.toward(new, part) for part in PARTS]
        costs = [float(b.w @ b.w / 2 - b.rho + below / share) for b, below in zip(ways, seen.below, strict=True)]
        if exact:
            new.gaps.append(costs[0] + float(new.w @ new.w) / 2)
            if new.gaps[-1] <= GAP:
                return new
        at = int(np.argmin(costs))
        if costs[at] >= best:
            band *= NARROWER if exact else 1 / NARROWER
        elif at:
            band *= 2 if exact else 1 / NARROWER
        elif seen.moved <= width:
            band /= NARROWER
        band = min(float(size), max(float(most), band))
        if costs[at] < best:
            now, best = ways[at], costs[at]
        seen = seen if now is ways[0] else table.measure(now, now)
        width = seen.within(band, share)
        for _ in MARKS:  # rho goes to where nu of the rows lie below, if the band can't be as narrow otherwise
            off = seen.off(share) if seen.wider(width, band) else 0.0
            if not off:
                break
            now = Boundary(marks, now.w, now.rho - off, now.gaps)
            seen = table.measure(now, now)
            best, width = float(now.w @ now.w / 2 - now.rho + seen.below[0] / share), seen.within(band, share)
        near, pull, settled = table.gather(now, width, f"band{number}")
    raise RuntimeError(f"the boundary has not been found after {MOST} rounds")


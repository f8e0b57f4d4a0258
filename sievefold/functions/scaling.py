"""Scaling and quantizing expressions. Statistics come from a one-row aggregate, never from an unpartitioned window."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def with_stats(df: DataFrame, *stats: Column) -> DataFrame:
    """Adds scalar aggregates of the whole frame as columns; one row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


#: Up to so many values an exact percentile is one aggregate, which holds each distinct value once.
HELD = 1_000_000
#: Bounds from one round lie within about this share of the values around a rank.
ACCURACY = 2000
#: Each round leaves a few thousandths of the values; no table needs near as many.
ROUNDS = 60


@dataclass
class _Rank:
    """The k-th least (from 0) of the n values of a column strictly between two values; None is no bound."""

    column: int
    k: int
    n: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        """The column's value if it lies between the bounds; NaN, which Spark puts above all numbers, never does."""
        x = F.col(f"c{self.column}")
        bounds = [~F.isnan(x)]
        bounds += [x > self.low] if self.low is not None else []
        bounds += [x < self.high] if self.high is not None else []
        return F.when(reduce(lambda p, q: p & q, bounds), x)

    def around(self) -> tuple[float, float]:
        """Fractions that lie safely on both sides of the rank."""
        at = (self.k + 0.5) / self.n
        return max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)

    def narrow(self, first: float, second: float, counts: Row) -> None:
        """Goes on between, at, or outside two values that the column holds, given how many values lie where."""
        parts = [(counts["below"], self.low, first, None), (counts["first"], None, None, first), (counts["between"], first, second, None), (counts["second"], None, None, second)]
        for n, low, high, value in [*parts, (self.n - sum(p[0] for p in parts), second, self.high, None)]:
            if self.k < n:
                self.n, self.low, self.high, self.value = n, low, high, value
                return
            self.k -= n
        raise RuntimeError("values changed while percentiles were sought")


def _seek(frame: DataFrame, ranks: Sequence[_Rank], held: int) -> None:
    """Finds the value of each rank. Two aggregates a round serve all ranks of all columns.

    Approximate percentiles, which are values of the column, bracket each rank; exact counts around them say
    in which part it lies. Both compare values only, so infinities and any range do. Every round leaves
    out two values at least, and nearly always all but a few thousandths, whatever the distribution; a rank is read off
    once its range has few values. All ranks together gather ``held`` values or 1,000 each.
    """
    share = max(1000, held // max(1, len(ranks)))
    for _ in range(ROUNDS):
        wide = [s for s in ranks if s.value is None and s.n > share]
        if not wide:
            break
        marks = frame.agg(*[F.percentile_approx(s.inside(), F.array(*map(F.lit, s.around())), ACCURACY) for s in wide]).first()

        def counts(s: _Rank, first: float, second: float) -> Column:
            x = s.inside()
            apart = F.lit(first != second)
            return F.struct(F.count_if(x < first).alias("below"), F.count_if(x == first).alias("first"), F.count_if((x > first) & (x < second)).alias("between"), F.count_if((x == second) & apart).alias("second"))

        found = frame.agg(*[counts(s, *m) for s, m in zip(wide, marks, strict=True)]).first()
        for s, m, c in zip(wide, marks, found, strict=True):
            s.narrow(*m, c)
    else:
        raise RuntimeError(f"percentiles have not been found after {ROUNDS} rounds")
    few = [s for s in ranks if s.value is None]
    if few:
        for s, v in zip(few, frame.agg(*[F.sort_array(F.collect_list(s.inside()))[s.k] for s in few]).first(), strict=True):
            s.value = v


def percentiles(df: DataFrame, columns: Sequence[str | Column], ps: Sequence[float], held: int = HELD) -> list[list[float | None]]:
    """Exact percentiles with linear interpolation, a list for each column; nulls are left out.

    Up to ``held`` values they are one aggregate. Beyond it no task gathers the distinct values: all ranks of
    all columns are sought together, by a few rounds of two aggregates. The results are the same.
    Infinities are values like others, NaN is above all, and between equal values nothing is interpolated. A column without values gives nulls.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    if not cols:
        return []
    frame = df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    row = frame.agg(*[F.struct(F.count(c).alias("n"), F.count_if(F.isnan(c)).alias("nan")) for c in frame.columns]).first()
    if max(r["n"] for r in row) <= held and not any(r["nan"] for r in row):
        found = frame.agg(*[F.percentile(c, F.array(*map(F.lit, map(float, ps)))) for c in frame.columns]).first()
        return [list(v) if v is not None else [None] * len(ps) for v in found]
    ranks: dict[tuple[int, int], _Rank] = {}
    for c, r in enumerate(row):
        for p in ps if r["n"] else ():
            for k in {math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1))}:
                plain = r["n"] - r["nan"]
                ranks[c, k] = _Rank(c, k, plain, value=None if k < plain else math.nan)
    _seek(frame, list(ranks.values()), held)

    def between(c: int, n: int, p: float) -> float | None:
        if not n:
            return None
        at = p * (n - 1)
        low, high = ranks[c, math.floor(at)].value, ranks[c, math.ceil(at)].value
        return low if low == high else low * (math.ceil(at) - at) + high * (at - math.floor(at))

    return [[between(c, r["n"], p) for p in ps] for c, r in enumerate(row)]


def order_statistic(df: DataFrame, column: str, k: int, n: int, held: int = HELD) -> float:
    """The k-th least (from 0) of the n values of a column, of which none is null or NaN."""
    rank = _Rank(0, k, n)
    _seek(df.select(F.col(column).cast("double").alias("c0")), [rank], held)
    return rank.value


def rescale(x: Column, low: Column, high: Column, to: tuple[float, float], constant: float) -> Column:
    """Min-max to ``to``; null and a constant column give ``constant``."""
    span = high - low
    return F.when(x.isNull() | span.isNull() | (span == 0), F.lit(constant)).otherwise(to[0] + (x - low) / span * (to[1] - to[0]))


def minmax(df: DataFrame, column: str, out: str, to: tuple[float, float] = (-1.0, 1.0), constant: float | None = None) -> DataFrame:
    """F1 (null and constant go to the lower bound) and F2 (``constant=0.5``)."""
    joined = with_stats(df, F.min(column).alias("_low"), F.max(column).alias("_high"))
    return joined.withColumn(out, rescale(F.col(column), F.col("_low"), F.col("_high"), to, to[0] if constant is None else constant)).drop("_low", "_high")


def byte_scale(x: Column, low: Column, high: Column) -> Column:
    """0..255, truncated."""
    return F.when(high == low, F.lit(0)).otherwise((255 * (x - low) / (high - low)).cast("int"))


def standard_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_std") -> DataFrame:
    """population standard deviation; zero counts as 1."""
    stats = [s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    out = with_stats(df, *stats)
    for c in columns:
        s = F.col(f"_s_{c}")
        out = out.withColumn(c + suffix, (F.col(c) - F.col(f"_m_{c}")) / F.when(s == 0, 1.0).otherwise(s))
    return out.drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def robust_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_robust") -> DataFrame:
    """median and interquartile range; zero counts as 1."""
    out = {}
    for c, (low, mid, high) in zip(columns, percentiles(df, columns, (0.25, 0.5, 0.75)), strict=True):
        spread = 1.0 if mid is None or high == low else high - low
        out[c + suffix] = (F.col(c) - F.lit(mid).cast("double")) / spread
    return df.withColumns(out)


def zscore(x: Column, mean: Column, std: Column, epsilon: float = 1e-8) -> Column:
    """F6."""
    return (x - mean) / (std + epsilon)


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """F7."""
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def pcm16(x: Column) -> Column:
    """F8: truncates toward zero."""
    return (clip(x) * 32767).cast("smallint")


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P10: exact medians, sought only for columns that hold nulls."""
    missing = df.agg(*[F.count_if(F.col(c).isNull()) for c in columns]).first() if columns else ()
    holed = [c for c, n in zip(columns, missing, strict=True) if n]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m).cast("double")) for c, (m,) in zip(holed, percentiles(df, holed, (0.5,)), strict=True)})


def hann(i: Column, size: int) -> Column:
    """symmetric window."""
    return 0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * i / (size - 1))

"""Discrete Fourier transforms of whole signals, dealt over tasks.

A signal of n = n1 * n2 samples is a matrix: its columns are transformed and turned, sent on by rows, and
the rows are transformed. A group holds some columns or rows, about ``SAMPLES`` samples, however long
the signal is. A length without such factors is a product of chirps and a convolution of a length that is a power of two.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievefold.operators.rowid import with_row_id
from sievefold.sources.store import Scratch

#: Samples of a group, about.
SAMPLES = 1 << 18
#: A row of the matrix is one group at least, so no row is longer.
LONGEST = 1 << 20


def placed(signals: DataFrame, by: Sequence[str], scratch: Scratch) -> tuple[DataFrame, list]:
    """``signals`` with g, a number for each group, and at, the place by idx in it; and (g, n, mean, std, *by) of each group.

    ``value`` is a double, null becomes NaN. The driver holds a row for each group.
    """
    rows = signals.withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(math.nan)))
    numbered = with_row_id(rows, [*by, "idx"], "_row", scratch)
    stats = [F.min("_row").alias("_start"), F.count("*").alias("_n"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std")]
    groups = [(g, *r) for g, r in enumerate(numbered.groupBy(*by).agg(*stats).orderBy("_start").collect())]
    kinds = ", ".join(f"_{c} {signals.schema[c].dataType.simpleString()}" for c in by)
    known = signals.sparkSession.createDataFrame([r[: len(by) + 2] for r in groups], f"g int, {kinds}, _start long")
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in by]
    both = numbered.join(F.broadcast(known), same)
    return both.withColumn("at", F.col("_row") - F.col("_start")).drop("_row", "_start", *(f"_{c}" for c in by)), [(r[0], *r[len(by) + 2 :], *r[1 : len(by) + 1]) for r in groups]


def factors(n: int) -> tuple[int, int]:
    """(n1, n2) with n1 * n2 = n, as even as can be; a short signal is one row."""
    if n <= 1 << 14:
        return 1, n
    n1 = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)
    return n1, n // n1


def transform(signals: DataFrame, sizes: dict[int, int], channels: Sequence[tuple[str, str | None]], scratch: Scratch, inverse: bool = False, longest: int = LONGEST) -> DataFrame:
    """(g, k, re_0, im_0, re_1, ...): the transform of each channel (real part, imaginary part or none) of each signal g of length ``sizes[g]``.

    ``signals`` has g, at and the channels; samples that aren't there are 0.
    """
    spark = signals.sparkSession
    long = [g for g, n in sizes.items() if factors(n)[1] > longest]
    plain = {g: n for g, n in sizes.items() if g not in long}
    sign = -1.0 if inverse else 1.0
    parts = [(F.col(re), F.col(im) * sign if im else F.lit(0.0)) for re, im in channels]
    rows = signals.select("g", "at", *[c.cast("double").alias(f"{name}_{k}") for k, p in enumerate(parts) for name, c in zip(("re", "im"), p, strict=True)])
    out = _matrix(rows.filter(~F.col("g").isin(long)) if long else rows, plain, len(parts))
    if long:
        out = out.unionAll(_chirped(rows, {g: sizes[g] for g in long}, len(parts), scratch))
    if not inverse:
        return out
    lengths = F.broadcast(spark.createDataFrame(list(sizes.items()), "g int, _n long"))
    back = [(F.col(f"{name}_{k}") * (1.0 if name == "re" else -1.0) / F.col("_n")).alias(f"{name}_{k}") for k in range(len(parts)) for name in ("re", "im")]
    return out.join(lengths, "g").select("g", "k", *back)


def _matrix(rows: DataFrame, sizes: dict[int, int], channels: int) -> DataFrame:
    plans = {}
    for g, n in sizes.items():
        n1, n2 = factors(n)
        plans[g] = n, n1, n2, max(1, min(n1, SAMPLES // n2)), max(1, min(n2, SAMPLES // n1))  # rows and columns of a group
    names = [f"{name}_{k}" for k in range(channels) for name in ("re", "im")]
    known = F.broadcast(rows.sparkSession.createDataFrame([(g, p[2], p[4]) for g, p in plans.items()], "g int, n2 long, wide long"))

    def columns(table: pa.Table) -> pa.Table:
        g, block = table.column("g")[0].as_py(), table.column("block")[0].as_py()
        n, n1, n2, high, wide = plans[g]
        first, last = block * wide, min(n2, (block + 1) * wide)
        at = table.column("at").to_numpy()
        x = np.zeros((channels, n1, last - first), complex)
        for k in range(channels):
            x[k, at // n2, at % n2 - first] = table.column(f"re_{k}").to_numpy() + 1j * table.column(f"im_{k}").to_numpy()
        if n1 > 1:
            turn = (np.arange(n1)[:, None] * np.arange(first, last)[None, :]) % n
            x = np.fft.fft(x, axis=1) * np.exp(-2j * np.pi / n * turn)
        cut = range(0, n1, high)
        out = [pa.array([v] * len(cut), t) for v, t in ((g, pa.int32()), (block, pa.int64()))]
        return pa.table([*out, pa.array([i // high for i in cut], pa.int64()), pa.array([x[:, i : i + high].tobytes() for i in cut], pa.binary())], names=["g", "block", "row", "part"])

    def lines(table: pa.Table) -> pa.Table:
        g, row = table.column("g")[0].as_py(), table.column("row")[0].as_py()
        n, n1, n2, high, wide = plans[g]
        first, last = row * high, min(n1, (row + 1) * high)
        x = np.zeros((channels, last - first, n2), complex)
        for block, part in zip(table.column("block").to_pylist(), table.column("part"), strict=True):
            x[:, :, block * wide : (block + 1) * wide] = np.frombuffer(part.as_buffer(), complex).reshape(channels, last - first, -1)
        x = np.fft.fft(x, axis=2).reshape(channels, -1)
        at = (np.arange(first, last)[:, None] + n1 * np.arange(n2)[None, :]).ravel()
        values = [pa.array(np.ascontiguousarray(v)) for k in range(channels) for v in (x[k].real, x[k].imag)]
        return pa.table([pa.array(np.full(len(at), g, np.int32)), pa.array(at), *values], names=["g", "k", *names])

    dealt = rows.join(known, "g").withColumn("block", F.floor(F.col("at") % F.col("n2") / F.col("wide")).cast("long")).select("g", "block", "at", *names)
    turned = dealt.groupBy("g", "block").applyInArrow(columns, "g int, block long, row long, part binary")
    return turned.groupBy("g", "row").applyInArrow(lines, "g int, k long, " + ", ".join(f"{c} double" for c in names))


def _chirped(rows: DataFrame, sizes: dict[int, int], channels: int, scratch: Scratch) -> DataFrame:
    """Bluestein's form: chirp, convolve with the opposite chirp, chirp. Squares are reduced before they become angles."""
    spark = rows.sparkSession
    wide = {g: 1 << (2 * n - 2).bit_length() for g, n in sizes.items()}
    known = F.broadcast(spark.createDataFrame([(g, n, wide[g]) for g, n in sizes.items()], "g int, n long, m long"))

    def times(df: DataFrame, at: str, re, im, sign: float) -> list[Column]:
        angle = F.lit(math.pi) * F.pmod(F.col(at) * F.col(at), 2 * F.col("n")) / F.col("n")
        c, s = F.cos(angle), sign * F.sin(angle)
        return [v for k in range(channels) for v in ((F.col(f"{re}_{k}") * c - F.col(f"{im}_{k}") * s).alias(f"re_{k}"), (F.col(f"{re}_{k}") * s + F.col(f"{im}_{k}") * c).alias(f"im_{k}"))]

    own = rows.join(known, "g")
    first = scratch.table(_matrix(own.select("g", "at", *times(own, "at", "re", "im", -1.0)), wide, channels), "chirped")
    chirps = None
    for g, n in sizes.items():
        at = spark.range(wide[g]).select(F.lit(g).alias("g"), F.col("id").alias("at"), F.least(F.col("id"), F.lit(wide[g]) - F.col("id")).alias("d")).filter(F.col("d") < n)
        angle = F.lit(math.pi) * F.pmod(F.col("d") * F.col("d"), F.lit(2 * n)) / n
        one = at.select("g", "at", F.cos(angle).alias("re_0"), F.sin(angle).alias("im_0"))
        chirps = one if chirps is None else chirps.unionAll(one)
    other = scratch.table(_matrix(chirps, wide, 1), "chirps").withColumnsRenamed({"re_0": "re_b", "im_0": "im_b"})
    product = [v for k in range(channels) for v in ((F.col(f"re_{k}") * F.col("re_b") - F.col(f"im_{k}") * F.col("im_b")).alias(f"re_{k}"), (-(F.col(f"re_{k}") * F.col("im_b") + F.col(f"im_{k}") * F.col("re_b"))).alias(f"im_{k}"))]
    back = _matrix(first.join(other, ["g", "k"]).select("g", F.col("k").alias("at"), *product), wide, channels).join(known, "g").filter(F.col("k") < F.col("n"))
    back = back.withColumns({f"{name}_{k}": F.col(f"{name}_{k}") * sign / F.col("m") for k in range(channels) for name, sign in (("re", 1.0), ("im", -1.0))})
    return back.select("g", "k", *times(back, "k", "re", "im", -1.0))

"""Plots of any number of rows, from counts in bins.

A scatter plot is a pyramid of two-dimensional bins: rows are counted once, in the finest bins,
and each coarser level adds up four bins of the one below. A picture is a tile of one
level, so its size doesn't depend on the rows. Bars are drawn from one row each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievefold.functions.scaling import with_stats
from sievefold.operators.vision import png_bytes


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal bins over a range, its end in the last; a range of one value is bin 0."""
    span = high - low
    return F.when(span == 0, 0).otherwise(F.least(F.floor((x - low) / span * bins), F.lit(bins - 1))).cast("int")


def pyramid(df: DataFrame, x: str, y: str, levels: int = 8, flag: Column | None = None) -> DataFrame:
    """K9: (level, bin_x, bin_y, n, n_flagged) of the bins that hold rows: 2 ** level bins a side, from 0 to ``levels``.

    Rows with a null, NaN or infinite coordinate are left out. One aggregate for the ranges, one for the finest bins, with
    partial counts, so a bin that most rows fall in is one row a task; every level above is summed from the one below,
    of at most 4 ** levels rows.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    rows = df.filter(finite(x) & finite(y)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.coalesce(flag if flag is not None else F.lit(False), F.lit(False)).alias("f"))
    ranged = with_stats(rows, F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = 1 << levels
    binned = ranged.select(bin_of(F.col("x"), F.col("x0"), F.col("x1"), side).alias("bin_x"), bin_of(F.col("y"), F.col("y0"), F.col("y1"), side).alias("bin_y"), "f")
    level = binned.groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"), F.count_if("f").alias("n_flagged")).withColumn("level", F.lit(levels))
    out = level
    for k in range(levels - 1, -1, -1):
        level = level.groupBy(F.shiftright("bin_x", 1).alias("bin_x"), F.shiftright("bin_y", 1).alias("bin_y")).agg(F.sum("n").alias("n"), F.sum("n_flagged").alias("n_flagged")).withColumn("level", F.lit(k))
        out = out.unionByName(level)
    return out.select("level", "bin_x", "bin_y", "n", "n_flagged")


def tiles(bins: DataFrame, level: int, tile: int = 256) -> DataFrame:
    """(tx, ty, png): one level of a pyramid as pictures of ``tile`` bins a side, y upwards; darker is more rows, red holds flagged ones.

    Shades follow the logarithm of a bin's share of the fullest bin of the level. A picture is one
    task's work, of tile * tile bins at most; tiles without rows are not made.
    """
    one = bins.filter(F.col("level") == level)
    shaded = with_stats(one, F.max("n").alias("top")).withColumn("shade", 255 - (F.log1p("n") / F.log1p("top") * 230 + 25).cast("int"))
    at = shaded.select(F.floor(F.col("bin_x") / tile).cast("int").alias("tx"), F.floor(F.col("bin_y") / tile).cast("int").alias("ty"), (F.col("bin_x") % tile).alias("px"), (F.col("bin_y") % tile).alias("py"), "shade", (F.col("n_flagged") > 0).alias("red"))
    side = min(tile, 1 << level)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = np.full((side, side, 3), 255, np.uint8)
        row, col = side - 1 - pdf["py"].to_numpy(), pdf["px"].to_numpy()
        pixels[row, col] = pdf["shade"].to_numpy()[:, None]
        pixels[row[pdf["red"]], col[pdf["red"]], 0] = 255
        return pd.DataFrame({"tx": [pdf["tx"].iloc[0]], "ty": [pdf["ty"].iloc[0]], "png": [png_bytes(pixels)]})

    return at.groupBy("tx", "ty").applyInPandas(draw, "tx int, ty int, png binary")


def bars(counts: DataFrame, label: str, value: str, height: int = 120, width: int = 6, most: int = 1000) -> DataFrame:
    """(png, n): one picture with a bar for each row, in the order of labels: histograms and comparisons of methods.

    ``counts`` is an aggregate; more than ``most`` rows are no plot and raise. The greatest value is as high as
    the picture, null and negative values have no bar.
    """
    rows = counts.select(F.col(label).cast("string").alias("label"), F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value"), F.col(label).alias("by"))
    held = rows.orderBy("by").limit(most + 1).groupBy().agg(F.sort_array(F.collect_list(F.struct("by", "value"))).alias("rows")).select(F.col("rows.value").alias("v"))

    def draw(frames):
        for pdf in frames:
            for v in pdf["v"]:
                if len(v) > most:
                    raise ValueError(f"more than {most} bars")
                tall = np.round(np.asarray(v) / max(max(v, default=0), 1e-300) * height).astype(int)
                pixels = np.full((height, width * max(1, len(v)), 3), 255, np.uint8)
                for k, h in enumerate(tall):
                    pixels[height - h :, width * k : width * (k + 1) - 1] = (70, 110, 170) if h else 255
                yield pd.DataFrame({"png": [png_bytes(pixels)], "n": [len(v)]})

    return held.mapInPandas(draw, "png binary, n int")


def shares(bins: DataFrame) -> DataFrame:
    """Each bin's share of its level, for heat maps."""
    return bins.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("level")))

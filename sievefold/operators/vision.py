"""Columns as images: grids, colours, morphology and summaries."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefold.functions.scaling import percentiles
from sievefold.operators.forest import fit_forests, score_forests
from sievefold.operators.profile import drop_null_inf
from sievefold.sources.store import Scratch


def grid_side(n: int) -> int:
    """V1."""
    side = int(math.sqrt(n) * 1.2)
    return side if side * side >= n else side + 1


def _dealt(cells: DataFrame, side: int, *keys: str) -> DataFrame:
    """Large images over more tasks than a shuffle has by itself, so that none sorts many more than 2^20 cells."""
    parts = side * side >> 20
    return cells.repartition(parts, *keys) if parts > int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")) else cells


def grid(df: DataFrame, row_id: str, column: str, flag: Column, side: int) -> DataFrame:
    """V1: (y, x, value, anomaly) of all side * side cells; cells past the data are 0."""
    data = df.select(F.col(row_id).alias("cell"), F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("value"), flag.cast("int").alias("anomaly"))
    cells = df.sparkSession.range(side * side).withColumnRenamed("id", "cell")
    cells, data = (_dealt(x, side, "cell") for x in (cells, data))
    whole = cells.join(data, "cell", "left").na.fill(0)
    return whole.select((F.floor(F.col("cell") / side)).cast("int").alias("y"), (F.col("cell") % side).cast("int").alias("x"), "value", "anomaly")


def colours(cells: DataFrame) -> DataFrame:
    """V3: red marks anomalies; green and blue are the value between the least and greatest cell."""
    stats = cells.agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    shade = F.when(F.col("_high") == F.col("_low"), 0).otherwise((255 * (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low"))).cast("int"))
    return cells.crossJoin(F.broadcast(stats)).select("y", "x", (F.col("anomaly") * 255).alias("r"), shade.alias("g"), shade.alias("b"))


def _cross(img: np.ndarray, how: np.ufunc) -> np.ndarray:
    """The greatest or least of each cell and its four neighbours; NaN is no cell, and what has none around it stays so."""
    padded = np.pad(img, 1, constant_values=np.nan)
    return how.reduce([padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:]])


def close_flags(cells: DataFrame, side: int, column: str = "anomaly", tile: int = 512) -> DataFrame:
    """V4: dilate, then erode, with a cross of five cells.

    Cells go to the tile that they lie in, those within two cells of another tile to that one too; a group is one tile, whatever the image's size.
    """
    kind = cells.schema[column].dataType.simpleString()
    near = lambda c: F.sequence(*[F.floor((F.col(c) + d) / tile).cast("int") for d in (-2, 2)])
    inside = F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1)
    sent = cells.select("y", "x", column).filter(inside).withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["ty"].iloc[0]), int(pdf["tx"].iloc[0])
        top, left = ty * tile, tx * tile
        img = np.full((tile + 4, tile + 4), np.nan)
        img[pdf["y"].to_numpy() - top + 2, pdf["x"].to_numpy() - left + 2] = pdf[column].to_numpy(float)
        y, x = np.arange(top - 2, top + tile + 2), np.arange(left - 2, left + tile + 2)
        out = ((y < 0) | (y >= side))[:, None] | ((x < 0) | (x >= side))[None, :]
        wide = np.where(out, np.nan, _cross(img, np.fmax))
        closed = np.where(out, np.nan, _cross(wide, np.fmin))[2:-2, 2:-2]
        y, x = np.nonzero(~np.isnan(closed))
        return pd.DataFrame({"y": (y + top).astype(np.int32), "x": (x + left).astype(np.int32), column: closed[y, x]})

    closed = _dealt(sent, side, "ty", "tx").groupBy("ty", "tx").applyInPandas(run, f"y int, x int, {column} double")
    return closed.select("y", "x", F.col(column).cast(kind).alias(column))


def film_frames(df: DataFrame, row_id: str, columns: list[str], contamination: float = 0.1, scratch: Scratch | None = None) -> DataFrame:
    """(column_name, row_id, value, anomaly) of each numeric column, each with its own forest.

    All columns are served together: one shuffle grows the trees, one narrow pass scores, one search finds the limits.
    """
    scratch = scratch or Scratch(df.sparkSession)
    clean = drop_null_inf(df, columns).select(row_id, *[F.col(c).cast("double").alias(c) for c in columns])
    own = {c: [c] for c in columns}
    forests = fit_forests(clean, row_id, own, trees=100)
    if not forests:
        return clean.select(F.col(row_id), F.lit("").alias("column_name"), F.lit(0.0).alias("value"), F.lit(0).alias("anomaly")).limit(0)
    scored = scratch.table(score_forests(clean, row_id, own, forests, *columns), "film")
    cuts = percentiles(scored, [f"score_{k}" for k in range(len(columns))], [1 - contamination])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), (F.col(f"score_{k}") > cuts[k][0]).cast("int").alias("anomaly")) for k, c in enumerate(columns)]
    return scored.select(row_id, F.inline(F.array(*rows)))


def film_folder(spark: SparkSession, folder: str, contamination: float = 0.1) -> tuple[DataFrame | None, list[str]]:
    """V9: (file, column_name, row_id, value, anomaly) of all numeric columns with more than two values of a folder's CSV tables.

    Also the names of the files that gave nothing: those that can't be read as a table and those without such columns.
    """
    from sievefold.operators.joins import union_all
    from sievefold.operators.profile import continuous_columns
    from sievefold.operators.rowid import with_row_id
    from sievefold.sources.io import list_tables, read_csv

    frames, skipped = [], []
    for name, path in list_tables(spark, folder).items():
        try:
            df = read_csv(spark, path)
        except AnalysisException:
            skipped.append(name)
            continue
        columns = continuous_columns(df)
        if not columns:
            skipped.append(name)
            continue
        numbered = with_row_id(df.select(*columns), columns)
        frames.append(film_frames(numbered, "row_id", columns, contamination).withColumn("file", F.lit(name)))
    return (union_all(frames) if frames else None), skipped


def film_top(frames: DataFrame, k: int = 20) -> DataFrame:
    """Columns with the largest share of anomalies; a top-k report."""
    return frames.groupBy("column_name").agg(F.sum("anomaly").alias("n_anomaly"), F.count("*").alias("n"), (100 * F.avg("anomaly")).alias("anomaly_pct")).orderBy(F.desc("anomaly_pct"), "column_name").limit(k)


def shrink(cells: DataFrame, side: int, most: int = 512) -> tuple[DataFrame, int]:
    """Cells averaged into an image of at most ``most`` pixels a side; any anomaly in a pixel marks it. The new side is returned too."""
    step = -(-side // most)
    if step == 1:
        return cells, side
    at = lambda c: F.floor(F.col(c) / step).cast("int").alias(c)
    return cells.groupBy(at("y"), at("x")).agg(F.avg("value").alias("value"), F.max("anomaly").alias("anomaly")), -(-side // step)


def png_bytes(pixels: np.ndarray) -> bytes:
    """An RGB image of 8 bits as a PNG file."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, 1 + 3 * w), np.uint8)  # each row starts with its filter, none
    rows[:, 1:] = pixels.reshape(h, 3 * w)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def film_png(coloured: DataFrame, by: str, side: int) -> DataFrame:
    """K9: (by, png) of (by, y, x, r, g, b), one image for each value of ``by``; missing pixels are black.

    An image is one task's work, so cells should come from ``shrink``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = np.zeros((side, side, 3), np.uint8)
        pixels[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({by: [pdf[by].iloc[0]], "png": [png_bytes(pixels)]})

    return coloured.groupBy(by).applyInPandas(run, f"{by} {coloured.schema[by].dataType.simpleString()}, png binary")

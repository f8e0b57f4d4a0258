"""Rows of files in the order in which they lie there.

A scan is cut into splits, each a stretch of a file. Within a split rows come in
order; how many rows the splits before it hold, by file name and offset, is a sum over one row for each split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefold.sources.store import Scratch

#: Up to so many splits are broadcast; more are joined.
FEW_SPLITS = 200_000


def in_file_order(scan: DataFrame, row_id: str = "row_id", line: str | None = None) -> DataFrame:
    """``scan`` with a dense id from 0 along its files, by name, and along each file; ``line`` counts within the file too.

    ``scan`` reads text, CSV or JSON lines and may drop columns, but filters come after. It is read twice, the first
    time without its columns; nothing is shuffled or sorted but one row for each split. An empty file has no rows.
    """
    meta = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    marked = scan.select("*", *meta)
    splits = marked.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("_first")).collect()
    known, at, in_file, file = [], 0, 0, None
    for r in sorted(splits, key=lambda r: (r["_file"], r["_block"])):
        in_file = in_file if r["_file"] == file else 0
        known.append((r["_file"], r["_block"], r["_first"], at, in_file))
        file, at, in_file = r["_file"], at + r["n"], in_file + r["n"]
    offsets = scan.sparkSession.createDataFrame(known, "_file string, _block long, _first long, _before long, _in_file long")
    joined = marked.join(F.broadcast(offsets) if len(known) <= FEW_SPLITS else offsets, ["_file", "_block"])
    place = F.col("_at") - F.col("_first")
    more = [(F.col("_in_file") + place).alias(line)] if line else []
    return joined.select(*scan.columns, (F.col("_before") + place).alias(row_id), *more)


def read_lines(spark: SparkSession, path: str, row_id: str = "row_id") -> DataFrame:
    """(value, row_id): the lines of a file or of the files of a folder."""
    return in_file_order(spark.read.text(path), row_id)


def trim_file(spark: SparkSession, path: str, lines: int = 20_000) -> int:
    """Keeps the first ``lines`` lines of what lies at ``path``, a header among them, and says how many were kept.

    The kept lines are written beside it, in parts whose names follow the order, and take its place when
    they are complete; a run that breaks off leaves the old lines or the complete new ones. Only kept lines are shuffled.
    """
    if lines < 0:
        raise ValueError("lines must not be negative")
    beside = f"{path.rstrip('/')}.trimmed"
    numbered = read_lines(spark, path)
    numbered.filter(F.col("row_id") < lines).repartitionByRange("row_id").sortWithinPartitions("row_id").select("value").write.mode("overwrite").text(beside)
    kept = spark.read.text(beside).count()
    jvm = spark.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path.rstrip("/"), beside))
    store = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(old, True)
    if not store.rename(new, old):
        raise OSError(f"the kept lines are at {beside}")
    return kept


def write_parts(df: DataFrame, path: str, parts: int, *order_by: str) -> None:
    """CSV lines with their order kept in the names of ``parts`` files or fewer, without header."""
    df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by).write.csv(path)


def folder(spark: SparkSession) -> str:
    return Scratch(spark).new("files")

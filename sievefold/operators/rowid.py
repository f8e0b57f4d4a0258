"""Stable row ids and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievefold.operators.ordered import from_parts, in_order
from sievefold.sources.store import Scratch


def with_row_id(df: DataFrame, order_by: Sequence[str], name: str = "row_id", scratch: Scratch | None = None) -> DataFrame:
    """Dense ids from 0 in the order of the columns, without a one-task window.

    Rows are range-partitioned, sorted and written with their place; each
    range's rows are counted, and ids go on from the ranges before. Ties are put in the order
    of the other columns.
    """
    ordered = in_order(df, order_by, scratch or Scratch(df.sparkSession))
    counts = {r["_part"]: r["count"] for r in ordered.groupBy("_part").count().collect()}  # one row for each range
    offsets, at = {}, 0
    for part in sorted(counts):
        offsets[part] = (at,)
        at += counts[part]
    return from_parts(ordered, offsets, "_first long").select(*df.columns, (F.col("_first") + F.col("_place")).alias(name))


def chunk_id(row_id: Column, size: int = 300) -> Column:
    """W1."""
    return F.floor(row_id / size).cast("long")


def limit_lines(df: DataFrame, row_id: str, lines: int = 20_000) -> DataFrame:
    """The first lines of a file with a header line, as rows."""
    return df.filter(F.col(row_id) < lines - 1)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows without replacement, the same for the same keys: those of least MD5 of seed and key; a sampling operator."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)).limit(n)

"""Joins and set operations on row identities and column names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.operators.ordered import ahead, from_parts, in_order, running_sum
from sievefold.sources.store import Scratch


def only_flagged(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """J1, P16. No hint: the optimizer broadcasts the flagged side only while it is small."""
    return df.join(flagged.select(key), key, "left_semi")


def without_flagged(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """J4, T12, P16."""
    return df.join(flagged.select(key), key, "left_anti")


def attach_rows(flagged: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """J5."""
    return flagged.join(df, key)


def match_descriptions(descriptions: DataFrame, key: str, columns: DataFrame, name: str, matched: bool = True) -> DataFrame:
    """Descriptions whose normalized key is, or isn't, a column's name."""
    norm = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    names = columns.select(norm(name).alias("_name"))
    return descriptions.join(names, norm(key) == F.col("_name"), "left_semi" if matched else "left_anti")


def lookup(tables: dict[str, tuple[DataFrame, Sequence[str]]], value: int) -> DataFrame:
    """From each table the first row with an id column equal to the value, the first such column first.

    A point search: one row for each table is the feature.
    """
    out = None
    for name, (df, ids) in tables.items():
        same = [F.col(c) == F.lit(str(value)).try_cast(df.schema[c].dataType) for c in ids]  # a literal of the column's type, so the scan is filtered
        order = F.coalesce(*[F.when(s, F.lit(k)) for k, s in enumerate(same)])
        body = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
        hit = df.filter(reduce(lambda a, b: a | b, same)).withColumn("_match", order).select(F.lit(name).alias("table_name"), "_match", body.alias("body"))
        best = hit.groupBy("table_name").agg(F.min(F.struct("_match", "body")).alias("m")).select("table_name", F.col("m._match").alias("matched_id"), F.col("m.body").alias("body"))
        out = best if out is None else out.unionByName(best)
    return out


def id_columns(columns: Sequence[str]) -> list[str]:
    """M5: names that look like ids."""
    return [c for c in columns if any(mark in c.upper() for mark in ("ID", "SK_", "_ID", "KEY"))]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """T9."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def cover_counts(regions: DataFrame, low: int = 0, high: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """For each covered index, how many [start, end) regions cover it.

    A region is +1 where it starts and -1 where it ends. These are added up by index,
    summed along the order of indexes, and each stretch between two of
    them makes its rows once, however many regions cover it.
    """
    start, end = F.greatest("start", F.lit(low)), F.col("end") if high is None else F.least("end", F.lit(high))
    kept = regions.select(start.cast("long").alias("start"), end.cast("long").alias("end")).filter("start < end")
    each = kept.select(F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))))
    ordered = in_order(each.groupBy("at").agg(F.sum("d").alias("d")), ["at"], scratch or Scratch(regions.sparkSession))
    firsts = sorted((r["_part"], r["f"]) for r in ordered.groupBy("_part").agg(F.min("at").alias("f")).collect())
    after = {part: (firsts[k + 1][1] if k + 1 < len(firsts) else None,) for k, (part, _) in enumerate(firsts)}
    summed = from_parts(running_sum(ordered, F.col("d"), "k"), after, "_next long")
    stretch = summed.withColumn("to", F.coalesce(F.lead("at").over(ahead()), F.col("_next"))).filter("k > 0")
    return stretch.select(F.explode(F.sequence("at", F.col("to") - 1)).alias("idx"), "k")

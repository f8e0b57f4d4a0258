"""Work along one order of all rows without a window over all rows.

Rows are range-partitioned, sorted and written with their place; each partition
is summed up in one row, of which the driver holds as many as there are
partitions, and every partition then goes on from what lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sievefold.sources.store import Scratch


def ahead() -> WindowSpec:
    """Along the places of one range."""
    return Window.partitionBy("_part").orderBy("_place")


def behind() -> WindowSpec:
    """Against the places of one range."""
    return Window.partitionBy("_part").orderBy(F.desc("_place"))


def in_order(df: DataFrame, order_by: Sequence[str], scratch: Scratch) -> DataFrame:
    """``df`` with _part and _place: ranges in order, and places within a range.

    Written once, so all that read it see the same places; equal keys are put in the order of all
    other columns that can be compared, so places don't depend on how tasks ran.
    """
    rest = [f.name for f in df.schema.fields if f.name not in order_by and "map<" not in f.dataType.simpleString()]
    placed = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by, *rest).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    return scratch.table(placed, "ordered")


def from_parts(df: DataFrame, values: dict[int, tuple], schema: str) -> DataFrame:
    """Adds what the driver worked out for each range; a row for each is broadcast."""
    known = df.sparkSession.createDataFrame([(k, *v) for k, v in values.items()], f"_part long, {schema}")
    return df.join(F.broadcast(known), "_part")


def running_sum(ordered: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one, this one included."""
    totals = {r["_part"]: r["s"] for r in ordered.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    before, at = {}, 0
    for part in sorted(totals):
        before[part] = (at,)
        at += totals[part] or 0
    own = F.sum(value).over(ahead().rowsBetween(Window.unboundedPreceding, 0))
    return from_parts(ordered, before, "_before long").withColumn(name, F.col("_before") + F.coalesce(own, F.lit(0))).drop("_before")

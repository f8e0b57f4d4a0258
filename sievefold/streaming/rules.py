"""The row-wise stages on a stream: routing by rules, votes from frozen statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefold.operators.rules import Rule, route
from sievefold.sources.store import Scratch


def route_stream(spark: SparkSession, path: str, schema, rules: Sequence[Rule], names: str = "*.parquet") -> DataFrame:
    """Stateless; the same plan as a batch. ``path`` is a folder, of which files with such names are read."""
    return route(spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(path), rules)


def windowed_decisions(routed: DataFrame, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by decision in tumbling windows; late rows within the watermark count."""
    timed = routed.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark needs an instant, not a local time
    return timed.withWatermark(ts, late).groupBy(F.window(ts, width), "decision").agg(F.count("*").alias("n"))


def frozen_zscore(df: DataFrame, stats: dict[str, tuple[float, float]], contamination: float = 0.05) -> DataFrame:
    """D1 with given mean and deviation of each column."""
    from sievefold.operators.detectors import EPSILON, normal_quantile

    zs = [F.abs(F.col(c) - m) / (s + EPSILON) for c, (m, s) in stats.items()]
    score = F.greatest(*zs) if len(zs) > 1 else zs[0]
    return df.withColumn("score", score).withColumn("vote", (score > normal_quantile(1 - contamination)).cast("int"))


def run_to_table(stream: DataFrame, scratch: Scratch, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and reads back what it wrote.

    Progress and state are kept in ``scratch``, so a lost driver or executor goes on from the last
    batch. In ``complete`` mode, for aggregates of bounded size, each batch replaces the table.
    """
    path = scratch.new(name)
    sink = stream.writeStream.option("checkpointLocation", scratch.new(f"{name}-progress")).trigger(availableNow=True)
    if mode == "complete":
        query = sink.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    else:
        query = sink.outputMode(mode).format("parquet").start(path)
    query.awaitTermination()
    return scratch.read(path, stream.schema)

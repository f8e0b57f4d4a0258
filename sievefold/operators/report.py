"""Reports over flagged records and routing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_counts(df: DataFrame, array: str, name: str, k: int) -> DataFrame:
    """Most common elements, ties by name; a top-k report."""
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def confidence_by_method(df: DataFrame) -> DataFrame:
    """A14."""
    return df.select(F.explode("agreeing_methods").alias("method"), "confidence_score").groupBy("method").agg(F.avg("confidence_score").alias("avg_confidence"), F.count("*").alias("n"))


def confidence_buckets(df: DataFrame) -> DataFrame:
    """A15."""
    c, n = F.col("confidence_score"), F.count("*")
    return df.agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"), F.round(100 * F.count_if(c >= 0.8) / n, 4).alias("high_pct"))


def confidence_stats(df: DataFrame) -> DataFrame:
    """Mean, deviation, extremes, and counts with either high limit."""
    c = F.col("confidence_score")
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"), F.count_if(c > 0.8).alias("n_above"), F.count_if(c >= 0.8).alias("n_from"), F.avg("num_agreeing_methods").alias("mean_agreeing"))


def overlap(found: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Detection rate is null for an empty flagged set."""
    both = found.select(key).distinct().join(flagged.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_both"))
    n = flagged.agg(F.countDistinct(key).alias("n_flagged"))
    m = found.agg(F.countDistinct(key).alias("n_found"))
    return both.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(m)).withColumn("rate", F.try_divide("n_both", "n_flagged"))


def removal(df: DataFrame, removed: Column) -> DataFrame:
    """A20."""
    return df.agg(F.count("*").alias("n_original"), F.count_if(removed).alias("n_removed"), F.count_if(~removed).alias("n_clean"), F.round(100 * F.try_divide(F.count_if(removed), F.count("*")), 4).alias("removal_rate"))


def anomaly_share(df: DataFrame, flag: Column, by: str) -> DataFrame:
    """A12."""
    return df.groupBy(by).agg(F.sum(flag.cast("int")).alias("n_anomaly"), (100 * F.avg(flag.cast("int"))).alias("anomaly_pct"))


def roll_up(frames: DataFrame) -> DataFrame:
    """Over (file, column_name, n, n_anomaly); ties of the largest share go to the greater name."""
    return frames.agg(
        F.countDistinct("file").alias("n_files"),
        F.count("*").alias("n_columns"),
        F.sum("n").alias("n_points"),
        F.sum("n_anomaly").alias("n_anomalies"),
        F.round(100 * F.sum("n_anomaly") / F.sum("n"), 4).alias("anomaly_pct"),
        F.max_by("column_name", F.struct(F.col("n_anomaly") / F.col("n"), "column_name")).alias("worst_column"),
    )


def grouped_values(flagged: DataFrame, part: int | None = 100_000) -> DataFrame:
    """Flagged values and row ids of each column, in order. ``flagged``: column_name, row_id, value.

    A column's values are cut into stretches of ``part`` row ids, each a row with its number, so
    no task gathers a whole column; a reader takes the stretches in order. None gives one row
    a column, for columns with few flagged values.
    """
    cut = flagged.withColumn("part", F.floor(F.col("row_id") / part).cast("long") if part else F.lit(0).cast("long"))
    held = cut.groupBy("column_name", "part").agg(F.sort_array(F.collect_list(F.struct("row_id", "value"))).alias("pairs"))
    return held.select("column_name", "part", F.transform("pairs", lambda p: p["row_id"]).alias("row_ids"), F.transform("pairs", lambda p: p["value"]).alias("vals"))


def audio_summary(tracks: DataFrame, rate: int) -> DataFrame:
    """K6: samples, seconds and flagged values of each column. ``tracks``: column_name, idx, is_flagged."""
    return tracks.groupBy("column_name").agg(F.count("*").alias("n_samples"), F.round(F.count("*") / rate, 4).alias("seconds"), F.count_if("is_flagged").alias("n_anomaly"))


def throughput(rows: int, columns: int, seconds: float) -> dict[str, float | None]:
    """Rows and columns a second; null for no time."""
    return {"rows_per_s": rows / seconds if seconds else None, "columns_per_s": columns / seconds if seconds else None}


def kpis(consensus: DataFrame) -> DataFrame:
    """Rows, anomalies, their share, and the mean confidence among them, in one aggregate. Takes a consensus' result."""
    hit = F.col("is_anomaly")
    return consensus.agg(F.count("*").alias("total_rows"), F.count_if(hit).alias("anomalies"), F.round(100 * F.try_divide(F.count_if(hit), F.count("*")), 4).alias("anomaly_pct"), F.round(100 * F.avg(F.when(hit, F.col("confidence_score"))), 4).alias("confidence_pct"))

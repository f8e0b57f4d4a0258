"""Column discovery and profile statistics. One wide aggregate, then one row is unpivoted."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sievefold.functions.scaling import percentiles


def numeric_columns(df: DataFrame) -> list[str]:
    """P8."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _unpivot(df: DataFrame, stats: dict[str, dict[str, Column]], key: str = "column_name") -> DataFrame:
    """``stats``: column -> name -> aggregate; a row for each column, from one pass."""
    row = df.agg(*[F.struct(*[a.alias(n) for n, a in named.items()]).alias(c) for c, named in stats.items()])
    parts = F.array(*[F.struct(F.lit(c).alias(key), *[F.col(f"`{c}`.{n}").alias(n) for n in named]) for c, named in stats.items()])
    return row.select(F.inline(parts))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, above: int = 2) -> DataFrame:
    """Distinct values of each column, and whether there are more than ``above``.

    One scan: each row becomes a pair for each column, and pairs are made distinct in two steps, of which
    the first runs in the scan's tasks. Nulls are not values; -0.0 and 0.0 are one.
    """
    columns = list(columns or numeric_columns(df))
    floating = lambda c: df.schema[c].dataType.simpleString() in ("double", "float")
    texts = [(F.col(c) + F.lit(0.0) if floating(c) else F.col(c)).cast("string") for c in columns]
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), x.alias("value")) for c, x in zip(columns, texts, strict=True)])))
    found = pairs.distinct().groupBy("column_name").agg(F.count("value").alias("n_unique"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")  # an empty table has no pairs
    return every.join(F.broadcast(found), "column_name", "left").select("column_name", F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique")).withColumn("is_continuous", F.col("n_unique") > above)


def continuous_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns with more than two values, nulls not counted.

    Least and greatest value are one aggregate; a column has more if any value lies
    between, which is one more aggregate over all columns.
    """
    columns = list(columns or numeric_columns(df))
    if not columns:
        return []
    ends = df.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")) for c in columns]).first()
    between = [F.coalesce(F.max((F.col(c) > F.lit(e["low"])) & (F.col(c) < F.lit(e["high"]))), F.lit(False)) for c, e in zip(columns, ends, strict=True)]
    return [c for c, more in zip(columns, df.agg(*between).first(), strict=True) if more]


def skewness(x: str) -> Column:
    """A10: bias-corrected."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: str) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V7: mean, population deviation, extremes, counts, skewness, kurtosis."""
    return _unpivot(
        df,
        {c: {"n": F.count(c), "mean": F.avg(c), "std": F.stddev_pop(c), "low": F.min(c).cast("double"), "high": F.max(c).cast("double"), "skew": skewness(c), "kurt": kurtosis(c)} for c in columns},
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """V2."""
    rows = [(c, q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)) if q1 is not None else (c, *[None] * 4) for c, (q1, q3) in zip(columns, percentiles(df, columns, (0.25, 0.75)), strict=True)]
    return df.sparkSession.createDataFrame(rows, "column_name string, q1 double, q3 double, lower double, upper double")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P19."""
    return _unpivot(df, {c: {"n_null": F.count_if(F.col(c).isNull())} for c in columns})


def covariance_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A4: sample covariance of each pair, in one aggregate."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])))


def histogram(df: DataFrame, column: str, bins: int = 50, density: bool = False) -> DataFrame:
    """Equal bins from least to greatest; the last is closed on the right.

    With ``density`` also each bin's share of the rows over its width; null for a constant column.
    """
    edges = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"), F.count(column).alias("_n"))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(F.col("_high") == F.col("_low"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("_low")) / width), F.lit(bins - 1)))
    out = [F.count("*").alias("n")] + ([F.first(F.try_divide(F.lit(1.0), F.col("_n") * width)).alias("_each")] if density else [])
    got = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(place.cast("int").alias("bin")).agg(*out)
    return got.select("bin", "n", (F.col("n") * F.col("_each")).alias("density")) if density else got


def drop_null_inf(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P11."""
    out = df.dropna("any", subset=list(columns))
    for c in columns:
        out = out.filter(~F.col(c).isin(float("inf"), float("-inf")) & ~F.isnan(F.col(c)))
    return out


def display_value(x: Column, width: int = 30) -> Column:
    """P17."""
    return F.coalesce(F.substring(x.cast("string"), 1, width), F.lit("NULL"))


def missing_issues(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P20: column, issue, confidence in percent and a proposed fix for columns with nulls."""
    stats = _unpivot(df, {c: {"n_null": F.count_if(F.col(c).isNull()), "n": F.count("*")} for c in columns})
    share = F.col("n_null") / F.col("n")
    return stats.filter("n_null > 0").select("column_name", F.lit("missing values").alias("issue"), F.round(100 * share, 1).alias("confidence"), F.lit("impute the median").alias("fix"))


def non_null_count(columns: Sequence[str]) -> Column:
    """A27."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))

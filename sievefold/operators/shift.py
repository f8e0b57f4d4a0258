"""Shift detectors over (row_id, score): which rows stand out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievefold.functions.scaling import percentiles
from sievefold.operators.ordered import ahead, behind, from_parts, in_order, running_sum
from sievefold.sources.store import Scratch


def _with(df: DataFrame, *stats) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def _union(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """T10."""
    return found.select("row_id").union(flagged.select("row_id")).distinct()


def percentile(scores: DataFrame, flagged: DataFrame) -> DataFrame:
    """With flagged rows max(p10 of theirs, p85 of all), else p90 of all."""
    (p10,), (p85, p90) = percentiles(scores.join(flagged.select("row_id"), "row_id", "left_semi"), ["score"], (0.1,))[0], percentiles(scores, ["score"], (0.85, 0.9))[0]
    cut = p90 if p10 is None else max(p10, p85)
    return scores.filter(F.col("score") >= F.lit(cut)).select("row_id")


def guided(scores: DataFrame, flagged: DataFrame, factor: float = 2.0) -> DataFrame:
    """Flagged, and scores from mean + 2 population deviations."""
    t = _with(scores, F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return _union(t.filter(F.col("score") >= F.col("m") + factor * F.col("s")), flagged)


def energy(scores: DataFrame, flagged: DataFrame, threshold: float = 0.8) -> DataFrame:
    """D18."""
    cut = percentiles(scores, ["score"], (threshold,))[0][0]
    return _union(scores.filter(F.col("score") >= F.lit(cut)), flagged)


def outlier(scores: DataFrame, flagged: DataFrame, z: float = 2.5) -> DataFrame:
    """D19."""
    t = _with(scores, F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return _union(t.filter(F.abs(F.col("score") - F.col("m")) / (F.col("s") + 1e-10) >= z), flagged)


def forest(scores: DataFrame, flagged: DataFrame, contamination: float = 0.1) -> DataFrame:
    """D20."""
    from sievefold.operators.forest import fit_score

    t = fit_score(scores, "row_id", ["score"], contamination=contamination, trees=100)
    return _union(t.filter("vote = 1"), flagged)


def dbscan(scores: DataFrame, flagged: DataFrame, min_samples: int = 5, eps: float | None = None, scratch: Scratch | None = None) -> DataFrame:
    """In one dimension. (row_id, is_core, cluster, is_anomaly); cluster is null for noise.

    Scores are standardized and gathered by distinct value, so equal scores
    are one row with a weight. A value's neighbours are the weight up to eps above it less
    the weight below eps under it: two places of one running sum along the order of values
    and of their two ends. Clusters are numbered along the order of values, with what the range
    before ends in; a border takes the nearer core, the lower of two at equal distance.
    All is sorting and sums, so work grows as n log n whatever the values.
    """
    scratch = scratch or Scratch(scores.sparkSession)
    stats = scores.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s0"))
    raw = scores.join(flagged.select("row_id").distinct(), "row_id", "left_semi").agg(F.stddev_pop("score").alias("fs"))
    fixed = F.lit(eps) if eps is not None else F.when(F.col("fs").isNull(), 0.3).otherwise(F.greatest(F.lit(0.1), 0.5 * F.col("fs")))
    params = stats.crossJoin(raw).select("m", F.when(F.col("s0") == 0, 1.0).otherwise(F.col("s0")).alias("s"), fixed.cast("double").alias("eps"))
    x = ((F.col("score") - F.col("m")) / F.col("s") / F.col("eps")).alias("u")
    marks = flagged.select("row_id").distinct().withColumn("is_flagged", F.lit(1))
    t = scratch.table(scores.crossJoin(F.broadcast(params)).select("row_id", x).join(marks, "row_id", "left").withColumn("is_flagged", F.coalesce("is_flagged", F.lit(0))), "scores")
    values = scratch.table(t.groupBy("u").agg(F.count("*").alias("w"), F.sum("is_flagged").alias("f")), "values")

    # at one place the lower ends come before the values and the upper ends after them
    point = lambda at, kind, w: F.struct(at.alias("at"), F.lit(kind).alias("kind"), w.cast("long").alias("w"), F.col("u"))
    u, none = F.col("u"), F.lit(0)
    points = values.select(F.inline(F.array(point(u - 1, 0, none), point(u, 1, F.col("w")), point(u + 1, 2, none))))
    summed = running_sum(in_order(points, ["at", "kind"], scratch), F.col("w"), "total").filter("kind <> 1")
    near = summed.groupBy("u").agg(F.sum(F.when(F.col("kind") == 2, F.col("total")).otherwise(-F.col("total"))).alias("near"))
    counted = in_order(values.join(near, "u").withColumn("core", F.when(F.col("near") >= min_samples, F.col("u"))), ["u"], scratch)

    # a core more than 1 above the core before it starts a cluster
    so_far = ahead().rowsBetween(Window.unboundedPreceding, -1)
    new = (F.col("core") - F.last("core", True).over(so_far) > 1).cast("int")
    gaps = scratch.table(counted.withColumn("new", F.coalesce(new, F.lit(0))), "gaps")
    parts = sorted(tuple(r) for r in gaps.groupBy("_part").agg(F.min("core"), F.max("core"), F.sum("new")).collect())
    left, number = {}, 0
    last: tuple = (None, None)
    for part, low, high, more in parts:
        opens = int(low is not None and last[0] is not None and low - last[0] > 1)
        left[part] = (number + opens, *last)
        number += opens + (more or 0)
        last = (high, number) if high is not None else last
    right, following = {}, (None, None)
    for part, low, _, _ in reversed(parts):
        right[part] = following
        following = (low, left[part][0]) if low is not None else following
    known = {part: (*left[part], *right[part]) for part, *_ in parts}
    inside = from_parts(gaps, known, "base long, lu double, lc long, ru double, rc long")
    inside = inside.withColumn("own", F.when(F.col("core").isNotNull(), F.col("base") + F.sum("new").over(ahead().rowsBetween(Window.unboundedPreceding, 0))))
    held = F.when(F.col("core").isNotNull(), F.struct(F.col("core").alias("u"), F.col("own").alias("c")))
    before = F.coalesce(F.last(held, True).over(ahead().rowsBetween(Window.unboundedPreceding, 0)), F.when(F.col("lu").isNotNull(), F.struct(F.col("lu").alias("u"), F.col("lc").alias("c"))))
    after = F.coalesce(F.last(held, True).over(behind().rowsBetween(Window.unboundedPreceding, 0)), F.when(F.col("ru").isNotNull(), F.struct(F.col("ru").alias("u"), F.col("rc").alias("c"))))
    tied = inside.withColumns({"l": before, "r": after})
    dl, dr = F.coalesce(F.col("u") - F.col("l.u"), F.lit(9.0)), F.coalesce(F.col("r.u") - F.col("u"), F.lit(9.0))
    label = F.when((dl <= 1) & (dl <= dr), F.col("l.c")).when(dr <= 1, F.col("r.c"))
    every = scratch.table(tied.select("u", "w", "f", F.col("core").isNotNull().alias("is_core"), label.alias("cluster")), "labelled")
    ratio = every.filter("cluster is not null").groupBy("cluster").agg((F.sum("f") / F.sum("w")).alias("ratio"))
    judged = every.join(ratio, "cluster", "left").select("u", "is_core", "cluster", (F.col("cluster").isNull() | (F.col("ratio") > 0.3)).alias("is_anomaly"))
    return t.select("row_id", "u").join(judged, "u").select("row_id", "is_core", "cluster", "is_anomaly")


METHODS = {"percentile": percentile, "flagged_guided": guided, "energy_based": energy, "statistical_outlier": outlier, "isolation_forest": forest, "dbscan": lambda s, f: dbscan(s, f).filter("is_anomaly").select("row_id")}


def detect(scores: DataFrame, flagged: DataFrame, method: str) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known are {sorted(METHODS)}")
    return METHODS[method](scores, flagged)


def compare(scores: DataFrame, flagged: DataFrame, methods=tuple(METHODS)) -> DataFrame:
    """D21."""
    from sievefold.operators.report import overlap

    out = None
    for m in methods:
        one = overlap(detect(scores, flagged, m), flagged, "row_id").withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def stats(scores: DataFrame) -> DataFrame:
    """A18."""
    return scores.agg(F.avg("score").alias("mean_shift"), F.stddev_pop("score").alias("std_shift"), F.max("score").alias("max_shift"), F.min("score").alias("min_shift"))


def row_scores(shifts: DataFrame) -> DataFrame:
    """The largest shift over a row's columns."""
    return shifts.groupBy("row_id").agg(F.max("shift").alias("score"))

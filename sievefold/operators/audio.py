"""Columns as signals: resampling, highlights and PCM samples, in SQL functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.functions.scaling import clip, median_impute, minmax, pcm16
from sievefold.operators.joins import cover_counts


@dataclass(frozen=True)
class AudioParams:
    """G1."""

    n: int
    samples: int
    duration: float

    @property
    def ratio(self) -> float:
        return self.n / self.samples


def audio_params(n: int, rate: int = 44_100, min_duration: float = 1.0, max_duration: float | None = None, samples_per_second: int = 100) -> AudioParams:
    duration = max(min_duration, n / samples_per_second)
    if max_duration is not None:
        duration = min(duration, max_duration)
    return AudioParams(n, int(rate * duration), duration)


def lerp(signal: DataFrame, n: int, m: int) -> DataFrame:
    """(idx, value) of n samples stretched to m by linear interpolation.

    Each source sample makes the targets between it and the next one, so no range join is needed.
    """
    nxt = signal.select((F.col("idx") - 1).alias("idx"), F.col("value").alias("after"))
    both = signal.join(nxt, "idx", "left")
    if n == 1 or m == 1:
        return signal.filter("idx = 0").select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).cast("long").alias("idx"), "value")
    step = (n - 1) / (m - 1)
    first = F.ceil(F.col("idx") / F.lit(step) - 1e-9).cast("long")
    last = F.least(F.ceil((F.col("idx") + 1) / F.lit(step) + 1e-9).cast("long"), F.lit(m - 1).cast("long"))
    near = both.select("idx", "value", "after", F.explode(F.sequence(F.greatest(first - 1, F.lit(0).cast("long")), F.greatest(last, first - 1, F.lit(0).cast("long")))).alias("j"))
    pos = F.col("j") * F.lit(float(n - 1)) / F.lit(float(m - 1))
    kept = near.withColumn("pos", pos).filter(F.floor("pos") == F.col("idx"))
    return kept.select(F.col("j").alias("idx"), F.when(F.col("after").isNull(), F.col("value")).otherwise(F.col("value") + (F.col("pos") - F.col("idx")) * (F.col("after") - F.col("value"))).alias("value"))


def bucket_mean(signal: DataFrame, n: int, m: int) -> DataFrame:
    """N samples averaged into m buckets [int(j r), int((j + 1) r)), r = n / m >= 1."""
    r = n / m
    guess = F.floor(F.col("idx") / F.lit(r)).cast("long")
    near = signal.select("idx", "value", F.explode(F.array(guess - 1, guess, guess + 1)).alias("j"))
    inside = (F.col("idx") >= F.floor(F.col("j") * F.lit(r))) & (F.col("idx") < F.least(F.floor((F.col("j") + 1) * F.lit(r)), F.lit(n)))
    return near.filter((F.col("j") >= 0) & (F.col("j") < m) & inside).groupBy(F.col("j").alias("idx")).agg(F.avg("value").alias("value"))


def resample(signal: DataFrame, p: AudioParams) -> DataFrame:
    return lerp(signal, p.n, p.samples) if p.ratio < 1 else bucket_mean(signal, p.n, p.samples)


def track(df: DataFrame, row_id: str, column: str, p: AudioParams) -> DataFrame:
    """(idx, value, pcm) of a numeric column."""
    filled = median_impute(df.select(F.col(row_id).alias("idx"), F.col(column).cast("double").alias("raw")), ["raw"])
    scaled = minmax(filled, "raw", "value").select("idx", "value")
    return resample(scaled, p).select("idx", clip(F.col("value")).alias("value")).withColumn("pcm", pcm16(F.col("value")))


def highlight_regions(flagged: DataFrame, n: int, length: int) -> DataFrame:
    """Windows around flagged rows, on the samples."""
    width = max(1, length // 200)
    at = (F.col("row_id") / F.lit(n) * F.lit(length)).cast("long")
    return flagged.select((at - width // 2).alias("start"), (at + width // 2).alias("end"))


def highlight(signal: DataFrame, flagged: DataFrame, n: int, length: int, factor: float = 2.0) -> DataFrame:
    """Clipped value times factor to the number of covering windows."""
    covers = cover_counts(highlight_regions(flagged, n, length), 0, length)
    joined = signal.join(covers, "idx", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return joined.withColumn("value", clip(F.col("value") * F.pow(F.lit(factor), F.col("k"))))


def anomaly_track(flagged_values: DataFrame, rate: int, min_duration: float, samples_per_second: int) -> DataFrame | None:
    """(idx, value) of flagged values alone; none for fewer than two. ``flagged_values``: idx, value."""
    n = flagged_values.count()
    if n < 2:
        return None
    p = audio_params(n, rate, min_duration, None, samples_per_second)
    scaled = minmax(flagged_values.withColumnRenamed("value", "raw"), "raw", "value").select("idx", "value")
    return resample(scaled, p).select("idx", clip(F.col("value")).alias("value"))


def map_to_rows(shifts: DataFrame, n: int, length: int) -> DataFrame:
    """``shifts`` (idx, shift) of ``length`` samples averaged around each of n rows' places.

    A sample reaches the rows within half a window of it, so each sample goes to
    few rows and one grouped mean follows; no ordered window over all samples.
    """
    half = max(length // n, 1) // 2
    first = F.floor((F.col("idx") - half) * F.lit(n) / F.lit(length)).cast("long") - 1
    last = F.ceil((F.col("idx") + half + 1) * F.lit(n) / F.lit(length)).cast("long") + 1
    near = shifts.select("idx", "shift", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), F.least(last, F.lit(n - 1).cast("long")))).alias("row_id"))
    at = F.floor(F.col("row_id") * F.lit(length) / F.lit(n)).cast("long")
    inside = (F.col("idx") >= at - half) & (F.col("idx") <= at + half)
    return near.filter(inside).groupBy("row_id").agg(F.avg("shift").alias("shift"))

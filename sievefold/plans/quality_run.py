"""The whole run: limit, route, detect, sonify, filter, clean."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.operators import audio, rules, shift, spectral
from sievefold.operators.detectors import ConsensusDetector
from sievefold.operators.joins import union_all, without_flagged
from sievefold.operators.rowid import limit_lines, with_row_id


@dataclass(frozen=True)
class QualityRun:
    """``key`` is a dense row id of the input."""

    columns: Sequence[str]
    rules: Sequence[rules.Rule]
    key: str = "row_id"
    lines: int | None = None
    rate: int = 100
    samples_per_second: int = 100
    method: str = "percentile"

    def route(self, df: DataFrame) -> DataFrame:
        return rules.route(limit_lines(df, self.key, self.lines) if self.lines else df, self.rules)

    def flagged(self, df: DataFrame) -> DataFrame:
        return ConsensusDetector().transform(df, self.key, self.columns).filter("is_anomaly").select(F.col(self.key).alias("row_id"), "confidence_score", "agreeing_methods")

    def scores(self, df: DataFrame, flagged: DataFrame) -> DataFrame:
        """Shift score of each row: the largest over the columns that have both tracks."""
        n = df.count()
        p = audio.audio_params(n, self.rate, 1.0, None, self.samples_per_second)
        signals, noise = [], []
        for c in self.columns:
            signals.append(audio.track(df, self.key, c, p).select(F.lit(c).alias("column_name"), "idx", "value"))
            own = flagged.select("row_id").join(df.select(F.col(self.key).alias("row_id"), F.col(c).cast("double").alias("value")), "row_id")
            at = with_row_id(own, ["row_id"], "idx").select("idx", "value")
            made = audio.anomaly_track(at, self.rate, 1.0, self.samples_per_second)
            if made is not None:
                noise.append(made.select(F.lit(c).alias("column_name"), "idx", "value"))
        # both tracks are cut to the shorter, and its shifts are stretched over all rows
        length = min(p.samples, audio.audio_params(flagged.count(), self.rate, 1.0, None, self.samples_per_second).samples)
        if not noise:
            return df.select(F.col(self.key).alias("row_id"), F.lit(0.0).alias("score"))
        shifts = spectral.filter_columns(union_all(signals), union_all(noise)).select("column_name", "idx", F.col("shift"))
        rows = union_all([audio.map_to_rows(shifts.filter(F.col("column_name") == c), n, length) for c in self.columns])
        return shift.row_scores(rows)

    def clean(self, df: DataFrame, scores: DataFrame, flagged: DataFrame) -> DataFrame:
        found = shift.detect(scores, flagged, self.method)
        return without_flagged(df, found.withColumnRenamed("row_id", self.key), self.key)

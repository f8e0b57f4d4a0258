"""Anomaly detectors and their consensus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievefold.functions.scaling import median_impute, percentiles, robust_scale, standard_scale, with_stats
from sievefold.operators.envelopes import covariance, envelope, mahalanobis_score, one_class
from sievefold.operators.forest import Forest, fit_forests, fit_score
from sievefold.operators.neighbours import NearestRules, knn, lof, lof_and_knn
from sievefold.operators.rowid import chunk_id
from sievefold.sources.store import Scratch

EPSILON = 1e-8


def normal_quantile(p: float) -> float:
    """F24."""
    return NormalDist().inv_cdf(p)


def zscore(df: DataFrame, key: str, columns: Sequence[str], contamination: float = 0.05) -> DataFrame:
    """Largest |z| of raw columns against a one-sided quantile."""
    stats = [s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    zs = [F.abs(F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + EPSILON) for c in columns]
    score = F.greatest(*zs) if len(zs) > 1 else zs[0]
    return with_stats(df, *stats).select(key, score.alias("score"), (score > normal_quantile(1 - contamination)).cast("int").alias("vote"))


def mahalanobis(df: DataFrame, key: str, columns: Sequence[str], contamination: float = 0.05, chunk: int = 300) -> DataFrame:
    """Distance on raw columns; a vote is above its chunk's quantile. ``key`` must be a dense row id."""
    means, cov = covariance(df, columns)
    score = mahalanobis_score(columns, means, np.linalg.pinv(cov))
    w = Window.partitionBy("chunk_id")
    scored = df.select(key, chunk_id(F.col(key), chunk).alias("chunk_id"), score.alias("score"))
    return scored.select(key, "chunk_id", "score", (F.col("score") > F.percentile("score", F.lit(1 - contamination)).over(w)).cast("int").alias("vote"))


# morphology --------------------------------------------------------------


def _shifted(img: np.ndarray, fill) -> list[np.ndarray]:
    h, w = img.shape[1:]
    padded = np.pad(img, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
    return [padded[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def erode(img: np.ndarray) -> np.ndarray:
    return np.minimum.reduce(_shifted(img, 255))


def dilate(img: np.ndarray) -> np.ndarray:
    return np.maximum.reduce(_shifted(img, 0))


def morphology_features(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Nine features of each row; few columns give plain statistics."""
    n, k = x.shape
    if k == 1:
        return x.copy()
    if k < 4:
        return np.column_stack([x.mean(1), x.std(1), x.min(1), x.max(1), np.zeros((n, 5))])
    side = int(np.sqrt(k))
    scaled = np.zeros_like(x) if high == low else 255 * (x - low) / (high - low)
    img = np.clip(scaled, 0, 255).astype(np.int64)[:, : side * side].reshape(n, side, side)
    opened, closed = dilate(erode(img)), erode(dilate(img))
    grad = dilate(img) - erode(img)
    flat = lambda a: a.reshape(n, -1)
    return np.column_stack([flat(opened).mean(1), flat(opened).std(1), flat(closed).mean(1), flat(closed).std(1), flat(grad).mean(1), flat(grad).std(1), (flat(grad) > 0).sum(1), flat(img - opened).mean(1), flat((img - closed) % 256).mean(1)])


def row_statistics(x: np.ndarray) -> np.ndarray:
    """Mean, deviation, median, biased skewness and kurtosis, quartiles, ups and downs."""
    mean, std = x.mean(1), x.std(1)
    z = (x - mean[:, None]) / np.where(std == 0, 1, std)[:, None]
    steps = np.diff(x, axis=1)
    return np.column_stack([mean, std, np.median(x, 1), (z**3).mean(1), np.where(std == 0, 0, (z**4).mean(1) - 3), np.percentile(x, 25, 1), np.percentile(x, 75, 1), (steps > 0).sum(1), (steps < 0).sum(1)])


def feature_moments(df: DataFrame, columns: Sequence[str], low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the features of all rows as images of one range.

    A task sends one row: its count, means and sums of squared differences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                f = morphology_features(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]), low, high)
                n, mean, spread = _joined((n, mean, spread), (len(f), f.mean(0), ((f - f.mean(0)) ** 2).sum(0)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean]), pa.array([spread])], names=["n", "mean", "spread"])

    n, mean, spread = 0, np.zeros(9), np.zeros(9)
    parts = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "n long, mean array<double>, spread array<double>")
    for r in parts.collect():  # a row for each task
        n, mean, spread = _joined((n, mean if n else 0.0, spread if n else 0.0), (r["n"], np.array(r["mean"]), np.array(r["spread"])))
    return mean, np.sqrt(spread / max(n, 1))


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, means and squared differences of two sets together."""
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + step**2 * (a[0] * b[0] / n)


def morphology(df: DataFrame, key: str, columns: Sequence[str], contamination: float = 0.05, chunk: int = 300) -> DataFrame:
    """D3, Q6: features within a chunk's own range, against those of all rows within their range. Columns should be standardized."""
    ends = df.agg(*[f(c) for c in columns for f in (F.min, F.max)]).first()
    low, high = (min(ends), max(ends)) if ends[0] is not None else (0.0, 0.0)
    mean, std = feature_moments(df, columns, low, high)
    cut = normal_quantile(1 - contamination)

    def run(pdf):
        m = pdf[list(columns)].to_numpy(float)
        f = morphology_features(m, m.min(), m.max())
        score = (np.abs(f - mean) / (std + EPSILON)).max(1)
        return pdf[[key]].assign(score=score, vote=(score > cut).astype("int32"))

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *columns, chunk_id(F.col(key), chunk).alias("chunk_id")).groupBy("chunk_id").applyInPandas(run, f"{key} {kind}, score double, vote int")


def _features(df: DataFrame, key: str, columns: Sequence[str], chunk: int, of) -> DataFrame:
    """(key, features): ``of`` maps one chunk's matrix to a row of features for each of its rows."""

    def run(pdf):
        return pdf[[key]].assign(features=list(of(pdf[list(columns)].to_numpy(float))))

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *columns, chunk_id(F.col(key), chunk).alias("chunk_id")).groupBy("chunk_id").applyInPandas(run, f"{key} {kind}, features array<double>")


def morphology_rows(df: DataFrame, key: str, columns: Sequence[str], chunk: int = 300) -> DataFrame:
    """V5, V6: the features of each row as an image, scaled by its chunk's range."""
    return _features(df, key, columns, chunk, lambda x: morphology_features(x, x.min(), x.max()))


def statistics_rows(df: DataFrame, key: str, columns: Sequence[str], chunk: int = 300) -> DataFrame:
    """D12."""
    return _features(df, key, columns, chunk, row_statistics)


# consensus ---------------------------------------------------------------


def consensus(votes: DataFrame, methods: Sequence[str], threshold: float = 0.6, min_votes: int = 2) -> DataFrame:
    """``votes`` has one 0/1 column for each method; a null vote leaves its method out."""
    given = sum((F.col(m).isNotNull().cast("int") for m in methods), F.lit(0))
    agreeing = F.array_compact(F.array(*[F.when(F.col(m) == 1, F.lit(m)) for m in methods]))
    out = votes.withColumn("agreeing_methods", agreeing).withColumn("num_agreeing_methods", F.size("agreeing_methods"))
    out = out.withColumn("confidence_score", F.coalesce(F.try_divide(F.col("num_agreeing_methods").cast("double"), given), F.lit(0.0)))
    return out.withColumn("is_anomaly", (F.col("num_agreeing_methods") >= min_votes) & (F.col("confidence_score") >= threshold))


def outlier_columns(df: DataFrame, key: str, columns: Sequence[str], chunk: int = 300, limit: float = 2.0) -> DataFrame:
    """Columns whose |z| in the row's chunk is above the limit; sample deviation."""
    w = Window.partitionBy("chunk_id")
    out = df.select(key, *columns, chunk_id(F.col(key), chunk).alias("chunk_id"))
    z = {c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + EPSILON) for c in columns}
    out = out.withColumns({f"_z_{c}": F.abs(e) for c, e in z.items()})
    scores = F.array_compact(F.array(*[F.when(F.col(f"_z_{c}") > limit, F.struct(F.lit(c).alias("name"), F.col(f"_z_{c}").alias("z"))) for c in columns]))
    return out.select(key, "chunk_id", F.transform(scores, lambda s: s["name"]).alias("flagged_columns"), F.map_from_entries(scores).alias("anomaly_scores"))


REGISTRY = {"isolation_forest": fit_score, "zscore": zscore, "mahalanobis": mahalanobis, "morphological": morphology, "lof": lof, "ocsvm": one_class, "knn": knn, "elliptic": envelope}
EFFECTIVE4 = ("isolation_forest", "zscore", "mahalanobis", "morphological")


@dataclass
class ChunkScores:
    """What scoring whole chunks by the four effective methods needs, all from all rows."""

    contamination: float
    mean: np.ndarray
    std: np.ndarray
    inverse: np.ndarray
    model: Forest | None
    features: tuple[np.ndarray, np.ndarray]

    @classmethod
    def fit(cls, df: DataFrame, key: str, columns: Sequence[str], contamination: float, trees: int = 50, seed: int = 42) -> ChunkScores:
        """One aggregate, one shuffle of the trees' rows, one pass for the features. Q4: models are trained and applied in standardized space."""
        k = len(columns)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        kinds = [f(c) for f in (F.avg, F.stddev_pop, F.min, F.max) for c in columns]
        *row, n = df.agg(*kinds, *[F.covar_samp(columns[i], columns[j]) for i, j in pairs], F.count("*")).first()
        mean, std, low, high = (np.array([v or 0.0 for v in row[at : at + k]], float) for at in range(0, 4 * k, k))
        cov = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[4 * k :], strict=True):
            cov[i, j] = cov[j, i] = v or 0.0
        unit = np.where(std == 0, 1, std)
        scaled = df.select(key, *[((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(columns, mean, unit, strict=True)])
        model = fit_forests(scaled, key, {"all": columns}, trees, seed, n=n).get("all")
        features = feature_moments(scaled, columns, float(((low - mean) / unit).min()), float(((high - mean) / unit).max()))
        return cls(contamination, mean, std, np.linalg.pinv(cov), model, features)

    def lone(self, x: np.ndarray) -> np.ndarray:
        """The forest's scores."""
        return self.model.score((x - self.mean) / np.where(self.std == 0, 1, self.std))

    def __call__(self, x: np.ndarray, ends: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """(scores, votes) of each method; ``ends`` says where the chunks of the rows end. The forest's votes need all scores."""
        limit, d = normal_quantile(1 - self.contamination), x - self.mean
        z = (np.abs(d) / (self.std + EPSILON)).max(1)
        far = np.sqrt(np.maximum(((d @ self.inverse) * d).sum(1), 0))
        scaled = d / np.where(self.std == 0, 1, self.std)
        lone = self.model.score(scaled)
        far_vote, odd = np.zeros(len(x), np.int32), np.zeros(len(x))
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            far_vote[a:b] = far[a:b] > np.percentile(far[a:b], 100 * (1 - self.contamination))
            f = morphology_features(scaled[a:b], scaled[a:b].min(), scaled[a:b].max())
            odd[a:b] = (np.abs(f - self.features[0]) / (self.features[1] + EPSILON)).max(1)
        return {"isolation_forest": (lone, np.zeros(len(x))), "zscore": (z, z > limit), "mahalanobis": (far, far_vote), "morphological": (odd, odd > limit)}


def chunk_votes(df: DataFrame, key: str, columns: Sequence[str], methods: Sequence[str] = EFFECTIVE4, contamination: float = 0.05, chunk: int = 300, scratch: Scratch | None = None) -> DataFrame:
    """(key, a vote for each method, method_specific_scores) of the effective methods in one pass.

    Rows are shuffled once, by chunk, and stream through a task chunk after chunk; all
    scores of a row are taken together. They are written, since the forest's limit is a quantile of all
    rows' scores. ``key`` is a dense row id, and columns hold no nulls.
    """
    scratch = scratch or Scratch(df.sparkSession)
    score = ChunkScores.fit(df, key, columns, contamination)
    names = sorted(methods)

    def out(ids: pa.Array, x: np.ndarray, chunks: np.ndarray) -> pa.RecordBatch:
        ends = np.r_[np.flatnonzero(chunks[1:] != chunks[:-1]) + 1, len(chunks)]
        found = score(x, ends)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(np.asarray(found[m][1], np.int32)) for m in methods), *(pa.array(found[m][0]) for m in names)], names=[key, *methods, *(f"score_{m}" for m in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(cut: int | None) -> Iterator[pa.RecordBatch]:
            """The rows held, but for the last chunk, which may go on in the next batch."""
            nonlocal held
            rows = pa.Table.from_batches(held).combine_chunks()
            chunks = rows.column("chunk_id").to_numpy()
            n = len(chunks) if cut is None else int(np.searchsorted(chunks, cut))
            if n:
                part = rows.slice(0, n)
                yield out(part.column(key).combine_chunks(), np.column_stack([part.column(c).to_numpy() for c in columns]), chunks[:n])
            held = rows.slice(n).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from whole(batch.column("chunk_id")[-1].as_py())
        if held:
            yield from whole(None)

    kind = df.schema[key].dataType.simpleString()
    dealt = df.select(key, *columns, chunk_id(F.col(key), chunk).alias("chunk_id")).repartition("chunk_id").sortWithinPartitions("chunk_id")
    found = dealt.mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{m} int" for m in methods), *(f"score_{m} double" for m in names)]))
    found = scratch.table(found, "votes")
    if "isolation_forest" in methods:
        cut = percentiles(found, ["score_isolation_forest"], [1 - contamination])[0][0]
        found = found.withColumn("isolation_forest", (F.col("score_isolation_forest") > F.lit(cut).cast("double")).cast("int"))
    scores = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"score_{m}") for m in names]))
    return found.select(key, *methods, scores.alias("method_specific_scores"))


@dataclass(frozen=True)
class ConsensusDetector:
    """Imputes, scales where a method wants it, votes and explains. ``key`` is a dense row id.

    The four effective methods are scored in one pass by chunk. Others are scored each
    on their own; their votes meet in one shuffle on the key.
    """

    methods: tuple[str, ...] = EFFECTIVE4
    contamination: float = 0.05
    confidence_threshold: float = 0.6
    min_votes: int = 2

    def votes(self, df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
        raw = median_impute(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]), columns)
        effective, others = ([m for m in self.methods if (m in EFFECTIVE4) == own] for own in (True, False))
        together = chunk_votes(raw, key, columns, effective, self.contamination) if effective else None
        if not others:
            return together
        scaled = standard_scale(raw, columns).select(key, *[F.col(f"{c}_std").alias(c) for c in columns])
        robust = robust_scale(raw, columns).select(key, *[F.col(f"{c}_robust").alias(c) for c in columns])
        space = {"ocsvm": scaled, "elliptic": scaled, "lof": robust, "knn": robust}
        every, found = None, {}
        if {"lof", "knn"} <= set(others) and len(columns) <= NearestRules.boxes:
            found = dict(zip(("lof", "knn"), lof_and_knn(robust, key, columns, contamination=self.contamination), strict=True))
        for m in others:
            one = found[m] if m in found else REGISTRY[m](space[m], key, columns, contamination=self.contamination)
            one = one.select(key, F.lit(m).alias("method"), "score", "vote")
            every = one if every is None else every.unionByName(one)
        wide = [F.max(F.when(F.col("method") == m, F.col("vote"))).alias(m) for m in others]
        apart = every.groupBy(key).agg(*wide, F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "score")))).alias("own_scores"))
        if not effective:
            return apart.withColumnRenamed("own_scores", "method_specific_scores")
        both = together.join(apart, key)
        return both.select(key, *self.methods, F.map_concat("method_specific_scores", "own_scores").alias("method_specific_scores"))

    def transform(self, df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
        return consensus(self.votes(df, key, columns), self.methods, self.confidence_threshold, self.min_votes)

    def flagged(self, df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
        """Flagged records with explanation and the source row."""
        found = self.transform(df, key, columns).filter("is_anomaly")
        why = outlier_columns(df, key, columns)
        data = df.select(key, F.struct(*df.columns).alias("data"))
        return found.join(why, key).join(data, key).withColumn("anomaly_type", F.lit("multi_method_consensus")).withColumnRenamed(key, "row_index")

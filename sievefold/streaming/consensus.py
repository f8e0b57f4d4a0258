"""The four-method consensus on a stream: statistics that a batch left, votes chunk by chunk as chunks fill."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievefold.functions.scaling import percentiles
from sievefold.operators.detectors import EFFECTIVE4, ChunkScores, consensus
from sievefold.operators.forest import Forest
from sievefold.operators.rowid import chunk_id
from sievefold.sources.store import Scratch

#: Of a chunk: the places in it of rows that came (32 bits each), their values until they are voted on, and then its limit.
STATE = "places binary, x binary, limit double"


@dataclass
class Frozen:
    """What a batch leaves to a stream: models, the forest's limit and the number of rows, as two small tables."""

    scores: ChunkScores
    limit: float
    rows: int

    @classmethod
    def fit(cls, df: DataFrame, key: str, columns: Sequence[str], contamination: float = 0.05) -> Frozen:
        """From all rows of a batch. ``key`` is a dense row id and columns hold no nulls.

        The forest's limit needs its scores only: one narrow pass, whose scores are written.
        """
        wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
        scores = ChunkScores.fit(wide, key, columns, contamination)
        if scores.model is None:
            return cls(scores, 0.0, 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                    yield pa.RecordBatch.from_arrays([pa.array(scores.lone(x))], names=["score"])

        scratch = Scratch(df.sparkSession)
        lone = scratch.table(wide.select(*columns).mapInArrow(run, "score double"), "lone")
        frozen = cls(scores, percentiles(lone, ["score"], [1 - contamination])[0][0], lone.count())
        scratch.drop()
        return frozen

    def save(self, spark: SparkSession, path: str) -> None:
        s, f = self.scores, self.scores.model
        lists = [a.ravel().tolist() for a in (s.mean, s.std, s.inverse, s.features[0], s.features[1])]
        numbers = spark.createDataFrame([(s.contamination, self.limit, self.rows, f.psi if f else 0, len(f.feature) if f else 0, *lists)], "contamination double, limit double, rows long, psi int, trees int, mean array<double>, std array<double>, inverse array<double>, feature_mean array<double>, feature_std array<double>")
        numbers.write.parquet(f"{path}/numbers")
        nodes = [] if f is None else [(t, n, int(f.feature[t, n]), float(f.threshold[t, n]), float(f.depth[t, n])) for t in range(len(f.feature)) for n in range(1, f.feature.shape[1])]
        spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, depth double").write.parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Frozen:
        r = spark.read.parquet(f"{path}/numbers").first()
        k = len(r["mean"])
        nodes = spark.read.parquet(f"{path}/nodes").collect()  # trees * 511 rows at most
        model = Forest.of([(n["tree"], n["node"], None if n["feature"] < 0 else n["feature"], n["threshold"], n["depth"]) for n in nodes], r["trees"], r["psi"]) if r["trees"] else None
        scores = ChunkScores(r["contamination"], np.array(r["mean"]), np.array(r["std"]), np.array(r["inverse"]).reshape(k, k), model, (np.array(r["feature_mean"]), np.array(r["feature_std"])))
        return cls(scores, r["limit"], r["rows"])


def stream_consensus(stream: DataFrame, key: str, columns: Sequence[str], frozen: Frozen, chunk: int = 300, wait: int | None = None, threshold: float = 0.6, min_votes: int = 2) -> DataFrame:
    """(key, a vote for each method, agreement) of each row of a stream, in append mode.

    A chunk's rows wait in state keyed by chunk until all are there, which the batch's number of rows says of the last one too; then
    they are voted on together, as a batch would. ``wait`` milliseconds without a new row end a chunk that
    isn't full. Rows that come after that are voted on by the chunk's own limit, which stays in
    state; a row sent twice counts once. State is bounded by a chunk's rows. Columns hold no nulls.
    """
    scores, names = frozen.scores, list(EFFECTIVE4)
    kind = ", ".join([f"{key} long", *(f"{m} int" for m in names)])

    def voted(ids: np.ndarray, x: np.ndarray, limit: float | None) -> tuple[pd.DataFrame, float]:
        found = scores(x, np.array([len(x)]))
        far = found["mahalanobis"][0]
        limit = float(np.percentile(far, 100 * (1 - scores.contamination))) if limit is None else limit
        votes = {m: np.asarray(v[1], np.int32) for m, v in found.items()}
        votes["mahalanobis"] = (far > limit).astype(np.int32)
        votes["isolation_forest"] = (found["isolation_forest"][0] > frozen.limit).astype(np.int32)
        return pd.DataFrame({key: ids, **{m: votes[m] for m in names}}), limit

    def step(at: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = at[0] * chunk
        held, flat, limit = state.get if state.exists else (b"", b"", None)
        known, x = np.frombuffer(bytes(held), np.uint32), np.frombuffer(bytes(flat), float).reshape(-1, len(columns))
        if state.hasTimedOut:
            out, limit = voted(first + known.astype(np.int64), x, limit)
            state.update((known.tobytes(), b"", limit))
            yield out
            return
        before, values = len(known), [x]
        for pdf in frames:
            places = (pdf[key].to_numpy(np.int64) - first).astype(np.uint32)
            own, where = np.unique(places, return_index=True)
            where = np.sort(where[~np.isin(own, known)])
            known = np.concatenate([known, places[where]])
            values.append(pdf[list(columns)].to_numpy(float)[where])
        x = np.concatenate(values)
        expected = min(chunk, frozen.rows - first) if first < frozen.rows else chunk
        if limit is not None:  # late rows of a chunk that was voted on
            if len(x):
                yield voted(first + known[before:].astype(np.int64), x, limit)[0]
            x = x[:0]
        elif len(known) >= expected:
            out, limit = voted(first + known.astype(np.int64), x, None)
            x = x[:0]
            yield out
        state.update((known.tobytes(), x.tobytes(), limit))
        if wait and limit is None:
            state.setTimeoutDuration(wait)

    rows = stream.select(chunk_id(F.col(key), chunk).alias("chunk_id"), F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in columns])
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return consensus(rows.groupBy("chunk_id").applyInPandasWithState(step, kind, STATE, "append", timeout), names, threshold, min_votes)


def append_flagged(path: str):
    """K2: a sink that writes each batch's flagged rows as JSON lines in a folder of its own number; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.filter("is_anomaly").write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def run_consensus(stream: DataFrame, key: str, columns: Sequence[str], frozen: Frozen, path: str, progress: str, **more) -> None:
    """Votes on what there is now and appends flagged rows; ``progress`` keeps offsets and state, so the next run goes on from there."""
    votes = stream_consensus(stream, key, columns, frozen, **more)
    votes.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(append_flagged(path)).start().awaitTermination()

"""Plots from bins, and the consensus on a stream with late and repeated rows and restarts."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievefold.operators import detectors, plots
from sievefold.streaming import consensus as streaming

# plots ------------------------------------------------------------------------


def pixels(png: bytes) -> np.ndarray:
    """An RGB picture of 8 bits, read back."""
    width, height = struct.unpack(">2I", png[16:24])
    at, data = 8, b""
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        data += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 3 * width)
    return rows[:, 1:].reshape(height, width, 3)


@pytest.fixture(scope="module")
def scattered(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(500, 0.5), rng.random(1000)])  # a third in one bin
    y = np.concatenate([np.full(500, -3.0), rng.normal(size=1000)])
    rows = [(float(a), float(b), bool(k % 50 == 0)) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame([*rows, (None, 1.0, True), (1.0, float("nan"), True), (float("inf"), 0.0, True)], "x double, y double, f boolean")
    return frame, x, y


def test_every_level_adds_up(scattered):
    frame, x, y = scattered
    got = plots.pyramid(frame, "x", "y", 5, F.col("f")).collect()
    for level in range(6):
        side = 1 << level
        at = lambda v: np.minimum((v - v.min()) / (v.max() - v.min()) * 32, 31).astype(int) >> (5 - level)  # noqa: B023, E731
        want = np.zeros((side, side), int)
        np.add.at(want, (at(x), at(y)), 1)
        own = np.zeros((side, side), int)
        for r in got:
            if r["level"] == level:
                own[r["bin_x"], r["bin_y"]] += r["n"]
        assert (own == want).all()
        assert sum(r["n_flagged"] for r in got if r["level"] == level) == 30
    assert plots.pyramid(frame.limit(0), "x", "y", 3).count() == 0
    assert plots.pyramid(frame.filter("x = 0.5 AND y = -3"), "x", "y", 2).filter("bin_x = 0 AND bin_y = 0 AND n = 500").count() == 3
    assert all(abs(r[0] - 1) < 1e-9 for r in plots.shares(plots.pyramid(frame, "x", "y", 3)).groupBy("level").agg(F.sum("share")).select("sum(share)").collect())


def test_tiles_show_their_bins(scattered):
    frame, _, _ = scattered
    bins = plots.pyramid(frame, "x", "y", 5, F.col("f"))
    held = {(r["bin_x"], r["bin_y"]): r for r in bins.filter("level = 5").collect()}
    made = {(r["tx"], r["ty"]): pixels(bytes(r["png"])) for r in plots.tiles(bins, 5, 8).collect()}
    assert set(made) == {(a // 8, b // 8) for a, b in held}
    for (tx, ty), picture in made.items():
        assert picture.shape == (8, 8, 3)
        for px in range(8):
            for py in range(8):
                r, shown = held.get((tx * 8 + px, ty * 8 + py)), picture[7 - py, px]
                assert (shown == 255).all() if r is None else (shown[1] < 255 and (shown[0] == 255) == (r["n_flagged"] > 0))
    fullest = max(held, key=lambda b: held[b]["n"])
    assert made[fullest[0] // 8, fullest[1] // 8][7 - fullest[1] % 8, fullest[0] % 8][1] == min(p[..., 1].min() for p in made.values())


def test_bars(spark):
    counts = spark.createDataFrame([("b", 50), ("a", 100), ("c", None), ("d", 0), ("e", -5)], "label string, n int")
    r = plots.bars(counts, "label", "n", height=20, width=4).first()
    picture = pixels(bytes(r["png"]))
    assert r["n"] == 5 and picture.shape == (20, 20, 3)
    assert [(picture[:, 4 * k, 0] < 255).sum() for k in range(5)] == [20, 10, 0, 0, 0]
    with pytest.raises(Exception, match="more than 3 bars"):
        plots.bars(counts, "label", "n", most=3).collect()
    assert plots.bars(counts.limit(0), "label", "n").first()["n"] == 0


# streams ----------------------------------------------------------------------

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def batch(spark):
    """1,000 rows, so that chunks of 300 end with one of 100."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1000, 2))
    x[::97] *= 6
    return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "row_id long, a double, b double").persist()


def votes_of(frame):
    return {r["row_id"]: tuple(r[m] for m in detectors.EFFECTIVE4) for r in frame.collect()}


class Run:
    """A stream over a folder that files come into, with one checkpoint."""

    def __init__(self, spark, batch, tmp_path, **more):
        self.spark, self.more = spark, more
        self.path, self.out, self.progress = (f"file://{tmp_path}/{n}" for n in ("in", "out", "progress"))
        streaming.Frozen.fit(batch, "row_id", COLUMNS).save(spark, f"file://{tmp_path}/frozen")
        self.frozen = streaming.Frozen.load(spark, f"file://{tmp_path}/frozen")
        self.schema = batch.schema

    def add(self, frame):
        frame.coalesce(1).write.mode("append").parquet(self.path)

    def go(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)
        streaming.run_consensus(stream, "row_id", COLUMNS, self.frozen, self.out, self.progress, threshold=0.0, min_votes=0, **self.more)
        return self.read()

    def read(self):
        kinds = "row_id long, " + ", ".join(f"{m} int" for m in detectors.EFFECTIVE4)
        return self.spark.read.schema(kinds).json(self.out)


def test_stream_votes_as_the_batch_and_goes_on_after_a_restart(spark, batch, tmp_path):
    """Rows come out of order over several runs; after the first run some chunks are open, and only their state knows of the rows."""
    want = votes_of(detectors.chunk_votes(batch, "row_id", COLUMNS))
    run = Run(spark, batch, tmp_path)
    run.add(batch.filter("row_id % 2 = 0 OR row_id < 300"))
    first = votes_of(run.go())
    assert set(first) == set(range(300))  # only the first chunk is full
    run.add(batch.filter("row_id % 2 = 1 AND row_id BETWEEN 300 AND 700"))
    run.add(batch.filter("row_id % 2 = 0").limit(200))  # sent twice
    assert set(votes_of(run.go())) == set(range(600))
    run.add(batch.filter("row_id % 2 = 1 AND row_id > 700"))
    run.go()
    found = run.read().collect()
    assert len(found) == 1000 and votes_of(run.read()) == want
    assert len(run.go().collect()) == 1000  # nothing new


def test_late_rows_are_judged_by_their_chunk_and_a_batch_run_again_replaces_its_own(spark, batch, tmp_path):
    run = Run(spark, batch, tmp_path)
    late = batch.filter("row_id IN (5, 970)").withColumn("row_id", F.col("row_id") + 5000)
    chunk = batch.filter("row_id BETWEEN 0 AND 299")
    run.add(chunk)
    run.go()
    extra = spark.createDataFrame([(299, 9.0, -9.0), (3, 0.0, 0.0)], run.schema)  # ids that are known
    run.add(extra)
    assert len(run.go().collect()) == 300
    run.add(late)  # another chunk, beyond the batch's rows: it waits for 300
    assert len(run.go().collect()) == 300
    votes = spark.createDataFrame([(1, True), (2, False)], "row_id long, is_anomaly boolean")
    sink = streaming.append_flagged(f"file://{tmp_path}/sink")
    for _ in range(2):
        sink(votes, 4)
    sink(votes, 5)
    assert [r["row_id"] for r in spark.read.json(f"file://{tmp_path}/sink").collect()] == [1, 1]


def test_frozen_statistics_survive_writing(spark, batch, tmp_path):
    made = streaming.Frozen.fit(batch, "row_id", COLUMNS)
    made.save(spark, f"file://{tmp_path}/f")
    read = streaming.Frozen.load(spark, f"file://{tmp_path}/f")
    x = np.random.default_rng(1).normal(size=(50, 2))
    a, b = made.scores(x, np.array([50])), read.scores(x, np.array([50]))
    assert all((a[m][0] == b[m][0]).all() for m in detectors.EFFECTIVE4) and (made.limit, made.rows) == (read.limit, read.rows) == (read.limit, 1000)

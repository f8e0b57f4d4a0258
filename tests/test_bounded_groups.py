from __future__ import annotations

import numpy as np
import pandas as pd

from sievefold.operators import spectral, vision
from sievefold.sources import io


def test_sounds_summed_where_they_are_made(spark):
    """As of the sounds themselves, four columns, several batches."""
    x = np.random.default_rng(1).random((150, 4))
    frame = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(150), **{f"c{k}": x[:, k] for k in range(4)}}))
    names = [f"c{k}" for k in range(4)]
    made = {r["row_id"]: np.array(r["samples"]) for r in spectral.synth_rows(frame, "row_id", names, 2000).collect()}
    got = spectral.synth_summary(frame, "row_id", names, [0, 20, 199], 2000).collect()
    assert len(got) == len(made) == 150
    for r in got:
        own = made[r["row_id"]]
        assert r["n"] == len(own) == 200 and np.allclose(r["picked"], own[[0, 20, 199]]) and np.isclose(r["loudness"], np.abs(own).sum())


def test_wav_parts_are_the_file(spark):
    """Parts in order are the bytes of the whole file, of two tracks; read part by part they give the same samples."""
    rng, tracks = np.random.default_rng(2), {"a": 1000, "b": 64}
    pcm = {c: rng.integers(-32768, 32767, n).astype(np.int16) for c, n in tracks.items()}
    frame = spark.createDataFrame(pd.concat([pd.DataFrame({"column_name": c, "idx": 2 * np.arange(len(v)), "pcm": v}) for c, v in pcm.items()]).sample(frac=1, random_state=1))
    parts = io.to_wav_parts(frame, span=64)
    files = parts.toPandas().sort_values("part").groupby("column_name")["wav"].apply(lambda s: b"".join(map(bytes, s)))
    assert {c: io.wav_bytes(v) for c, v in pcm.items()} == dict(files)
    assert parts.count() == 17
    got = io.from_wav_parts(parts, span=64).toPandas()
    for c, v in pcm.items():
        assert np.allclose(got[got["column_name"] == c].sort_values("idx")["value"], v / 32767.0)


def test_closing_by_tiles(spark):
    """Any tile gives what whole-image neighbours give, holes in the image and its borders included."""
    rng, side = np.random.default_rng(3), 23
    cells = {(y, x): int(rng.random() < 0.15) for y in range(side) for x in range(side) if rng.random() < 0.9}
    around = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]

    def cross(of, how):
        found = {}
        for (y, x), v in of.items():
            for dy, dx in around:
                if 0 <= y + dy < side and 0 <= x + dx < side:
                    found[y + dy, x + dx] = how(v, found.get((y + dy, x + dx), v))
        return found

    want = cross(cross(cells, max), min)
    frame = spark.createDataFrame([(y, x, v) for (y, x), v in cells.items()], "y int, x int, anomaly int")
    for tile in (1, 5, 512):
        assert {(r["y"], r["x"]): r["anomaly"] for r in vision.close_flags(frame, side, tile=tile).collect()} == want

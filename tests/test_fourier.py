from __future__ import annotations

import numpy as np
import pytest

from sievefold.operators import fourier, spectral
from sievefold.sources.store import Scratch


def frame_of(spark, x, **more):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"g": np.int32(0), "at": np.arange(len(x)), "x": x, **more}))


@pytest.mark.parametrize("n, longest, samples", [(20_000, 1 << 20, 4096), (17_389, 1 << 12, 4096), (24_000, 8, 1 << 14), (7, 1 << 20, 4096)])
def test_transform_is_that_of_the_whole_signal(spark, monkeypatch, n, longest, samples):
    """Even, prime and short lengths, many groups; forward and back."""
    monkeypatch.setattr(fourier, "SAMPLES", samples)
    x = np.random.default_rng(n).normal(size=n)
    scratch = Scratch(spark)
    got = fourier.transform(frame_of(spark, x), {0: n}, [("x", None)], scratch, longest=longest)
    pdf = got.toPandas().sort_values("k")
    assert np.allclose(pdf["re_0"] + 1j * pdf["im_0"], np.fft.fft(x), atol=1e-7)
    back = fourier.transform(got.withColumnRenamed("k", "at"), {0: n}, [("re_0", "im_0")], scratch, inverse=True, longest=longest).toPandas().sort_values("k")
    assert np.allclose(back["re_0"], x, atol=1e-9) and np.allclose(back["im_0"], 0, atol=1e-9)


def test_filtered_columns_are_those_of_one_task(spark):
    """Dealt over tasks, by places and not by idx; one column has no noise and is left out."""
    import pandas as pd

    rng, parts, want = np.random.default_rng(5), [], {}
    for name, n in (("a", 5_001), ("b", 40_000)):
        s, z = np.sin(np.arange(n) / 9) + 0.2 * rng.normal(size=n), 0.3 * rng.normal(size=n)
        parts += [pd.DataFrame({"side": k, "column_name": name, "idx": 3 * np.arange(n), "value": v}) for k, v in enumerate((s, z))]
        want[name] = spectral.filter_signal(s, z)
    parts.append(pd.DataFrame({"side": 0, "column_name": "c", "idx": [0, 1], "value": [1.0, 2.0]}))
    every = spark.createDataFrame(pd.concat(parts))
    got = spectral.filter_columns(every.filter("side = 0"), every.filter("side = 1")).toPandas()
    assert set(got["column_name"]) == set(want)
    for name, of in want.items():
        mine = got[got["column_name"] == name].sort_values("idx")
        for c, v in zip(("spectral", "cleaned", "shift"), of, strict=True):
            assert np.allclose(mine[c], v, atol=1e-8), (name, c)


def test_no_task_holds_a_whole_signal(spark, monkeypatch):
    """The largest group that a transform hands to Python is a bounded part of the signal."""
    monkeypatch.setattr(fourier, "SAMPLES", 4096)
    n = 160_000
    n1, n2 = fourier.factors(n)
    assert n1 * n2 == n and max(n1, n2) * max(1, 4096 // max(n1, n2)) <= 4096
    signals = frame_of(spark, np.cos(np.arange(n))).selectExpr("'v' AS column_name", "at AS idx", "x AS value")
    got = spectral.spectra(signals, ["column_name"]).toPandas().sort_values("k")
    x = np.cos(np.arange(n))
    want = spectral.spectrum((x - x.mean()) / x.std())
    assert np.allclose(got["magnitude"], want["magnitude"], atol=1e-6) and np.allclose(got["freq"], want["freq"])

"""Rules, detectors, signals and tables on small frames made by hand."""

from __future__ import annotations

import http.server
import json
import os
import threading
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievefold.functions.numbers import to_number
from sievefold.functions import scaling
from sievefold.operators import audio, detectors, joins, rowid, rules, shift, spectral, vision
from sievefold.plans.quality_run import QualityRun
from sievefold.sources import generate, io
from sievefold.sources.store import Scratch
from sievefold.streaming.rules import route_stream, run_to_table, windowed_decisions


def test_row_identity_survives_bad_rows(spark):
    df = spark.createDataFrame([(0, "1"), (1, "2"), (2, "x"), (3, "50"), (4, "5")], "row_id long, v string")
    got = {r["row_id"]: r["decision"] for r in rules.route(df, [rules.Rule("v", 0, 10, 0.5)]).collect()}
    assert got == {0: "cleaned", 1: "cleaned", 2: "fully_discarded", 3: "unsure", 4: "cleaned"}


def test_bounds_are_not_violations_and_the_largest_confidence_decides(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0), (10.1, 0.0), (11.0, 5.0)], "a double, b double")
    found = rules.route(df, [rules.Rule("a", 0, 10, 0.7), rules.Rule("b", None, 1, 0.9)]).orderBy("a", "b").collect()
    assert [r["decision"] for r in found] == ["cleaned", "cleaned", "unsure", "fully_discarded"]
    assert found[3]["violations"] == ["a > 10", "b > 1"]


def test_malformed_rules_are_left_out():
    assert [r.column for r in rules.parse_rules('{"a": [1, 2, 0.5], "b": [1], "c": 3, "d": [null, null, 0.1]}', ["a", "b", "c"])] == ["a"]


def test_numbers(spark):
    texts = ["1", " 2.5 ", "1_000", "1e3", "-inf", "1.0d", "", "0x1", "nan"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(to_number(F.col("t"))).collect()] == [1.0, 2.5, 1000.0, 1000.0, float("-inf"), None, None, None, None]


def test_consensus_needs_three_of_four(spark):
    df = spark.createDataFrame([(n, *(1 if k < n else 0 for k in range(4))) for n in range(5)], "id long, a int, b int, c int, d int")
    got = detectors.consensus(df, ["a", "b", "c", "d"]).orderBy("id").collect()
    assert [r["confidence_score"] for r in got] == [0, 0.25, 0.5, 0.75, 1.0]
    assert [r["is_anomaly"] for r in got] == [False, False, False, True, True]
    assert all(len(r["agreeing_methods"]) == r["num_agreeing_methods"] for r in got)


def test_last_chunk_of_one_row_has_no_outliers(spark):
    df = spark.range(301).select(F.col("id").alias("row_id"), F.when(F.col("id") == 7, 1e6).otherwise(F.rand(1)).alias("v"))
    got = {r["row_id"]: r["flagged_columns"] for r in detectors.outlier_columns(df, "row_id", ["v"]).collect()}
    assert got[300] == [] and got[7] == ["v"] and len(got) == 301


def test_mahalanobis_votes_are_bounded_by_chunk(spark, sf):
    votes = detectors.mahalanobis(spark.read.parquet(f"{sf}/events.parquet"), "event_id", ["value", "user_id"])
    for r in votes.groupBy("chunk_id").agg(F.sum("vote").alias("v"), F.count("*").alias("n")).collect():
        assert r["v"] <= -(-0.05 * (r["n"] - 1) // 1)


@pytest.mark.parametrize("method", sorted(detectors.REGISTRY))
def test_planted_outlier_has_the_highest_score(spark, method):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    x[123] = 12, -12, 12, -12
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double, d double")
    best = detectors.REGISTRY[method](df, "row_id", ["a", "b", "c", "d"]).orderBy(F.desc("score")).first()
    assert best["row_id"] == 123 and best["vote"] == 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=9, max_size=9))
def test_opening_is_below_and_closing_above(values):
    img = np.array(values).reshape(1, 3, 3)
    assert (detectors.dilate(detectors.erode(img)) <= img).all() and (detectors.erode(detectors.dilate(img)) >= img).all()


@pytest.mark.parametrize("k", [1, 2, 3, 4, 9, 10])
def test_morphology_by_width(k):
    f = detectors.morphology_features(np.random.default_rng(1).normal(size=(5, k)), -1, 1)
    assert f.shape == (5, 1 if k == 1 else 9 if k > 3 else 9)


def test_shift_with_nothing_flagged(spark):
    scores = spark.range(100).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("score"))
    none = scores.filter("false").select("row_id")
    assert shift.detect(scores, none, "percentile").count() == 10
    with pytest.raises(ValueError):
        shift.detect(scores, none, "unknown")


def test_dbscan_noise(spark):
    scores = spark.createDataFrame([(i, 0.001 * i) for i in range(20)] + [(99, 5.0)], "row_id long, score double")
    got = {r["row_id"]: r for r in shift.dbscan(scores, scores.filter("false")).collect()}
    assert got[99]["cluster"] is None and got[99]["is_anomaly"] and not got[3]["is_anomaly"]


@pytest.mark.parametrize("n,m", [(3, 100), (200, 500), (2, 7)])
def test_lerp_is_linear_interpolation(spark, n, m):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, value double")
    got = [r["value"] for r in audio.lerp(df, n, m).orderBy("idx").collect()]
    assert np.allclose(got, np.interp(np.arange(m) * (n - 1) / (m - 1), np.arange(n), x))


def test_overlapping_highlights_compound(spark):
    df = spark.createDataFrame([(i, 0.1) for i in range(1000)], "idx long, value double")
    flags = spark.createDataFrame([(500,), (501,)], "row_id long")
    top = audio.highlight(df, flags, 1000, 1000).agg(F.max("k"), F.max("value")).first()
    assert top[0] == 2 and abs(top[1] - 0.4) < 1e-12


def test_spectral_pieces():
    s = np.sin(np.arange(5000) / 7)
    shift_, cleaned, total = spectral.filter_signal(s, 0.1 * s)
    assert len(shift_) == len(cleaned) == len(total) == 5000 and (shift_ >= 0).all()
    assert np.allclose(np.fft.irfft(np.fft.rfft(s), len(s)), s)
    assert spectral.median_filter(np.array([1.0, 9.0, 2.0, 3.0]), 3).tolist() == [1.0, 2.0, 3.0, 3.0]
    assert sum(spectral.weights(np.zeros(4))) == pytest.approx(1)


def test_wav_round_trip(spark):
    pcm = np.array([0, 1, -1, 32767, -32767], np.int16)
    assert (np.round(io.wav_samples(io.wav_bytes(pcm)) * 32767) == pcm).all()


def test_film_grid_side():
    assert [vision.grid_side(n) for n in (1, 2, 10, 1000)] == [1, 2, 4, 37]


def test_encodings():
    assert io.detect_encoding("é".encode()) == "UTF-8" and io.detect_encoding("é".encode("latin-1") + b"abcd") == "ISO-8859-1"
    assert io.detect_encoding(b"\xff\xfea\0") == "UTF-16LE" and io.detect_encoding(("a" * 10 + "é").encode()[:-1]) == "UTF-8"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,nan\n2,3.5\n")
    (tmp_path / "p.data").write_text("  1   2\n3 4  \n")
    assert list(io.list_tables(spark, str(tmp_path))) == ["a"]
    assert [r["y"] for r in io.read_csv(spark, str(tmp_path / "a.csv")).orderBy("x").collect()] == [None, 3.5]
    assert [tuple(r) for r in io.read_blank_separated(spark, str(tmp_path / "p.data"), ["a", "b"]).collect()] == [("1", "2"), ("3", "4")]
    routed = rules.route(spark.createDataFrame([(1.0,), (9.0,)], "v double"), [rules.Rule("v", None, 5, 0.9)])
    rules.split_writes(routed, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("decision=*")) == ["decision=cleaned", "decision=fully_discarded"]


def test_generated_tables_have_keys_and_repeat(spark):
    for name, df in generate.all_tables(spark).items():
        assert df.count() == df.select(*generate.KEYS[name]).distinct().count() > 0
        assert df.exceptAll(generate.TABLES[name](spark)).count() == 0


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("v")).repartition(7)
    got = rowid.with_row_id(df, ["v"]).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(1000)) and [r["v"] for r in got] == sorted(r["v"] for r in got)


def test_rules_on_a_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(f"{sf}/events.parquet")
    some = [rules.Rule("value", 0, 100, 0.9)]
    q = route_stream(spark, str(tmp_path / "in"), schema, some).writeStream.format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = rules.route(spark.read.parquet(f"{sf}/events.parquet"), some)
    assert spark.table("routed").groupBy("decision").count().exceptAll(batch.groupBy("decision").count()).count() == 0


def test_whole_run(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("row_id"), "value", F.col("user_id").cast("double").alias("user_id"))
    run = QualityRun(["value", "user_id"], [rules.Rule("value", 0, 100, 0.9)])
    flagged = run.flagged(df).persist()
    scores = run.scores(df, flagged).persist()
    assert scores.count() == 1000
    assert 0 < run.clean(df, scores, flagged).count() < 1000


def test_knn_query_uses_all_dimensions(spark, sf):
    from sievefold import queries

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    apart = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 14]
    got = {r["vec_id"]: r["score"] for r in queries.QUERIES["knn_scores"](spark, sf).collect()}
    assert max(abs(got[r["vec_id"]] - a) for r, a in zip(rows, apart, strict=True)) < 1e-3


def test_percentiles_by_narrowing(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.exponential(size=3000), np.full(500, 0.25), [1e9, -1e9]]
    df = spark.createDataFrame([(float(v), int(v * 10) if abs(v) < 1e6 else 0) for v in x] + [(None, None)], "a double, b long")
    ps = (0.0, 0.1, 0.25, 0.5, 0.731, 1.0)
    for held in (10**6, 20):
        got = scaling.percentiles(df, ["a", "b"], ps, held)
        assert np.allclose(got[0], np.quantile(x, ps), rtol=1e-12)
        assert np.allclose(got[1], np.quantile([int(v * 10) if abs(v) < 1e6 else 0 for v in x], ps))
    assert scaling.percentiles(df.filter("false"), ["a"], (0.5,), 0) == [[None]]


def test_cover_counts_by_brute_force(spark):
    rng = np.random.default_rng(6)
    regions = [(int(a), int(a + n)) for a, n in zip(rng.integers(-20, 300, 400), rng.integers(-3, 90, 400), strict=True)]
    want: dict[int, int] = {}
    for a, b in regions:
        for i in range(max(a, 0), min(b, 310)):
            want[i] = want.get(i, 0) + 1
    got = {r["idx"]: r["k"] for r in joins.cover_counts(spark.createDataFrame(regions, "start long, end long").repartition(5), 0, 310).collect()}
    assert got == want
    assert joins.cover_counts(spark.createDataFrame([], "start long, end long")).count() == 0


def test_dbscan_by_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.round(np.r_[rng.normal(0, 1, 300), rng.uniform(-8, 8, 60), np.full(20, 3.0)], 2)
    flags = set(rng.choice(380, 60, replace=False).tolist())
    u = (x - x.mean()) / x.std() / 0.1
    near = (np.abs(u[:, None] - u[None]) <= 1).sum(1)
    cores = sorted({v for v, n in zip(u, near, strict=True) if n >= 5})
    number = {v: k for v, k in zip(cores, np.cumsum([0, *(b - a > 1 for a, b in zip(cores, cores[1:], strict=False))]), strict=True)}
    label = [min(((abs(v - c), c) for c in cores if abs(v - c) <= 1), default=(0, None))[1] for v in u]
    cluster = [None if c is None else number[c] for c in label]
    scores = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "row_id long, score double").repartition(6)
    got = {r["row_id"]: r for r in shift.dbscan(scores, spark.createDataFrame([(k,) for k in flags], "row_id long"), eps=0.1).collect()}
    for k in range(380):
        own = [j for j in range(380) if cluster[j] == cluster[k]]
        bad = cluster[k] is None or sum(j in flags for j in own) / len(own) > 0.3
        assert (got[k]["is_core"], got[k]["cluster"], got[k]["is_anomaly"]) == (near[k] >= 5, cluster[k], bad)


@pytest.mark.parametrize("size", [3, 5, 129, 131, 401])
def test_median_filter(size):
    x = np.random.default_rng(size).normal(size=900)
    padded = np.pad(x, size // 2, mode="symmetric")
    want = [np.median(padded[i : i + size]) for i in range(900)]
    assert spectral.median_filter(x, size, 100).tolist() == want


def test_one_pass_equals_the_methods_alone(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("value").cast("double").alias("value"), F.col("user_id").cast("double").alias("user_id"))
    together = {r["event_id"]: r for r in detectors.chunk_votes(df, "event_id", ["value", "user_id"]).collect()}
    scaled = scaling.standard_scale(df, ["value", "user_id"]).select("event_id", F.col("value_std").alias("value"), F.col("user_id_std").alias("user_id"))
    for m in detectors.EFFECTIVE4:
        alone = detectors.REGISTRY[m](scaled if m in ("isolation_forest", "morphological") else df, "event_id", ["value", "user_id"]).collect()
        assert len(alone) == len(together)
        assert max(abs(r["score"] - together[r["event_id"]]["method_specific_scores"][m]) for r in alone) < 1e-6
        assert sum(r["vote"] != together[r["event_id"]][m] for r in alone) <= 1


def test_spectral_shift_by_its_definition():
    """Sums over samples in place of transforms, for one window size."""
    rng = np.random.default_rng(8)
    s, z, n = rng.normal(size=70), rng.normal(size=70), 32
    w = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
    want = np.zeros(70)
    for at in range(0, 70 - n + 1, n):
        total = 0.0
        for k in range(n // 2 + 1):
            a, b = (abs(sum(x[at + i] * w[i] * np.exp(-2j * np.pi * i * k / n) for i in range(n))) for x in (s, z))
            total += abs(a - max(a - 2 * b, 0.1 * a))
        want[at : at + n] = total / (n // 2 + 1)
    assert np.allclose(spectral.window_shift(s, z, n), want)


@pytest.mark.parametrize("how", ["truncate", "tile"])
def test_windows_keyed_by_column_equal_whole_signals(spark, how):
    """Two columns of different lengths, one shorter than some windows; tails, short noise and a column without noise."""
    rng = np.random.default_rng(12)
    tracks = {"a": (rng.normal(size=5000), rng.normal(size=4500)), "b": (rng.normal(size=900), rng.normal(size=300)), "c": (rng.normal(size=70), rng.normal(size=200)), "d": (rng.normal(size=50), np.zeros(0))}
    table = lambda side: spark.createDataFrame([(c, k, float(v)) for c, pair in tracks.items() for k, v in enumerate(pair[side])], "column_name string, idx long, value double").repartition(3)
    got = {(r["column_name"], r["idx"]): r["spectral"] for r in spectral.window_shifts(table(0), table(1), how, (64, 128, 1024)).collect()}
    both = {(r["column_name"], r["idx"]): r["shift"] for r in spectral.shift_by_windows(table(0), table(1)).collect()}
    for c in "abc":
        s, z = spectral.align(*tracks[c], how)
        want = spectral.spectral_shift(s, z, (64, 128, 1024))
        assert np.allclose([got.pop((c, k)) for k in range(len(s))], want)
        s, z = spectral.align(*tracks[c])
        assert np.allclose([both.pop((c, k)) for k in range(len(s))], spectral.comprehensive_shift(s, z))
    assert not got and not both
    with pytest.raises(ValueError, match="divide"):
        spectral.window_shifts(table(0), table(1), sizes=(100, 512))


def test_denoising_brings_a_noisy_signal_nearer():
    rng = np.random.default_rng(9)
    clean, noise = np.sin(np.arange(4096) / 15), 0.2 * rng.normal(size=4096)
    _, cleaned, total = spectral.filter_signal(clean + noise, noise)
    assert np.abs(cleaned - clean).mean() < np.abs(noise).mean() and (total >= 0).all()


def test_baseline_and_anomaly_sounds(spark):
    df = spark.createDataFrame([(k, k / 200) for k in range(200)], "row_id long, x double")
    flagged = df.filter("x > 0.9").select("row_id")
    calm, loud = (x.collect() for x in spectral.baseline_and_anomalies(df, "row_id", ["x"], flagged, rate=200))
    assert len(calm) == 50 and len({r["row_id"] for r in calm}) == 50 and all(r["row_id"] <= 180 for r in calm)
    assert sorted(r["row_id"] for r in loud) == list(range(181, 200))
    for r in loud:
        assert np.allclose(r["samples"], spectral.synth_row(np.array([r["row_id"] / 200]), 200))


def test_generators_follow_their_distributions(spark):
    made = generate.all_tables(spark)
    b = made["bureau"].groupBy("SK_ID_CURR").count().agg(F.count("*"), F.avg("count"), F.var_samp("count")).first()
    assert b[0] == 350 and abs(b[1] - 3) < 0.35 and abs(b[2] - 2) < 0.7
    a = made["application_main"].agg(F.avg("TARGET"), F.avg((F.col("CODE_GENDER") == "M").cast("int")), F.avg(F.log("AMT_INCOME_TOTAL")), F.min("AMT_ANNUITY"), F.max("DAYS_BIRTH")).first()
    assert abs(a[0] - 0.2) < 0.06 and abs(a[1] - 0.6) < 0.08 and abs(a[2] - 10.5) < 0.15 and a[3] >= 5000 and a[4] <= -18 * 365


def test_flagged_records_explain_themselves(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", "user_id", "event_type")
    got = detectors.ConsensusDetector().flagged(e, "event_id", ["value", "user_id"]).collect()
    rows = {r["event_id"]: r for r in e.collect()}
    assert got
    for r in got:
        assert r["data"].asDict() == rows[r["row_index"]].asDict() and r["chunk_id"] == r["row_index"] // 300
        assert set(r["anomaly_scores"]) == set(r["flagged_columns"]) and r["num_agreeing_methods"] >= 3


def test_rules_from_a_model_server(spark):
    seen = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"response": 'Rules: {"a": [0, 10, 0.9], "zz": [0, 1, 0.5]} done'} if len(seen) < 2 else {"response": "none"} if len(seen) < 3 else {}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        asks = rules.ModelRules(f"http://127.0.0.1:{server.server_port}/", "some-model")
        df = spark.createDataFrame([(1.0,)], "a double")
        found = asks.rules(df)
        assert [(r.column, r.lower, r.upper, r.confidence) for r in found] == [("a", 0, 10, 0.9)]
        assert seen[0][0] == "/generate" and seen[0][1]["options"] == {"temperature": 0.1, "num_predict": 2048} and "- a: double" in seen[0][1]["message"]
        for _ in range(2):
            with pytest.raises(ValueError):
                asks.rules(df)
    finally:
        server.shutdown()


def test_png_holds_the_pixels():
    pixels = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    data = vision.png_bytes(pixels)
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    assert (np.frombuffer(raw, np.uint8).reshape(5, 22)[:, 1:] == pixels.reshape(5, 21)).all()
    assert int.from_bytes(data[at - 8 : at - 4], "big") == zlib.crc32(data[12 : at - 8])


def test_shrunken_films_keep_anomalies(spark):
    cells = spark.createDataFrame([(y, x, float(y), int((y, x) == (9, 9))) for y in range(10) for x in range(10)], "y int, x int, value double, anomaly int")
    small, side = vision.shrink(cells, 10, 4)
    got = {(r["y"], r["x"]): r for r in small.collect()}
    assert side == 4 and len(got) == 16 and got[3, 3]["anomaly"] == 1 and got[0, 0]["value"] == 1.0 and sum(r["anomaly"] for r in got.values()) == 1


def test_late_rows_beyond_the_watermark_do_not_count(spark, tmp_path):
    import datetime as dt

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    # a batch is filtered by the watermark that the batch before the last one left
    batches = [[(at(1), "a"), (at(1, 30), "a")], [(at(5), "a"), (at(1, 59), "b")], [(at(5, 1), "a")], [(at(1, 10), "late"), (at(5, 5), "a")], [(at(9), "end")], [(at(9), "end")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, decision string").coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"made{k}").glob("part-*"))
        part.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("ts timestamp, decision string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_to_table(windowed_decisions(stream, "ts"), Scratch(spark), "late").collect()
    assert {(r["window"]["start"].hour, r["decision"], r["n"]) for r in got} == {(1, "a", 2), (1, "b", 1), (5, "a", 3)}

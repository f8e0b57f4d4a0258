"""Rows in the order of files, trimming, encodings, and the index of ids."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sievefold.operators import idindex
from sievefold.sources import encodings, lines
from sievefold.sources.store import Scratch


@pytest.fixture
def small_splits(spark):
    """Splits of 2,000 bytes, several to a file and several to a task."""
    own = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def local(path):
    return path.removeprefix("file://")


# order and trimming ----------------------------------------------------------


def texts(n, of):
    return [f"{of}-{k} " + "x" * (k * 7 % 40) for k in range(n)]


def folder_of(tmp_path, sizes):
    """Files whose sizes differ, so that a scan takes them in another order than their names'."""
    want = []
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{t}\n" for t in texts(n, name)))
        want += texts(n, name) if not name.startswith("_") else []
    return want


def test_ids_follow_files_and_their_lines(spark, tmp_path, small_splits):
    want = folder_of(tmp_path, {"a.txt": 30, "b.txt": 900, "c.txt": 1, "d.txt": 0, "e.txt": 400, "_not.txt": 5})
    scan = spark.read.text(str(tmp_path))
    assert scan.rdd.getNumPartitions() > 10
    got = lines.in_file_order(scan, "n", "line").collect()
    assert sorted(r["n"] for r in got) == list(range(len(want)))
    assert all(r["value"] == want[r["n"]] for r in got)
    assert all(r["line"] == int(re.match(r"[^-]*-(\d+)", r["value"])[1]) for r in got)


def test_ids_of_csv_files_with_headers_and_pruned_columns(spark, tmp_path, small_splits):
    for name in "xyz":
        (tmp_path / f"{name}.csv").write_text("a,b\n" + "".join(f"{k},{name}{k}\n" for k in range(700)))
    scan = spark.read.option("header", True).schema("a int, b string").csv(str(tmp_path)).select("b")
    got = lines.in_file_order(scan).filter("row_id % 3 = 1").collect()
    assert len(got) == 700 and all(r["b"] == "xyz"[r["row_id"] // 700] + str(r["row_id"] % 700) for r in got)


@pytest.mark.parametrize("n", [0, 1, 29, 30, 500, 5000])
def test_trim(spark, tmp_path, small_splits, n):
    want = folder_of(tmp_path / "t" if (tmp_path / "t").mkdir() is None else tmp_path, {"a.txt": 30, "b.txt": 900, "c.txt": 50})
    path = f"file://{tmp_path}/t"
    assert lines.trim_file(spark, path, n) == min(n, 980)
    left = lines.read_lines(spark, path).orderBy("row_id").collect()
    assert [r["value"] for r in left] == want[:n] and not (tmp_path / "t.trimmed").exists()


def test_trim_of_one_file(spark, tmp_path):
    (tmp_path / "one.csv").write_text("h\n" + "".join(f"{k}\n" for k in range(50)))
    lines.trim_file(spark, f"file://{tmp_path}/one.csv", 20)
    assert [r["value"] for r in lines.read_lines(spark, f"file://{tmp_path}/one.csv").orderBy("row_id").collect()] == ["h", *map(str, range(19))]
    with pytest.raises(ValueError, match="negative"):
        lines.trim_file(spark, f"file://{tmp_path}/one.csv", -1)


# encodings -------------------------------------------------------------------

SAMPLES = {
    "UTF-8": "plain and ünïcode, 日本語, текст",
    "windows-1252": "“quoted” – déjà vu, façade",
    "ISO-8859-1": "déjà vu, façade, Größe",
    "windows-1251": "Это русский текст о данных и таблицах",
    "KOI8-R": "Это русский текст о данных и таблицах",
    "Shift_JIS": "これは日本語の文章です。データの表を読みます",
    "EUC-JP": "これは日本語の文章です。データの表を読みます",
    "EUC-KR": "이것은 한국어 문장입니다 데이터 표를 읽습니다",
    "GB18030": "这是中文句子，我们读取数据表并检查结果是否正确",
    "Big5": "這是中文句子，我們讀取資料表並檢查結果是否正確",
    "UTF-16LE": "header,Größe,δέλτα",
    "UTF-16BE": "header,Größe,δέλτα",
}


def test_encodings_of_many_files(spark, tmp_path, small_splits):
    """Every encoding, in files of one line and of many splits; more files than any cap, each judged alone."""
    want = {}
    for name, text in SAMPLES.items():
        for n in (1, 300):
            file = tmp_path / f"{name}-{n}.txt"
            file.write_bytes("".join(f"{k},{text}\n" for k in range(n)).encode(name))
            want[file.name] = name
    for k in range(80):
        (tmp_path / f"plain-{k}.txt").write_bytes(b"a,b\n1,2\n" if k != 79 else "a,b\nø,2\n".encode("latin-1"))
        want[f"plain-{k}.txt"] = "UTF-8" if k != 79 else "ISO-8859-1"
    for name, mark, text in (("UTF-8", b"\xef\xbb\xbf", "a,é"), ("UTF-16LE", b"\xff\xfe", "日本"), ("UTF-16BE", b"\xfe\xff", "日本")):
        (tmp_path / f"marked-{name}.txt").write_bytes(mark + f"{text}\n".encode(name))
        want[f"marked-{name}.txt"] = name
    (tmp_path / "empty.txt").write_bytes(b"")
    got = {r["file"].rpartition("/")[2]: r["encoding"] for r in encodings.file_encodings(spark, str(tmp_path)).collect()}
    assert got == want
    read = encodings.decoded_lines(spark, encodings.file_encodings(spark, str(tmp_path)), str(tmp_path)).collect()
    by_file: dict[str, list] = {}
    for r in read:
        by_file.setdefault(r["file"].rpartition("/")[2], []).append(r["value"])
    for name, text in SAMPLES.items():
        for n in (1, 300):
            kept = [v for v in by_file[f"{name}-{n}.txt"] if v]
            assert sorted(kept) == sorted(f"{k},{text}" for k in range(n))
    assert by_file["marked-UTF-16LE.txt"] == ["日本"] and by_file["marked-UTF-8.txt"] == ["a,é"]


@pytest.mark.parametrize("name", SAMPLES)
def test_written_files_are_read_back(spark, tmp_path, name):
    frame = spark.createDataFrame([(f"{k},{SAMPLES[name]}",) for k in range(9)] + [(None,)], "t string")
    path = str(tmp_path / "out")
    encodings.write_encoded(frame, "t", path, name)
    found = encodings.file_encodings(spark, path)
    assert {r["encoding"] for r in found.collect()} == {name}
    got = [r["value"] for r in encodings.decoded_lines(spark, found, path).collect()]
    assert sorted(v for v in got if v) == sorted(f"{k},{SAMPLES[name]}" for k in range(9))


# the index of ids --------------------------------------------------------------


@pytest.fixture
def indexed(spark, tmp_path):
    """Three tables: ids in two columns, text ids, nulls, and one id that a third of all rows hold."""
    a = spark.createDataFrame([(k, 5 if k % 3 == 0 else k + 1000, f"a{k}") for k in range(300)] + [(None, None, "none")], "id long, parent_id long, name string")
    b = spark.createDataFrame([(str(k), k) for k in range(50)], "key string, v int")
    a.coalesce(1).sortWithinPartitions("name").write.parquet(str(tmp_path / "a"))
    b.repartition(4, "key").write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([], "id int").write.parquet(str(tmp_path / "c"))
    scratch = Scratch(spark)
    yield idindex.IdIndex(spark, {"a": (str(tmp_path / "a"), ["id", "parent_id"]), "b": (str(tmp_path / "b"), ["key"]), "c": (str(tmp_path / "c"), ["id"])}, scratch)
    scratch.drop()


def test_lookup_finds_the_first_row_of_each_table(indexed):
    def look(value):
        return {r["table_name"]: (r["matched_id"], r["body"]) for r in indexed.lookup(value).collect()}

    assert look(5) == {"a": (0, '{"id":5,"parent_id":1005,"name":"a5"}'), "b": (0, '{"key":"5","v":5}')}
    assert look("1001") == {"a": (1, '{"id":1,"parent_id":1001,"name":"a1"}')}
    assert look(99999) == look("no such id") == {}
    assert indexed.entries.filter("id IS NULL").count() == 0
    assert indexed.entries.filter("id = '5'").count() == 2  # a third of a's rows are one entry


def test_lookup_reads_one_bucket_and_one_file(spark, indexed):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)  # the plan names its buckets only then
    plan = indexed.find(7)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f"SelectedBucketsCount: 1 out of {buckets}" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,7)]" in plan
    assert {r["table_name"] for r in indexed.find(7).collect()} == {"a", "b"}
    files = {r["file"] for r in indexed.entries.filter(F.col("table_name") == "b").collect()}
    assert len(files) > 1 and len({r["file"] for r in indexed.find(7).filter("table_name = 'b'").collect()}) == 1


# tables between steps ----------------------------------------------------------


def test_nothing_is_left_once_results_are_stored(spark, tmp_path):
    """Operators that make their own folder and tables, of which the caller holds none."""
    import os

    from sievefold.operators import neighbours, rowid
    from sievefold.sources.store import drop_all, shared_dir

    drop_all(spark)
    frame = spark.range(50).selectExpr("id", "id * 2.0 AS x")
    rowid.with_row_id(frame, ["x"]).write.parquet(str(tmp_path / "a"))
    neighbours.lof(frame, "id", ["x"], 3).write.parquet(str(tmp_path / "b"))
    frame.write.parquet(str(tmp_path / "t"))
    index = idindex.IdIndex(spark, {"t": (str(tmp_path / "t"), ["id"])})
    assert index.lookup(7).count() == 1 and any("id_index" in t.name for t in spark.catalog.listTables())
    folder = local(shared_dir(spark)) + "/sievefold"
    assert os.listdir(folder) and drop_all(spark) >= 3
    assert os.listdir(folder) == [] and not any("id_index" in t.name for t in spark.catalog.listTables())
    assert drop_all(spark) == 0 and spark.read.parquet(str(tmp_path / "b")).count() == 50

"""Readers and writers. Paths may be in any store that Spark reads."""

from __future__ import annotations

import io
import json
import struct
import wave
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from sievefold.operators.rowid import with_row_id
from sievefold.sources.encodings import file_encodings
from sievefold.sources.store import Scratch

ENCODINGS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def detect_encoding(head: bytes) -> str:
    """Byte order mark, else UTF-8 if it decodes, else Latin-1. A character cut at the end is allowed."""
    for mark, name in ENCODINGS:
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as bad:
        if bad.start < len(head) - 3:
            return "ISO-8859-1"
    return "UTF-8"


def head_bytes(spark: SparkSession, path: str, n: int = 100_000) -> bytes:
    """The first n bytes of a file through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def folder_encoding(spark: SparkSession, folder: str) -> str:
    """S2 for a table of several files: the encoding of all its files that aren't plain UTF-8; different ones raise."""
    found = sorted(r["encoding"] for r in file_encodings(spark, folder).select("encoding").distinct().collect())
    others = [e for e in found if e != "UTF-8"]
    if len(others) > 1:
        raise ValueError(f"files of {folder} are in {' and '.join(others)}; read them with decoded_lines")
    return others[0] if others else "UTF-8"


def null_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating-point columns."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))})


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str | None = None, schema=None) -> DataFrame:
    """Header, inferred or given types; pruned columns; null for NaN."""
    reader = spark.read.option("header", True).option("nanValue", "nan")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    if encoding:
        reader = reader.option("encoding", encoding)
    df = reader.csv(path)
    return null_nan(df.select(*columns) if columns else df)


def read_blank_separated(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """No header, one or more blanks between fields."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(*[F.get(parts, k).alias(c) for k, c in enumerate(names)])


def first_rows(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """S5, P13."""
    return df.orderBy(row_id).limit(n)


def list_tables(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, str]:
    """Stem -> path of the files of a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted(s.getPath().getName() for s in found)
    return {n.removesuffix(suffix): f"{folder.rstrip('/')}/{n}" for n in names if n.endswith(suffix)}


def read_flagged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that aren't JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """S8 on a column of lines."""
    return lines.select(F.from_json(column, schema).alias("r")).filter(F.coalesce(*[F.col(f"r.{c.split()[0]}").cast("string") for c in schema.split(", ")]).isNotNull()).select("r.*")


def flagged_digits(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct row ids from lines of digits alone."""
    return lines.filter(F.trim(column).rlike("^[0-9]+$")).select(F.trim(column).cast("long").alias("row_id")).distinct()


def write_flagged(df: DataFrame, path: str) -> None:
    """K2: flagged records as JSON lines with the time of writing."""
    df.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.json(path)


def wav_bytes(pcm: np.ndarray, rate: int = 44_100) -> bytes:
    """K3: mono, 16 bits, little endian."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(pcm, "<i2").tobytes())
    return out.getvalue()


def wav_samples(data: bytes) -> np.ndarray:
    """Samples in [-1, 1]."""
    with wave.open(io.BytesIO(data)) as w:
        return np.frombuffer(w.readframes(w.getnframes()), "<i2") / 32767.0


def to_wav(tracks: DataFrame, rate: int = 44_100) -> DataFrame:
    """K3: (column_name, wav) of (column_name, idx, pcm); one column's track is one file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"column_name": [pdf["column_name"].iloc[0]], "wav": [wav_bytes(pdf.sort_values("idx")["pcm"].to_numpy(), rate)]})

    return tracks.groupBy("column_name").applyInPandas(run, "column_name string, wav binary")


def to_wav_parts(tracks: DataFrame, rate: int = 44_100, span: int = 1 << 20, scratch: Scratch | None = None) -> DataFrame:
    """K3: (column_name, part, wav) of (column_name, idx, pcm): the file that ``to_wav`` gives, cut into parts of ``span`` samples.

    The first part has the header with the whole length; parts in order are the file. No task holds more than a part.
    """
    scratch = scratch or Scratch(tracks.sparkSession)
    numbered = with_row_id(tracks.select("column_name", "idx", "pcm"), ["column_name", "idx"], "row", scratch)
    sizes = F.broadcast(numbered.groupBy("column_name").agg(F.min("row").alias("start"), F.count("*").alias("n")))
    both = numbered.join(sizes.withColumnRenamed("column_name", "own"), F.col("own").eqNullSafe(F.col("column_name")))
    placed = both.select("column_name", "n", "pcm", (F.col("row") - F.col("start")).alias("at")).withColumn("part", F.floor(F.col("at") / span).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, n = int(pdf["part"].iloc[0]), int(pdf["n"].iloc[0])
        pcm = np.zeros(len(pdf), "<i2")
        pcm[pdf["at"].to_numpy() - part * span] = pdf["pcm"].to_numpy()
        head = wav_header(n, rate) if part == 0 else b""
        return pd.DataFrame({"column_name": [pdf["column_name"].iloc[0]], "part": [part], "wav": [head + pcm.tobytes()]})

    return placed.groupBy("column_name", "part").applyInPandas(run, "column_name string, part long, wav binary")


def wav_header(n: int, rate: int = 44_100) -> bytes:
    """What comes before the n samples of ``wav_bytes``."""
    if 2 * n + 36 >= 1 << 32:
        raise ValueError("a WAV file holds less than 4 GB")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 2 * n)


def from_wav_parts(parts: DataFrame, span: int = 1 << 20) -> DataFrame:
    """(column_name, idx, value) of files cut as ``to_wav_parts`` cuts them; each part is read on its own."""

    def run(frames):
        for pdf in frames:
            for name, part, data in zip(pdf["column_name"], pdf["part"], pdf["wav"], strict=True):
                x = np.frombuffer(data, "<i2", offset=0 if part else 44) / 32767.0
                for at in range(0, len(x), 1 << 16):
                    cut = x[at : at + (1 << 16)]
                    yield pd.DataFrame({"column_name": name, "idx": part * span + at + np.arange(len(cut)), "value": cut})

    return parts.select("column_name", "part", "wav").mapInPandas(run, "column_name string, idx long, value double")


def from_wav(files: DataFrame) -> DataFrame:
    """(column_name, idx, value) of (column_name, wav)."""

    def run(frames):
        for pdf in frames:
            for name, data in zip(pdf["column_name"], pdf["wav"], strict=True):
                x = wav_samples(data)
                yield pd.DataFrame({"column_name": name, "idx": np.arange(len(x)), "value": x})

    return files.select("column_name", "wav").mapInPandas(run, "column_name string, idx long, value double")


def write_csv(df: DataFrame, path: str) -> None:
    """As many files as partitions."""
    df.write.option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_rules(spark: SparkSession, rules, path: str) -> None:
    """K7."""
    write_text(spark, json.dumps({r.column: [r.lower, r.upper, r.confidence] for r in rules}, indent=2), path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole, such as a rules document."""
    return spark.read.text(path, wholetext=True).first()["value"]


def write_clean(clean: DataFrame, removed: DataFrame, total: int, path: str, method: str = "shift detection") -> None:
    """K5: ``path/rows`` as CSV, ``path/summary.txt`` with counts and rate, and ``path/removed``, the removed row ids in order.

    Ids are lines of as many files as partitions; only counts are in the summary.
    """
    write_csv(clean, f"{path}/rows")
    removed.select(F.col("row_id").cast("string").alias("value"), "row_id").repartitionByRange("row_id").sortWithinPartitions("row_id").select("value").write.text(f"{path}/removed")
    n = removed.count()
    rate = 100 * n / total if total else 0.0
    lines = ["Summary of rows removed", f"Detection method: {method}", f"Original rows: {total}", f"Removed rows: {n}", f"Clean rows: {total - n}", f"Removal rate: {rate:.2f}%"]
    write_text(clean.sparkSession, "\n".join(lines) + "\n", f"{path}/summary.txt")


def analysis_document(scores: DataFrame, found: DataFrame, flagged: DataFrame, method: str) -> DataFrame:
    """K4: one JSON document of counts and shift statistics; per-row scores stay a table."""
    from sievefold.operators.report import overlap
    from sievefold.operators.shift import stats

    row = stats(scores).crossJoin(F.broadcast(overlap(found, flagged, "row_id"))).crossJoin(F.broadcast(scores.agg(F.count("*").alias("total_samples"))))
    body = F.struct(F.lit(method).alias("detection_method"), "total_samples", F.col("n_found").alias("total_anomalies"), F.col("n_flagged").alias("total_flagged"), F.col("n_both").alias("flagged_detected"), F.struct("mean_shift", "std_shift", "max_shift", "min_shift").alias("processing_stats"))
    return row.select(F.to_json(body).alias("document"))

"""The encodings of files from counts of their bytes and byte pairs, and reading files in any of them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code pages that a file may be valid in as a whole, by the names that Java and Python both know.
PAGES = ("UTF-8", "Shift_JIS", "EUC-JP", "EUC-KR", "GB18030", "Big5")
#: What is counted in each file: bytes by class, lines that a code page can't hold, byte pairs by the class of the first.
COUNTS = ("bytes", "zero", "high", "c1", "low_letters", "lower_half", "upper_half", "pairs", "kana_pairs", "hangul_pairs", "later_pairs", "sjis_kana", "big5_common", *(f"bad_{p}" for p in PAGES), "mark_8", "mark_16le", "mark_16be", "starts_zero")
CLASSES = {"zero": rb"\x00", "high": rb"[\x80-\xff]", "c1": rb"[\x80-\x9f]", "low_letters": rb"[A-Za-z]", "lower_half": rb"[\xc0-\xdf]", "upper_half": rb"[\xe0-\xff]"}
PAIR = re.compile(rb"[\xa1-\xfe][\xa1-\xfe]")
SJIS_KANA = re.compile(rb"(?:\x82[\x9f-\xf1]|\x83[\x40-\x96])")
BIG5_COMMON = re.compile(rb"[\xa4-\xc6][\x40-\x7e\xa1-\xfe]")
PATTERNS = {name: re.compile(p) for name, p in CLASSES.items()}


def count_line(line: bytes, into: dict[str, int]) -> None:
    """Adds what one line shows. Work is linear in its bytes; plain lines cost one look."""
    into["bytes"] += len(line)
    if line.isascii() and b"\0" not in line:
        into["low_letters"] += len(PATTERNS["low_letters"].findall(line))
        return
    for name, pattern in PATTERNS.items():
        into[name] += len(pattern.findall(line))
    for page in PAGES:
        try:
            line.decode(page)
        except UnicodeDecodeError:
            into[f"bad_{page}"] += 1
    pairs = PAIR.findall(line)
    into["pairs"] += len(pairs)
    into["kana_pairs"] += sum(p[0] in (0xA4, 0xA5) for p in pairs)
    into["hangul_pairs"] += sum(0xB0 <= p[0] <= 0xC8 for p in pairs)
    into["later_pairs"] += sum(p[0] >= 0xC9 for p in pairs)
    into["sjis_kana"] += len(SJIS_KANA.findall(line))
    into["big5_common"] += len(BIG5_COMMON.findall(line))


def decide() -> Column:
    """The encoding from a file's counts."""
    c = {name: F.col(f"`{name}`") for name in COUNTS}
    valid = lambda page: c[f"bad_{page}"] == 0
    wide = c["high"] > c["low_letters"]  # letters of a script that isn't Latin
    kana = c["kana_pairs"] * 5 > c["pairs"]
    return (
        F.when(c["mark_8"] > 0, "UTF-8")
        .when(c["mark_16le"] > 0, "UTF-16LE")
        .when(c["mark_16be"] > 0, "UTF-16BE")
        .when(c["zero"] * 5 > c["bytes"], F.when(c["starts_zero"] > 0, "UTF-16BE").otherwise("UTF-16LE"))
        .when((c["high"] == 0) | valid("UTF-8"), "UTF-8")
        .when(valid("Shift_JIS") & (c["sjis_kana"] * 8 > c["high"]) & ~(valid("EUC-JP") & kana), "Shift_JIS")
        .when(valid("EUC-JP") & kana, "EUC-JP")
        .when(valid("EUC-KR") & (c["pairs"] * 2 >= c["high"] * 0.9) & (c["hangul_pairs"] > c["pairs"] * 0.7) & (c["later_pairs"] * 20 < c["pairs"]), "EUC-KR")
        .when(valid("GB18030") & (c["pairs"] * 2 >= c["high"] * 0.9) & (c["hangul_pairs"] + c["later_pairs"] > c["pairs"] * 0.5), "GB18030")
        .when(valid("Big5") & (c["big5_common"] * 2 > c["high"] * 0.5), "Big5")
        .when(wide & (c["upper_half"] > c["lower_half"]), "windows-1251")
        .when(wide, "KOI8-R")
        .when(c["c1"] > 0, "windows-1252")
        .otherwise("ISO-8859-1")
    )


def file_encodings(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, encoding) of every file of the paths that isn't empty, whatever their number.

    One pass over all lines as bytes, where the files lie, in splits; a task sends a row of counts for
    each file it met, and these are summed. A byte order mark decides; else zero bytes mean UTF-16,
    and what is valid UTF-8 is that; else byte pairs decide between the East Asian code pages that all lines are
    valid in; else bytes above 127 are Cyrillic where they outnumber Latin letters, and Western where they don't.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[str, int]] = {}
        for batch in batches:
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                if file not in found:
                    found[file] = defaultdict(int)
                    if block == 0:  # the file's first line
                        found[file] |= {"mark_8": int(line.startswith(b"\xef\xbb\xbf")), "mark_16le": int(line.startswith(b"\xff\xfe")), "mark_16be": int(line.startswith(b"\xfe\xff")), "starts_zero": int(line.startswith(b"\0"))}
                count_line(line, found[file])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([f[c] for f in found.values()], pa.int64()) for c in COUNTS)], names=["file", *COUNTS])

    counted = lines.mapInArrow(run, "file string, " + ", ".join(f"`{c}` long" for c in COUNTS))
    summed = counted.groupBy("file").agg(*[F.sum(f"`{c}`").alias(c) for c in COUNTS])
    return summed.select("file", decide().alias("encoding"))


def decoded_lines(spark: SparkSession, encodings: DataFrame, *paths: str) -> DataFrame:
    """(file, encoding, value): the lines of files in the encodings found for them; bytes that a code page lacks become U+FFFD.

    ``encodings`` is what ``file_encodings`` gave: a row for each file, joined by name. Empty lines of UTF-16LE are left
    out, since the second byte of the last line's end looks like one.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw")).join(encodings, "file")
    lines = lines.filter((F.col("encoding") != "UTF-16LE") | (F.col("raw") != F.lit(b"\0")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_line(raw, e) for raw, e in zip(batch.column("raw").to_pylist(), batch.column("encoding").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("encoding"), pa.array(texts, pa.string())], names=["file", "encoding", "value"])

    return lines.select("file", "encoding", "raw").mapInArrow(run, "file string, encoding string, value string")


def decode_line(raw: bytes, encoding: str) -> str:
    """A line's text. Lines are cut at the byte 10, so those of UTF-16 hold half of a line's end at one side, which goes."""
    if encoding == "UTF-16LE" and len(raw) % 2:
        raw = raw[1:]
    if encoding == "UTF-16BE" and len(raw) % 2:
        raw = raw[:-1]
    return raw.decode(encoding, "replace").removeprefix("\ufeff").removesuffix("\r")


def write_encoded(df: DataFrame, column: str, path: str, encoding: str) -> None:
    """A column's texts as lines of files in an encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([(t or "").encode(encoding, "replace") for t in batch.column(0).to_pylist()], pa.binary())], names=["value"])

    end = {"UTF-16LE": "\n\0", "UTF-16BE": "\0\n"}.get(encoding, "\n")
    df.select(F.col(column).alias("value")).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", end).text(path)

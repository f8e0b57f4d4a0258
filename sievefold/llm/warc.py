"""Content-addressed web archive: payloads once by digest, headers apart. SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefold.llm.shared import Scratch, keep_columns

CRLF = "\r\n"


@dataclass(frozen=True)
class WarcRules:
    """Equal payloads of ``min_bytes`` or more become revisits of one response."""

    min_bytes: int = 1000
    date: str = "2024-01-01T00:00:00Z"


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null. Line ends in a value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit(CRLF)), F.lit(""))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: WarcRules = WarcRules()) -> str:
    """Writes ``path/payloads``, ``path/headers`` and ``path/copies``; returns ``path``.

    A payload is stored once under its SHA-256; its rows are combined before
    the shuffle, so copies of one page cost a row for each task and no task
    holds them all. Headers are the exact bytes of each record's header block.
    ``copies`` lists the response of each payload that several records share; records
    of ``min_bytes`` or more meet it in a join of two exchanges, where those of one
    very common payload are dealt over tasks as a skewed key. Smaller records,
    empty ones among them, need no join.
    Of equal payloads of ``min_bytes`` or more the one with the largest page id
    is the response and others revisit it. A null payload is empty; rows that
    repeat page id and payload are one record each time; a null id is never a
    response that others revisit, unless all its copies have none. Empty tables
    give an empty archive; other columns are ignored.
    """
    spark = pages.sparkSession
    inner = keep_columns(pages, {"page": id_col, "url": url_col, "html": html_col})
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    records = inner.select("page", "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    once = records.groupBy("digest", "bytes").agg(F.first("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")

    known, enough = records.select("page", "url", "digest", "bytes", "sha1"), F.col("bytes") >= rules.min_bytes
    copies = known.filter(enough).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("page").alias("target")).filter("n > 1").drop("n")
    copies.write.option("compression", "zstd").parquet(f"{path}/copies")
    chosen = spark.read.schema(copies.schema).parquet(f"{path}/copies")
    alone = known.filter(~enough).withColumn("target", F.lit(None).cast(inner.schema["page"].dataType))
    with_target = known.filter(enough).join(chosen, ["digest", "bytes"], "left").select(*alone.columns).unionAll(alone)
    revisit = F.coalesce(~F.col("page").eqNullSafe(F.col("target")) & F.col("target").isNotNull(), F.lit(False))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page"))),
        _line("WARC-Date", F.lit(rules.date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("target")))),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    with_target.select("digest", "bytes", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return path


def _field(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, f"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, record, record_type, record_id, refers_to, payload_digest, verified) of each record.

    Headers meet payloads by digest. Every stored payload is digested again;
    a payload that doesn't match its address raises an error. ``record`` is the
    record as a WARC file has it, ``payload`` the full payload of a revisit too.
    Digests are taken before the join, so a query without ``payload`` and
    ``record`` moves none of the bytes. Headers of one digest are dealt over tasks
    where very many share it. Equal records are returned each; an empty archive
    gives no rows; a missing header line is null.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("digest"))).cast("string")
    checked = F.when((F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("bytes")), F.sha1("payload")).otherwise(wrong)
    payloads = payloads.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"))
    headers = spark.read.parquet(f"{path}/headers").select("digest", "header")
    text = F.decode("header", "UTF-8")
    out = headers.join(payloads, "digest").withColumns({"record_type": _field(text, "WARC-Type"), "record_id": _field(text, "WARC-Record-ID"), "refers_to": _field(text, "WARC-Refers-To"), "stated": _field(text, "WARC-Payload-Digest")})
    body = F.when(F.col("record_type") == "revisit", F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    return out.withColumn("verified", F.col("stated") == F.concat(F.lit("sha1:"), "payload_digest")).withColumn("record", F.concat("header", body, end))


def archive_digest(pages: DataFrame, rules: WarcRules = WarcRules(), scratch: Scratch | None = None) -> DataFrame:
    """Writes the pages, reads the archive back and returns what it says of each page.

    One row for each record; ids that aren't whole numbers are null, as null ids are;
    an empty table gives no rows; columns other than page_id, url and html are ignored.
    The archive stays in ``scratch``.
    """
    spark = pages.sparkSession
    records = read_archive(spark, write_archive(pages, (scratch or Scratch(spark)).new("warc"), rules=rules))
    number = lambda c: F.regexp_extract(F.col(c), "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "verified")

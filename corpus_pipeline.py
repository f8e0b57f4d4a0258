"""Corpus pipeline: five stages over ``documents``, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), and a folder
for its own tables if the caller wants to drop them, and returns a DataFrame. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import sievefold.llm.decontam as decontam
import sievefold.llm.packing as packing
import sievefold.llm.quality as quality
import sievefold.llm.secrets as secrets
import sievefold.llm.shared as shared
import sievefold.llm.simhash as simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: shared.Scratch | None = None) -> DataFrame:
    """Drops documents that fail the base rules or repeat themselves too much.

    Null and empty texts have no words and go. Null ids, repeated rows and columns of
    any name are kept with their document; an empty table gives an empty result.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: shared.Scratch | None = None) -> DataFrame:
    """Keeps one document of each group of near duplicates.

    Texts without a word, null ones among them, are one group; the smallest id stays, null ids
    only where there is no other, and one of repeated rows; an empty table gives an empty result.
    """
    return simhash.drop_near_duplicates(docs, scratch=scratch)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: shared.Scratch | None = None) -> DataFrame:
    """Drops documents that share a stretch of words with a benchmark item.

    Null and empty texts share nothing and stay; of repeated rows all go or all stay; null ids
    are judged by their own text; with no documents or no items nothing goes.
    """
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=scratch)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: shared.Scratch | None = None) -> DataFrame:
    """Keeps all documents, with secrets replaced by a mark and ``n_chars`` kept up to date.

    Null texts stay null; every row is judged alone; an empty table gives an empty result.
    """
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: shared.Scratch | None = None) -> DataFrame:
    """Pieces of tokenized documents and where each lies in which sequence.

    A null or empty text is the end id alone; null ids and repeated rows are packed each; an
    empty table gives no pieces.
    """
    return packing.pack_documents(docs, scratch=scratch)[1].withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("pack", pack)]

#: Tokens, fingerprints and the packing plan can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written to the shared folder before the next.

    What a stage wrote on its way goes once its result is stored, and a result once the next
    one is; the last result's folder is left to whoever reads it.
    """
    results = shared.Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        scratch = shared.Scratch(spark)
        out = stage(spark, docs, sf_dir, scratch)
        path = results.write(out, name)
        docs = results.read(path, out.schema)
        scratch.drop()
        if before:
            results.drop(before)
        before = path
    return docs

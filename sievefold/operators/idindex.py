"""An index of ids over many tables, and lookups that read one bucket of it and the files of what it names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefold.sources.store import Scratch


def as_id(value: Column) -> Column:
    """Ids are compared as text: 7, '7' and 7.0 in a column of whole numbers are the same."""
    return F.trim(value.cast("string"))


class IdIndex:
    """(id, table_name, matched_id, file, row) of the first row of each table that holds an id.

    ``tables`` maps a name to a Parquet path and its id columns, in their order: a row that holds the id in an earlier column
    comes before others, then rows by file and place. Entries are reduced in the scan's tasks before they move, so an id that a
    third of all rows hold is one entry a task; they are dealt by id into buckets once, and a lookup reads one bucket. Null ids
    are not indexed; a table without rows has no entries. ``drop`` deletes the index.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, tuple[str, Sequence[str]]], scratch: Scratch | None = None):
        self.spark, self.tables, self.scratch = spark, dict(tables), scratch or Scratch(spark)
        every = None
        for name, (path, ids) in self.tables.items():
            one = self._entries(name, path, ids)
            every = one if every is None else every.unionByName(one)
        self.entries = self.scratch.bucketed(every, "id_index", "id")

    def _entries(self, name: str, path: str, ids: Sequence[str]) -> DataFrame:
        scan = self.spark.read.parquet(path)
        place = F.struct(F.col("match.k").alias("matched_id"), F.col("file"), F.col("row"))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), as_id(F.col(f"`{c}`")).alias("id")) for k, c in enumerate(ids)])).alias("match")
        rows = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), each).filter(F.col("match.id").isNotNull())
        first = rows.groupBy(F.col("match.id").alias("id")).agg(F.min(place).alias("first"))
        return first.select("id", F.lit(name).alias("table_name"), "first.*")

    def find(self, value: object) -> DataFrame:
        """The entries of one id: a filter on the bucket column."""
        return self.entries.filter(F.col("id") == str(value))

    def lookup(self, value: object) -> DataFrame:
        """(table_name, matched_id, body as JSON) of each table that holds the id, the row read from the one file that has it."""
        out = self.spark.createDataFrame([], "table_name string, matched_id int, body string")
        for r in self.find(value).collect():  # a row for each table
            path, _ = self.tables[r["table_name"]]
            own = self.spark.read.schema(self.spark.read.parquet(path).schema).parquet(r["file"])
            row = own.filter(F.col("_metadata.row_index") == r["row"])
            out = out.unionByName(row.select(F.lit(r["table_name"]).alias("table_name"), F.lit(r["matched_id"]).alias("matched_id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in own.columns])).alias("body")))
        return out

    def drop(self) -> None:
        self.scratch.drop()

"""Tables between the steps of one run, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where a session of one machine has none, as in tests, a folder of that machine
    is set; on a cluster that raises, since executors would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sievefold-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: What was made and not dropped yet, by application.
LEFT: dict[str, list[Scratch]] = {}


def drop_all(spark: SparkSession) -> int:
    """Drops the tables of all runs of this application, once their results are stored, and says of how many runs.

    Operators that were given no ``Scratch`` made one of their own, which is found here.
    """
    left = list(LEFT.get(spark.sparkContext.applicationId, []))
    for scratch in left:
        scratch.drop()
    return len(left)


class Scratch:
    """The tables that one run writes between its steps, in a folder of its own.

    Lineage ends at these files, which survive the loss of executors. A result may
    read them when it is computed, so whoever stores the result drops the folder: its own, or with
    ``drop_all`` those of all that was run in the session and not dropped yet.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        LEFT.setdefault(spark.sparkContext.applicationId, []).append(self)
        self.path = f"{shared_dir(spark)}/sievefold/{uuid.uuid4().hex}"
        self._number = 0
        self._tables: list[str] = []

    def new(self, name: str) -> str:
        """A path in the folder that nothing has used."""
        self._number += 1
        return f"{self.path}/{self._number}-{name}"

    def write(self, df: DataFrame, name: str) -> str:
        path = self.new(name)
        df.write.option("compression", "zstd").parquet(path)
        return path

    def read(self, path: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back."""
        return self.read(self.write(df, name), df.schema)

    def bucketed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """Writes ``df`` dealt into as many buckets as a shuffle has partitions, so that joins on the keys don't move it again."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{name}_{uuid.uuid4().hex}"
        dealt = df.repartition(n, *keys).write.bucketBy(n, *keys).option("compression", "zstd").option("path", self.new(name))
        dealt.format("parquet").saveAsTable(table)
        self._tables.append(table)
        return self.spark.table(table)

    def drop(self, *paths: str) -> None:
        """Deletes tables that nothing reads any more, or the whole folder, through Hadoop's file system."""
        if not paths:
            while self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")
            left = LEFT.get(self.spark.sparkContext.applicationId, [])
            left[:] = [s for s in left if s is not self]
        jvm = self.spark.sparkContext._jvm
        for path in paths or (self.path,):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

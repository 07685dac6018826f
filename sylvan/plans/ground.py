"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only for a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


def ground(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back. Besides the lineage this also resets the
    size that Spark estimates, which would square with every self-join of a loop."""
    return Rounds()(df)


class Rounds:
    """Grounds the table of each round of a loop and deletes the one before, which the new one was made
    from: a loop takes the disk of two rounds, however many it runs. Nothing but the
    next round may read a round's table; the last one stays."""

    def __init__(self, label: str = "ground", **options: str):
        self.label, self.options, self.path = label, options, None

    def __call__(self, df: DataFrame) -> DataFrame:
        spark, old = df.sparkSession, self.path
        self.path = f"{shared_dir(spark)}/{self.label}-{uuid.uuid4().hex}"
        df.write.options(**self.options).parquet(self.path)
        if old:
            where = spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        return spark.read.schema(df.schema).parquet(self.path)


class Store:
    """A table in the shared folder that grows by appending; false while nothing was added. What was read
    before an addition does not see it."""

    def __init__(self, label: str):
        self.label, self.path, self.schema, self.spark = label, None, None, None

    def add(self, df: DataFrame) -> DataFrame:
        self.spark, self.schema = df.sparkSession, self.schema or df.schema
        self.path = self.path or f"{shared_dir(self.spark)}/{self.label}-{uuid.uuid4().hex}"
        df.select(*self.schema.names).write.mode("append").parquet(self.path)
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def __bool__(self) -> bool:
        return self.path is not None

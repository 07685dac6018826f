"""Stored forests and signals that are joined by vertex without a shuffle, and their display."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.plans.ground import shared_dir

BUCKETS = 16


def _stored(df: DataFrame, name: str, buckets: int, parts: list[str]) -> None:
    by = df.repartition(buckets, "id").sortWithinPartitions(*parts, "id").write.bucketBy(buckets, "id").sortBy("id")
    by = by.partitionBy(*parts) if parts else by
    by.option("path", f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}").saveAsTable(name)


def write_forest(forest: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """A table of the catalog, partitioned by q_index and rep and bucketed by id, in the shared folder; fails if it exists.
    Partitions let a reader take one forest of many, and buckets let it join by id where the rows are."""
    forest = forest if "q_index" in forest.columns else forest.withColumn("q_index", F.lit(0))
    _stored(forest.select("id", "next", "root", "q_index", "rep"), name, buckets, ["q_index", "rep"])


def write_signal(y: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """A signal (id, k, y) bucketed as forests are."""
    _stored(y.select("id", "k", "y"), name, buckets, [])


def read_forest(spark: SparkSession, name: str, rep: int | None = None, q_index: int | None = None) -> DataFrame:
    """(rep, q_index, id, next, root), of one repetition or one q if these are given; other files are not read."""
    f = spark.table(name)
    for column, value in (("rep", rep), ("q_index", q_index)):
        f = f if value is None else f.where(F.col(column) == value)
    return f.select("rep", "q_index", "id", "next", "root")


def describe(forest: DataFrame) -> DataFrame:
    """(rep, text): a line for each forest."""
    n = forest.groupBy("rep").agg(F.count("*").alias("nv"), F.sum(F.col("next").isNull().cast("long")).alias("trees"), F.count("next").alias("ne"))
    return n.select("rep", F.format_string("forest of %d trees on %d vertices, %d arrows", "trees", "nv", "ne").alias("text"))

"""Joins that stand one key holding a large part of all rows, and partitions that stay small as rows grow."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1 / HOT_KEYS of the rows, so fewer than HOT_KEYS keys are hot.
HOT_KEYS = 1000

#: Rows of a partition that ``spread`` and ``sized`` aim at.
PART_ROWS = 1_000_000

#: Shuffled bytes of a partition that ``sized`` allows.
PART_BYTES = "4m"


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``by`` to partitions of about PART_ROWS, so that a task's memory does not
    grow with the table, nor with the splits it is read in, as sums begin only after that; left as it is where it is one such partition."""
    parts, spark = -(-rows // PART_ROWS), df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(parts, least), *by) if parts > 1 else df


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, joins, sums and windows run in as many partitions as about ``rows`` rows need, if that is more than the
    session's number, and these are not put together beyond PART_BYTES of shuffled data, which are many rows where they
    compress well. Only what is written or counted inside counts, as plans are made when they run."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before, parts = [spark.conf.get(n) for n in names], -(-rows // PART_ROWS)
    if parts > int(before[0]):
        spark.conf.set(names[0], parts)
        spark.conf.set(names[1], PART_BYTES)
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def lookup(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, spread: list[str], how: str = "left") -> DataFrame:
    """Join ``left`` with ``right``, whose rows are unique in ``on``, however skewed ``left`` is.

    ``right[n]`` holds how many rows of ``left`` a key has (at least roughly) and ``total``
    their sum. Keys of more than total / HOT_KEYS rows are fewer than HOT_KEYS, and only they
    and their numbers of parts are broadcast: rows of ``left`` with such a key are dealt by a
    salt from ``spread`` to parts of about total / HOT_KEYS rows, and the key's row in ``right``
    goes to each of its parts, which adds HOT_KEYS rows at most. Columns of ``right`` other than
    ``on`` must not occur in ``left``.
    """
    limit = max(total // HOT_KEYS, 1)
    right = right.withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col(n) / limit)).cast("int"))
    hot = right.where("__parts > 1").select(*on, F.col("__parts").alias("__hot"))
    left = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__hot", F.lit(1))).cast("int")).drop("__hot")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return left.join(right, [*on, "__salt"], how).drop("__salt")

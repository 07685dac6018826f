"""Partitions of the vertices by the trees of a forest, and their algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.sources.graph import Graph


def partition(forest: DataFrame) -> DataFrame:
    """(rep, id, part): labels 1.. in the order of root ids. Ranks are taken over roots, not vertices."""
    roots = forest.where("id = root").select("rep", "root")
    ranks = roots.withColumn("part", F.row_number().over(Window.partitionBy("rep").orderBy("root")))
    return forest.select("rep", "id", "root").join(ranks, ["rep", "root"]).select("rep", "id", "part")


def sizes(p: DataFrame) -> DataFrame:
    return p.groupBy("rep", "part").agg(F.count("*").alias("size"))


def count(p: DataFrame) -> DataFrame:
    """(rep, nv, nparts): vertices and parts of each partition; labels are 1..nparts."""
    return p.groupBy("rep").agg(F.count("*").alias("nv"), F.max("part").cast("long").alias("nparts"))


def average(p: DataFrame, y) -> DataFrame:
    """(rep, part, k, z): means by part of a signal (id, k, y) in which absent rows are 0, or of a constant."""
    if not isinstance(y, DataFrame):
        return sizes(p).select("rep", "part", F.lit(0).alias("k"), F.lit(float(y)).alias("z"))
    total = total_by_part(p, y)
    return total.join(sizes(p), ["rep", "part"]).select("rep", "part", "k", (F.col("z") / F.col("size")).alias("z"))


def total_by_part(p: DataFrame, y: DataFrame) -> DataFrame:
    """(rep, part, k, z): sums by part."""
    return p.join(y, "id").groupBy("rep", "part", "k").agg(F.sum("y").alias("z"))


def propagate(p: DataFrame, z: DataFrame) -> DataFrame:
    """(rep, id, k, y): each part's value at all its vertices."""
    return p.join(z, ["rep", "part"]).select("rep", "id", "k", F.col("z").alias("y"))


def apply(p: DataFrame, y: DataFrame) -> DataFrame:
    """(rep, id, k, y): the mean of each vertex' part."""
    return propagate(p, average(p, y))


def diagonal(p: DataFrame) -> DataFrame:
    """(rep, id, v): one over the size of the vertex' part."""
    return p.join(sizes(p), ["rep", "part"]).select("rep", "id", (1 / F.col("size")).alias("v"))


def apply_weighted(p: DataFrame, y: DataFrame, q: DataFrame) -> DataFrame:
    """(rep, id, k, y): means of each part weighted by q (id, q)."""
    weight = p.join(q, "id").groupBy("rep", "part").agg(F.sum("q").alias("wq"))
    z = p.join(y, "id").join(q, "id").groupBy("rep", "part", "k").agg(F.sum(F.col("q") * F.col("y")).alias("s"))
    return propagate(p, z.join(weight, ["rep", "part"]).select("rep", "part", "k", (F.col("s") / F.col("wq")).alias("z")))


def reduced_graph(g: Graph, p: DataFrame) -> Graph:
    """The quotient graph of one partition (id, part): crossing weights add up, inner ones go."""
    a, b = p.select(F.col("id").alias("src"), F.col("part").alias("a")), p.select(F.col("id").alias("dst"), F.col("part").alias("b"))
    crossing = g.edges.where("src < dst").join(a, "src").join(b, "dst").where("a <> b")
    pairs = crossing.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    return Graph.from_edges(pairs, p.select(F.col("part").alias("id")).distinct())

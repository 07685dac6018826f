"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.functions.skew import lookup
from sylvan.plans.ground import Rounds, ground
from sylvan.sources.graph import Graph


def connected_components(g: Graph, max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id of each vertex' part. Labels go to neighbours as minima, which
    combine before the shuffle, and then jump to their label's label, in a join that splits the labels
    that many share. The table is grounded each round and only one test a round comes to the driver."""
    edges, keep = ground(g.edges.select("src", "dst")), Rounds()
    label = keep(g.vertices.select("id", F.col("id").alias("c")))
    n = label.count()
    for _ in range(max_rounds):
        near = edges.join(label.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        low = label.join(near, "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("m"))
        shared = label.select(F.col("id").alias("m"), F.col("c").alias("further")).join(low.groupBy("m").agg(F.count("*").alias("n")), "m")
        least = F.least("m", "further")
        jump = keep(lookup(low, shared, ["m"], "n", n, ["id"], "inner").select("id", least.alias("c"), (least < F.col("c")).alias("moved")))
        label = jump.select("id", "c")
        if not jump.where("moved").limit(1).count():
            return label.withColumnRenamed("c", "component")
    raise RuntimeError("components did not settle")


def is_connected(g: Graph) -> bool:
    return connected_components(g).select("component").distinct().limit(2).count() <= 1

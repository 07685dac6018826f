"""Random successors: uniform, weighted by inverse distribution, and from alias tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.functions.rng import uniform
from sylvan.plans.ground import ground
from sylvan.sources.graph import Graph, cell_of, totals


def random_successor_uniform(g: Graph, draws: DataFrame, seed: int = 0) -> DataFrame:
    """(draw, id, next): a uniform neighbour for each row (draw, id); null for isolated vertices."""
    v = uniform("v", seed, F.col("draw"), F.col("id"))
    out = draws.join(g.neighbors(), "id").withColumn("slot", F.floor(v * F.col("n_neighbors")).cast("int"))
    return out.select("draw", "id", F.get("neighbors", F.col("slot")).alias("next"))


def random_successor_weighted(g: Graph, draws: DataFrame, seed: int = 0) -> DataFrame:
    """(draw, id, next): a neighbour with chances as the weights, by cumulative intervals; null for isolated
    vertices. A draw meets the intervals of one cell (``Graph.draw_index``), not the neighbourhood."""
    index = ground(g.draw_index())
    whole = totals(index)
    at = draws.join(whole, "id").withColumn("t", uniform("v", seed, F.col("draw"), F.col("id")) * F.col("d"))
    at = at.withColumn("cell", cell_of(F.col("t"), F.col("d"), F.col("n"))).select("draw", "id", "t", "cell")
    hit = at.join(index.select("id", "cell", "dst", "lo", "hi"), ["id", "cell"]).where("lo <= t and t < hi")
    return draws.join(hit.select("draw", "id", F.col("dst").alias("next")), ["draw", "id"], "left").select("draw", "id", "next")


def _alias(e: DataFrame, by: list[str], item: str) -> DataFrame:
    """(*by, slot, item, prob, alias) from (*by, item, weight): slot s keeps its item with chance prob, else gives alias.

    A group's slots are as many as its items, in their order. Laid end to end, the parts that
    slots lack of an average share and the parts that others have beyond it cover the same line. A poor
    slot is filled from the rich one in whose stretch its own begins; a rich one gives until the poor
    stretch that first reaches beyond its own ends, and what it then lacks comes from the next rich
    one. So one sort by position gives every alias, and no group's items are held in memory.
    """
    each, before = Window.partitionBy(*by), Window.partitionBy(*by, "rich").orderBy(item).rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("weight") * F.count("*").over(each) / F.sum("weight").over(each)
    e = e.withColumn("share", share).withColumns({"slot": F.row_number().over(each.orderBy(item)) - 1, "rich": F.col("share") >= 1})
    e = e.withColumn("lo", F.coalesce(F.sum(F.abs(F.col("share") - 1)).over(before), F.lit(0.0)))
    # ends that rounding alone tells apart are one; lengths come from the ends as they are
    e = e.withColumn("stop", F.col("lo") + F.abs(F.col("share") - 1)).withColumns({"start": F.round("lo", 9), "end": F.round("stop", 9)})
    # the rich slot that a position lies in, and the first poor end from a position on
    starts = each.orderBy("start", F.desc("rich"), item).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("giver", F.last(F.when(F.col("rich"), F.col(item)), True).over(starts))
    ends = each.orderBy("end", F.desc("rich"), item).rowsBetween(0, Window.unboundedFollowing)
    e = e.withColumn("reached", F.first(F.when(~F.col("rich"), F.col("stop")), True).over(ends))
    following = Window.partitionBy(*by, "rich").orderBy(item)
    e = e.withColumn("next_rich", F.lead(item).over(following))
    gives = F.col("rich") & F.col("next_rich").isNotNull() & (F.round("reached", 9) > F.col("end"))
    prob = F.when(~F.col("rich"), F.col("share")).when(gives, 1 + F.col("stop") - F.col("reached")).otherwise(1.0)
    alias = F.when(~F.col("rich"), F.coalesce("giver", item)).when(gives, F.col("next_rich")).otherwise(F.col(item))
    return e.select(*by, F.col("slot").cast("int").alias("slot"), item, prob.alias("prob"), alias.alias("alias"))


def alias_preprocess(g: Graph) -> DataFrame:
    """(src, slot, dst, prob, alias): a table for each vertex, one window a vertex; see ``alias_levels`` for hubs."""
    return _alias(g.edges, ["src"], "dst")


def alias_levels(g: Graph, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Alias tables in two levels, for graphs with hubs: (src, slot, chunk, prob, alias) over the chunks of a vertex, and
    (src, chunk, slot, dst, prob, alias) inside them. A vertex of n neighbours has ceil(n / most) chunks by a
    hash of the neighbour, so that no window holds more than some ``most`` neighbours or chunks of a vertex."""
    n = g.edges.groupBy("src").agg(F.ceil(F.count("*") / most).alias("parts"))
    e = ground(g.edges.join(n, "src").select("src", F.pmod(F.xxhash64("dst", F.lit(29)), F.col("parts")).alias("chunk"), "dst", "weight"))
    return _alias(e.groupBy("src", "chunk").agg(F.sum("weight").alias("weight")), ["src"], "chunk"), _alias(e, ["src", "chunk"], "dst")


def alias_draw_levels(chunks: DataFrame, slots: DataFrame, draws: DataFrame, seed: int = 0) -> DataFrame:
    """(draw, id, next) in constant time a draw: one equi-join by chunk slot and one by slot inside the chunk."""

    def picked(at: DataFrame, table: DataFrame, by: list[str], tag: str, item: str) -> DataFrame:
        key = (seed, F.col("draw"), F.col("id"))
        at = at.join(table.groupBy(*by).agg(F.count("*").alias("n")), by)
        at = at.withColumns({"slot": F.floor(uniform(f"{tag}s", *key) * F.col("n")).cast("int"), "v": uniform(f"{tag}a", *key)})
        hit = at.join(table, [*by, "slot"])
        return hit.select("draw", *by, F.when(F.col("v") < F.col("prob"), F.col(item)).otherwise(F.col("alias")).alias(item))

    at = picked(draws, chunks.withColumnRenamed("src", "id"), ["id"], "c", "chunk")
    return picked(at, slots.withColumnRenamed("src", "id"), ["id", "chunk"], "", "dst").select("draw", "id", F.col("dst").alias("next"))


def alias_shares(table: DataFrame) -> DataFrame:
    """(src, dst, p): the chances that a table encodes."""
    n = table.groupBy("src").agg(F.count("*").alias("n"))
    parts = table.select("src", "dst", F.col("prob").alias("p")).union(table.select("src", F.col("alias").alias("dst"), (1 - F.col("prob")).alias("p")))
    return parts.groupBy("src", "dst").agg(F.sum("p").alias("p")).join(n, "src").select("src", "dst", (F.col("p") / F.col("n")).alias("p"))


def alias_draw(table: DataFrame, draws: DataFrame, seed: int = 0) -> DataFrame:
    """(draw, id, next) in constant time a draw: an equi-join on (vertex, slot)."""
    n = table.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    key = (seed, F.col("draw"), F.col("id"))
    at = draws.join(n, "id").withColumns({"slot": F.floor(uniform("s", *key) * F.col("n")).cast("int"), "v": uniform("a", *key)})
    hit = at.join(table.withColumnRenamed("src", "id"), ["id", "slot"])
    return hit.select("draw", "id", F.when(F.col("v") < F.col("prob"), F.col("dst")).otherwise(F.col("alias")).alias("next"))

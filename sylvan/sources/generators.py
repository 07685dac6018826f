"""Generated graphs; ids start at 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.rng import uniform
from sylvan.functions.skew import spread
from sylvan.plans.ground import ground
from sylvan.sources.graph import Graph

#: Bull graph and Tutte graph as edge lists (fixed values).
BULL = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 4)]
TUTTE = [
    (0, 1), (0, 2), (0, 3), (1, 4), (1, 26), (2, 10), (2, 11), (3, 18), (3, 19), (4, 5), (4, 33), (5, 6), (5, 29), (6, 7), (6, 27), (7, 8),
    (7, 14), (8, 9), (8, 38), (9, 10), (9, 37), (10, 39), (11, 12), (11, 39), (12, 13), (12, 35), (13, 14), (13, 15), (14, 34), (15, 16),
    (15, 22), (16, 17), (16, 44), (17, 18), (17, 43), (18, 45), (19, 20), (19, 45), (20, 21), (20, 41), (21, 22), (21, 23), (22, 40), (23, 24),
    (23, 27), (24, 25), (24, 32), (25, 26), (25, 31), (26, 33), (27, 28), (28, 29), (28, 32), (29, 30), (30, 31), (30, 33), (31, 32), (34, 35),
    (34, 38), (35, 36), (36, 37), (36, 39), (37, 38), (40, 41), (40, 44), (41, 42), (42, 43), (42, 45), (43, 44),
]


def lattice(spark: SparkSession, *dims: int, periodic: bool = False) -> Graph:
    """Grid of the given sizes; the first dimension runs fastest, as in a column-major image."""
    total = 1
    for d in dims:
        total *= d
    ids, stride, edges = spark.range(total), 1, None
    for d in dims:
        at = F.floor(F.col("id") / stride) % d
        step = ids.select(F.col("id").alias("a"), at.alias("at"))
        if periodic and d > 2:
            e = step.select("a", (F.col("a") + F.when(F.col("at") == d - 1, -(d - 1) * stride).otherwise(stride)).alias("b"))
        else:
            e = step.where(F.col("at") < d - 1).select("a", (F.col("a") + stride).alias("b"))
        edges = e if edges is None else edges.union(e)
        stride *= d
    return Graph.from_edges(edges, ids)


def cycle(spark: SparkSession, n: int) -> Graph:
    return lattice(spark, n, periodic=True)


def wheel(spark: SparkSession, n: int) -> Graph:
    """A hub 0 and a cycle of the other n - 1 vertices."""
    rim = spark.range(1, n).select(F.col("id").alias("a"), (F.col("id") % (n - 1) + 1).alias("b"))
    return Graph.from_edges(rim.union(spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))), spark.range(n))


def listed(spark: SparkSession, edges: list[tuple[int, int]]) -> Graph:
    return Graph.from_edges(spark.createDataFrame(edges, "a long, b long"))


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """All unordered pairs a < b."""
    return spark.range(n * (n - 1) // 2).select(*_numbered(F.col("id")))


def _numbered(k):
    """The pair (a, b), a < b, of number k: b has b (b - 1) / 2 <= k."""
    b = F.floor((1 + F.sqrt(8.0 * k + 1)) / 2).cast("long")
    b = F.when(b * (b - 1) / 2 > k, b - 1).otherwise(b)
    return (k - b * (b - 1) / 2).cast("long").alias("a"), b.alias("b")


def erdos_renyi(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """Exactly m pairs: the first m different ones of a sequence of drawn pair numbers. For more than half of
    all pairs the ones left out are drawn."""
    total = n * (n - 1) // 2
    want, drawn = min(m, total - m), 0
    while True:
        drawn = max(2 * drawn, 2 * want + 64)
        drawn_pairs = spread(spark.range(drawn).select(F.floor(uniform("er", seed, F.col("id")) * total).alias("k"), "id"), drawn, "k")
        firsts = ground(drawn_pairs.groupBy("k").agg(F.min("id").alias("first")))
        if not want or firsts.count() >= want:
            break
    kept = _earliest(firsts, want).select("k") if want else firsts.where("false").select("k")
    if want < m:
        kept = spark.range(total).withColumnRenamed("id", "k").join(kept, "k", "left_anti")
    return Graph.from_edges(kept.select(*_numbered(F.col("k"))), spark.range(n), m)


#: Ranges that a search for a rank counts at once.
RANGES = 1024


def _earliest(firsts: DataFrame, want: int) -> DataFrame:
    """The ``want`` rows of the smallest ``first``, which differ. The last of them is found by counting ranges, then ranges
    of the one that holds it, so that rows are neither sorted nor brought together."""
    low, high = firsts.agg(F.min("first"), F.max("first")).first()
    left = want
    while low < high:
        width = (high - low) // RANGES + 1
        counts = firsts.where(F.col("first").between(low, high)).groupBy(F.floor((F.col("first") - low) / width).alias("part")).count()
        for part, n in sorted(counts.collect()):
            if n >= left:
                low, high = low + part * width, min(low + (part + 1) * width - 1, high)
                break
            left -= n
    return firsts.where(F.col("first") <= low)


def random_weighted(spark: SparkSession, n: int, density: float, seed: int = 0) -> Graph:
    """Weights U + U' of a random sparse matrix U, without its diagonal."""
    half = lambda tag: F.when(uniform(f"in{tag}", seed, F.col("a"), F.col("b")) < density, uniform(f"w{tag}", seed, F.col("a"), F.col("b"))).otherwise(0.0)
    return Graph.from_edges(_pairs(spark, n).withColumn("weight", half(1) + half(2)).where("weight > 0"), spark.range(n))


def preferential(spark: SparkSession, n: int, k: int, seed: int = 0) -> Graph:
    """Each vertex from k on joins up to k earlier ones with chances as their degrees: it takes the ends of
    edges made before it. An end that was itself taken from an edge points back at that edge, so all
    ends are found together by following pointers (Batagelj and Brandes, 2005). The first such
    vertex joins all k before it; a vertex that takes another twice joins it once."""
    from sylvan.plans.ground import Rounds

    made = spark.range((n - k) * k).select(F.col("id").alias("edge"), (k + F.floor(F.col("id") / k)).alias("v"))
    # end 2e of edge e is its vertex v, end 2e + 1 what it took
    at = F.floor(uniform("ba", seed, F.col("edge")) * (2 * k * F.floor(F.col("edge") / k))).cast("long")
    ends = made.withColumn("at", F.when(F.col("edge") >= k, at))
    vertex = lambda end: k + F.floor(F.floor(end / 2) / k)
    ends = ends.withColumns({"took": F.when(F.col("edge") < k, F.col("edge")).when(F.col("at") % 2 == 0, vertex(F.col("at"))), "back": F.when(F.col("at") % 2 == 1, F.floor(F.col("at") / 2))})
    keep = Rounds()
    ends = keep(ends.select("edge", "v", "took", "back"))
    while ends.where("took is null").limit(1).count():
        way = ends.select(F.col("edge").alias("back"), F.col("took").alias("took2"), F.col("back").alias("back2"))
        step = ends.where("took is null").join(way, "back").select("edge", "v", F.col("took2").alias("took"), F.col("back2").alias("back"))
        ends = keep(ends.where("took is not null").unionByName(step))
    return Graph.from_edges(ends.select(F.col("took").alias("a"), F.col("v").alias("b")).distinct(), spark.range(n))

"""Spectral moments (1/n) sum_i (q / (q + lambda_i))^k from fixed points of composed root maps."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.functions.rng import uniform
from sylvan.operators.forest import random_forest, rates
from sylvan.plans.ground import Rounds, ground
from sylvan.plans.smoothing import chebyshev
from sylvan.sources.graph import Graph

#: Names of algorithms. All coupled ones give the same law and here the same forests.
COUPLED = ("standard", "standard_pq", "leaves", "leaves_pq")


def self_roots(forests: DataFrame) -> DataFrame:
    """(n_self): vertices that the composition of all root maps, in the order of rep, leaves in place."""
    at = forests.where("rep = 0").select("id", F.col("root").alias("at"))
    for r in range(1, (forests.agg(F.max("rep")).first()[0] or 0) + 1):
        at = at.join(forests.where(F.col("rep") == r).select(F.col("id").alias("at"), F.col("root").alias("further")), "at").select("id", F.col("further").alias("at"))
    return at.agg(F.sum((F.col("id") == F.col("at")).cast("long")).alias("n_self"))


def n_self_roots(maps: DataFrame, nm: int) -> DataFrame:
    """(run, q_index, k, count): fixed points of the compositions of all k-subsets, in increasing order, of
    nm root maps (run, m, q_index, id, root), divided by the number of subsets.

    Subsets are counted, not listed: ``ways`` says how many k-subsets of the maps so far lead a vertex to
    another. Map by map each of them is left out or applied. A vertex has a row for each place it can be at
    and each k, so that the rows grow with the maps and not with their subsets."""
    keep = Rounds("ways")
    ids = maps.where("m = 0").select("run", "q_index", "id")
    ways = ids.select("run", "q_index", "id", F.col("id").alias("at"), F.lit(0).alias("k"), F.lit(1).cast("decimal(38,0)").alias("ways"))
    for m in range(nm):
        on = maps.where(F.col("m") == m).select("run", "q_index", F.col("id").alias("at"), F.col("root").alias("further"))
        more = ways.join(on, ["run", "q_index", "at"]).select("run", "q_index", "id", F.col("further").alias("at"), (F.col("k") + 1).alias("k"), "ways")
        ways = ways.unionByName(more).groupBy("run", "q_index", "id", "at", "k").agg(F.sum("ways").cast("decimal(38,0)").alias("ways"))
        ways = keep(ways)
    subsets = F.element_at(F.array(*(F.lit(float(comb(nm, k))) for k in range(1, nm + 1))), F.col("k"))
    hits = ways.where("k > 0").groupBy("run", "q_index", "k").agg(F.sum(F.when(F.col("id") == F.col("at"), F.col("ways")).otherwise(0)).cast("double").alias("n"))
    return hits.select("run", "q_index", "k", (F.col("n") / subsets).alias("count"))


def root_maps(g: Graph, grid: list[float], nm: int, runs: int = 1, algo: str = "standard", seed: int = 0) -> DataFrame:
    """(run, m, q_index, id, root) for an ascending grid of q."""
    if algo.lower().lstrip(":") not in (*COUPLED, "indep"):
        raise ValueError(f"unknown algorithm {algo}")
    if min(grid) <= 0:
        raise ValueError("q must be positive")
    f = random_forest(g, None, runs * nm, seed, grid=sorted(grid), moment_seeds=algo.lower().lstrip(":") == "indep")
    return f.select(F.floor(F.col("rep") / nm).cast("int").alias("run"), (F.col("rep") % nm).alias("m"), "q_index", "id", "root")


def _with_q(df: DataFrame, grid: list[float]) -> DataFrame:
    return df.withColumn("q", F.element_at(F.array(*map(F.lit, map(float, sorted(grid)))), F.col("q_index") + 1))


def coupled_forests_moments(g: Graph, grid: list[float], nm: int, algo: str = "standard", seed: int = 0) -> DataFrame:
    """(q, k, count) of one run."""
    return _with_q(n_self_roots(root_maps(g, grid, nm, 1, algo, seed), nm), grid).select("q", "k", "count")


coupled_forests = coupled_forests_moments


def fake_coupled_forests(g: Graph, grid: list[float], nm: int, seed: int = 0) -> DataFrame:
    """The same with independent forests for each q and moment."""
    return coupled_forests_moments(g, grid, nm, "indep", seed)


def collect_moments(g: Graph, grid: list[float], nm: int, runs: int, algo: str = "standard", seed: int = 0, empirical: bool = False) -> DataFrame:
    """(q, k, y, var): means over runs, at least 1, over n, with an upper bound of the variance: the crude one, or
    with ``empirical`` the smaller of it and twice the observed one (0 becomes 1e-18)."""
    n = g.nv()
    counts = n_self_roots(root_maps(g, grid, nm, runs, algo, seed), nm)
    each = _with_q(counts.groupBy("q_index", "k").agg(F.sum("count").alias("s"), F.var_pop("count").alias("v")), grid)
    y = F.greatest(F.col("s") / runs, F.lit(1.0)) / n
    subsets = F.element_at(F.array(*(F.lit(float(comb(nm, k))) for k in range(1, nm + 1))), F.col("k"))
    crude = y / (runs * n * subsets)
    var = crude
    if empirical:
        var = F.least(crude, 2 * F.col("v") / (runs * n * n))
        var = F.when(var == 0, 1e-18).otherwise(var)
    return each.select("q", "k", y.alias("y"), var.alias("var"))


def eigenvalues(g: Graph, dense: int = 2000) -> DataFrame:
    """(i, value) of the Laplacian, in one task; for checks on small graphs."""
    if g.nv() > dense:
        raise ValueError(f"eigenvalues are only for at most {dense} vertices")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["i"])
        mat = np.zeros((len(ids), len(ids)))
        np.add.at(mat, (np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])), pdf["v"].to_numpy())
        return pd.DataFrame({"i": range(len(ids)), "value": np.linalg.eigvalsh(mat)})

    return g.laplacian().groupBy(F.lit(0).alias("all")).applyInPandas(solve, "i int, value double")


def true_moments(eigs: DataFrame, grid: list[float], nm: int) -> DataFrame:
    """(q, k, y, var) from eigenvalues; the variance stands for rounding."""
    spark = eigs.sparkSession
    qs, ks = spark.createDataFrame([(float(q),) for q in sorted(grid)], "q double"), spark.range(1, nm + 1).select(F.col("id").cast("int").alias("k"))
    each = eigs.crossJoin(F.broadcast(qs)).crossJoin(F.broadcast(ks))
    y = each.groupBy("q", "k").agg(F.avg(F.pow(F.col("q") / (F.col("q") + F.greatest("value", F.lit(0.0))), F.col("k"))).alias("y"))
    return y.withColumn("var", F.greatest((1e-5 * F.col("y")) ** 2, F.lit(1e-20)))


def trace_moments(g: Graph, grid: list[float], nm: int, probes: int = 8, seed: int = 0) -> DataFrame:
    """(q, k, y, bound): the moments of graphs of any size, without eigenvalues, from the traces of (q / (q + L))^k.

    A probe z of random signs gives z' K^k z, whose mean is the trace, from solutions K z, K (K z), ... of
    smoothing systems (Hutchinson, 1990), all probes at once; k and k + 1 come from one solution. K has
    eigenvalues up to 1, so an estimate from p probes varies by sqrt(2 y / (n p)) at most, and ``bound``
    is four times that for the largest y that the estimate allows."""
    spark = g.edges.sparkSession
    ids = ground(g.vertices.crossJoin(F.broadcast(spark.range(probes).select(F.col("id").cast("int").alias("k")))))
    z = ids.select("id", "k", F.when(uniform("probe", seed, F.col("k"), F.col("id")) < 0.5, -1.0).otherwise(1.0).alias("y"))
    out = None
    for q in sorted(map(float, grid)):
        v = z
        for half in range(1, nm // 2 + nm % 2 + 1):
            x = chebyshev(g, rates(g, q), v)
            both = v.join(x, ["id", "k"]).groupBy("k").agg(F.sum(F.col("y") * F.col("x")).alias("odd"), F.sum(F.col("x") * F.col("x")).alias("even"), F.count("*").alias("n"))
            pair = both.agg(*(F.avg(F.col(c) / F.col("n")).alias(c) for c in ("odd", "even")), F.max("n").alias("n"))
            for k, c in ((2 * half - 1, "odd"), (2 * half, "even")):
                if k <= nm:
                    one = pair.select(F.lit(q).alias("q"), F.lit(k).alias("k"), F.col(c).alias("y"), (4 * F.sqrt(2 / (F.col("n") * probes))).alias("c"))
                    out = one if out is None else out.union(one)
            v = x.withColumnRenamed("x", "y")
    most = (F.col("c") + F.sqrt(F.col("c") ** 2 + 4 * F.greatest("y", F.lit(0.0)))) / 2
    return out.select("q", "k", "y", (F.col("c") * most).alias("bound"))


#: Samples of a q whose running sums are one window.
BLOCK = 4096


def mc_running_stats(samples: DataFrame) -> DataFrame:
    """(q_index, mc, mean, var): running mean and sample variance of (q_index, mc, value) over mc.

    Sums run inside blocks of mc, and the blocks' totals before a block are added to them, so that no window
    holds more than BLOCK samples or one row a block. Values count from the mean of their q, which
    keeps the difference of the sums exact."""
    pivot = samples.groupBy("q_index").agg(F.avg("value").alias("pivot"))
    x = samples.join(F.broadcast(pivot), "q_index").select("q_index", "mc", "pivot", F.floor(F.col("mc") / BLOCK).alias("block"), (F.col("value") - F.col("pivot")).alias("x"))
    upto = Window.partitionBy("q_index").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy("q_index", "block").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    before = totals.select("q_index", "block", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}0") for c in ("n", "s", "ss")))
    w = Window.partitionBy("q_index", "block").orderBy("mc").rowsBetween(Window.unboundedPreceding, 0)
    y = x.join(before, ["q_index", "block"]).select("q_index", "mc", "pivot", (F.col("n0") + F.count("*").over(w)).alias("n"), (F.col("s0") + F.sum("x").over(w)).alias("s"), (F.col("ss0") + F.sum(F.col("x") * F.col("x")).over(w)).alias("ss"))
    var = F.when(F.col("n") > 1, F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))
    return y.select("q_index", "mc", (F.col("pivot") + F.col("s") / F.col("n")).alias("mean"), var.alias("var"))


def first_moment_check(g: Graph, runs: int, algo: str = "standard", seed: int = 0, points: int = 5, dense: int = 2000) -> DataFrame:
    """(q, mc, mean, var, true_mean, true_var): running estimates of the number of roots on a log-spaced grid
    from mean degree / 100 to twice the largest degree, against sum q/(q+l) and sum q l/(q+l)^2. Above
    ``dense`` vertices these come from traces (``trace_moments``) instead of eigenvalues."""
    d = g.degree().agg(F.avg("d").alias("mean"), F.max("d").alias("most")).first()
    grid = np.geomspace(d["mean"] / 100, 2 * d["most"], points).tolist()
    counts = root_maps(g, grid, 1, runs, algo, seed).groupBy("q_index", F.col("run").alias("mc")).agg(F.sum((F.col("id") == F.col("root")).cast("double")).alias("value"))
    if g.nv() > dense:
        index = F.broadcast(g.edges.sparkSession.createDataFrame(list(enumerate(grid)), "q_index int, q double"))
        est = trace_moments(g, grid, 2, seed=seed).groupBy("q").agg(*(F.max(F.when(F.col("k") == k, F.col("y"))).alias(f"y{k}") for k in (1, 2)))
        truth = est.join(index, "q").select("q_index", "q", (g.nv() * F.col("y1")).alias("true_mean"), (g.nv() * (F.col("y1") - F.col("y2"))).alias("true_var"))
        return mc_running_stats(counts).join(truth, "q_index").select("q", "mc", "mean", "var", "true_mean", "true_var")
    truth = eigenvalues(g, dense).crossJoin(F.broadcast(g.edges.sparkSession.createDataFrame(list(enumerate(grid)), "q_index int, q double")))
    share = F.col("q") / (F.col("q") + F.greatest("value", F.lit(0.0)))
    truth = truth.groupBy("q_index", "q").agg(F.sum(share).alias("true_mean"), F.sum(share * (1 - share)).alias("true_var"))
    return mc_running_stats(counts).join(truth, "q_index").select("q", "mc", "mean", "var", "true_mean", "true_var")

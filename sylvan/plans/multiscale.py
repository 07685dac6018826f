"""Quotient graphs, hierarchies, multigrid and smoothing in subspaces."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators import partition as parts
from sylvan.operators.forest import random_forest
from sylvan.plans.ground import ground
from sylvan.plans.smoothing import DENSE, gradient_step, residual, rf_smoother, smooth, solve_cg
from sylvan.sources.generators import lattice
from sylvan.sources.graph import Graph


def smooth_ms(g: Graph, p: DataFrame, q: float, y: DataFrame) -> DataFrame:
    """(id, k, x): smoothing of part means on the quotient graph with q * size, propagated. p is (id, part)."""
    p = p.select(F.lit(0).alias("rep"), "id", "part")
    rate = parts.sizes(p).select(F.col("part").alias("id"), (q * F.col("size")).alias("q"))
    z = smooth(parts.reduced_graph(g, p), rate, parts.average(p, y).select(F.col("part").alias("id"), "k", F.col("z").alias("y")))
    return p.join(z.withColumnRenamed("id", "part"), "part").select("id", "k", "x")


def smooth_ms_min(g: Graph, p: DataFrame, q: float, y: DataFrame) -> DataFrame:
    """The same as the smallest objective among signals that are constant on parts, with the parts'
    indicators as a basis; equal to ``smooth_ms``."""
    basis = p.select("id", F.col("part").alias("b"), F.lit(1.0).alias("v"))
    coef = smooth_subspace(g, basis, q, y)
    return p.join(coef.withColumnRenamed("b", "part"), "part").select("id", "k", F.col("c").alias("x"))


def smooth_subspace(g: Graph, basis: DataFrame, q: float, y: DataFrame, dense: int = DENSE) -> DataFrame:
    """(b, k, c): coefficients q (q V'V + V'LV)^-1 V'y for basis entries (id, b, v). The matrices are sums by
    pairs of basis vectors that share a vertex or an edge. One task solves them for up to ``dense``
    basis vectors, conjugate gradients for more."""
    one, two = basis.select("id", F.col("b").alias("i"), F.col("v").alias("vi")), basis.select("id", F.col("b").alias("j"), F.col("v").alias("vj"))
    gram = one.join(two, "id").groupBy("i", "j").agg((q * F.sum(F.col("vi") * F.col("vj"))).alias("v"))
    lap = g.laplacian().join(one.select(F.col("id").alias("a"), F.col("i").alias("bi"), "vi"), F.col("i") == F.col("a")).select("j", "bi", F.col("v"), "vi")
    lap = lap.join(two.select(F.col("id").alias("c"), F.col("j").alias("bj"), "vj"), F.col("j") == F.col("c")).groupBy(F.col("bi").alias("i"), F.col("bj").alias("j")).agg(F.sum(F.col("v") * F.col("vi") * F.col("vj")).alias("v"))
    rhs = one.join(y, "id").groupBy("i", "k").agg((q * F.sum(F.col("vi") * F.col("y"))).alias("v"))
    if basis.select("b").distinct().limit(dense + 1).count() > dense:
        matrix = ground(gram.union(lap).groupBy("i", "j").agg(F.sum("v").alias("v")))
        diag = matrix.where("i = j").select("i", F.col("v").alias("diag"))
        full = diag.crossJoin(rhs.select("k").distinct()).join(rhs, ["i", "k"], "left")
        off = matrix.where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"), "v")
        found = solve_cg(off, full.select(F.col("i").alias("id"), "k", "diag", F.coalesce("v", F.lit(0.0)).alias("b")))
        return found.select(F.col("id").alias("b"), "k", F.col("x").alias("c"))
    rows = gram.union(lap).select(F.lit(0).alias("what"), "i", "j", "v").union(rhs.select(F.lit(1), "i", F.col("k").cast(gram.schema["j"].dataType), "v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        mat, sig = pdf[pdf["what"] == 0], pdf[pdf["what"] == 1]
        ids, ks = np.unique(mat["i"]), np.unique(sig["j"])
        m, b = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(ks)))
        np.add.at(m, (np.searchsorted(ids, mat["i"]), np.searchsorted(ids, mat["j"])), mat["v"].to_numpy())
        b[np.searchsorted(ids, sig["i"]), np.searchsorted(ks, sig["j"])] = sig["v"]
        c = np.linalg.solve(m, b)
        return pd.DataFrame({"b": np.repeat(ids, len(ks)), "k": np.tile(ks, len(ids)), "c": c.ravel()})

    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(solve, "b long, k int, c double")


@dataclass
class Hierarchy:
    """Graphs of levels 0..depth and the partitions (id, part) between them."""

    graphs: list[Graph]
    partitions: list[DataFrame]

    @classmethod
    def sample(cls, g: Graph, q: float, depth: int, seed: int = 0) -> Hierarchy:
        """Each level is the quotient of the one below by the trees of a forest, all with the same q."""
        graphs, partitions = [g], []
        for level in range(depth):
            p = ground(parts.partition(random_forest(graphs[-1], q, 1, seed + level)).select("id", F.col("part").cast("long").alias("part")))
            r = parts.reduced_graph(graphs[-1], p)
            graphs.append(Graph(ground(r.vertices), ground(r.edges)))
            partitions.append(p)
        return cls(graphs, partitions)

    @classmethod
    def line(cls, spark, n: int, depth: int) -> Hierarchy:
        """Paths of n, n/2, ... vertices, joined in pairs."""
        if n % 2**depth:
            raise ValueError(f"{n} does not halve {depth} times")
        graphs = [lattice(spark, n >> level) for level in range(depth + 1)]
        return cls(graphs, [grid_partition(spark, n >> level) for level in range(depth)])

    def depth(self) -> int:
        return len(self.partitions)

    def graph(self, level: int) -> Graph:
        return self.graphs[level]

    def partition(self, level: int) -> DataFrame:
        """From level - 1 to level, for level 1..depth."""
        return self.partitions[level - 1]

    def nv(self, level: int) -> int:
        return self.graphs[level].nv()

    def total_weights(self) -> DataFrame:
        """(level, id, w): how many vertices of level 0 each vertex stands for."""
        w = self.graphs[0].vertices.select(F.lit(0).alias("level"), "id", F.lit(1).cast("long").alias("w"))
        out = w
        for level, p in enumerate(self.partitions, 1):
            w = w.join(p, "id").groupBy(F.col("part").alias("id")).agg(F.sum("w").alias("w")).select(F.lit(level).alias("level"), "id", "w")
            out = out.union(w)
        return out

    def coarsen(self, x: DataFrame, level: int) -> DataFrame:
        """(id, x) of level + 1: sums over parts."""
        return x.join(self.partitions[level], "id").groupBy(F.col("part").alias("id")).agg(F.sum("x").alias("x"))

    def interpolate(self, x: DataFrame, level: int) -> DataFrame:
        """(id, x) of level - 1: each vertex takes its part's value."""
        return self.partitions[level - 1].join(x.withColumnRenamed("id", "part"), "part").select("id", "x")

    def __repr__(self) -> str:
        return f"Hierarchy(depth={self.depth()})"


@dataclass
class HSignal:
    """A signal (id, x) at a level of a hierarchy."""

    x: DataFrame
    hierarchy: Hierarchy
    level: int = 0

    def __post_init__(self):
        if not 0 <= self.level <= self.hierarchy.depth():
            raise ValueError("no such level")

    def coarsen(self) -> HSignal:
        return HSignal(self.hierarchy.coarsen(self.x, self.level), self.hierarchy, self.level + 1)

    def interpolate(self) -> HSignal:
        return HSignal(self.hierarchy.interpolate(self.x, self.level), self.hierarchy, self.level - 1)


def grid_partition(spark, n: int) -> DataFrame:
    """(id, part): consecutive vertices in pairs, numbered from 0."""
    return spark.range(n).select("id", F.floor(F.col("id") / 2).alias("part"))


def multigrid_step(h: Hierarchy, x0: DataFrame, y: DataFrame, q: DataFrame, level: int, smoother, exact: int = 40) -> DataFrame:
    """One cycle for (L + Q) x = Q y with rates (id, q): smooth, send the residual down, solve for the
    correction there, and add it. The coarse system is the one that the quotient graph and the
    summed rates give, so a cycle never moves the exact solution."""
    g = h.graph(level)
    if level == h.depth() or g.nv() < exact:
        return smooth(g, q, y.select("id", F.lit(0).alias("k"), "y")).select("id", "x")
    x = ground(smoother(g, q, y, x0))
    lx = g.laplacian_times(x)
    r = x.join(y, "id").join(q, "id").join(lx, "id").select("id", (F.col("q") * (F.col("y") - F.col("x")) - F.col("lx")).alias("x"))
    rate = h.coarsen(q.select("id", F.col("q").alias("x")), level).select("id", F.col("x").alias("q"))
    down = ground(h.coarsen(r, level).join(rate, "id").select("id", (F.col("x") / F.col("q")).alias("y")))
    zero = down.select("id", F.lit(0.0).alias("x"))
    up = h.interpolate(multigrid_step(h, zero, down, ground(rate), level + 1, smoother, exact), level + 1)
    return ground(x.join(up.withColumnRenamed("x", "e"), "id").select("id", (F.col("x") + F.col("e")).alias("x")))


def multigrid_solve(h: Hierarchy, y: DataFrame, q: float, smoother: str = "gd", alpha: float = 0.1, steps: int = 10, seed: int = 0) -> DataFrame:
    """(id, x) after ``steps`` cycles from x = y, with gradient steps ('gd') or forests ('rf')."""

    def gd(g, rate, sig, x):
        new = x.join(sig, "id").join(rate, "id").join(g.laplacian_times(x), "id").join(g.degree(), "id")
        step = (F.col("lx") + F.col("q") * (F.col("x") - F.col("y"))) / F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)
        return new.select("id", (F.col("x") - alpha * step).alias("x"))

    def rf(g, rate, sig, x):
        p = parts.partition(random_forest(g, rate, 1, seed))
        means = parts.apply_weighted(p, sig.select("id", F.lit(0).alias("k"), "y"), rate)
        return means.select("id", F.col("y").alias("x"))

    if smoother not in ("gd", "rf"):
        raise ValueError(f"unknown smoother {smoother}")
    y = ground(y.select("id", "y"))
    rate, x = ground(h.graph(0).vertices.select("id", F.lit(float(q)).alias("q"))), y.select("id", F.col("y").alias("x"))
    for _ in range(steps):
        x = multigrid_step(h, x, y, rate, 0, gd if smoother == "gd" else rf)
    return x


__all__ = ["HSignal", "Hierarchy", "gradient_step", "grid_partition", "multigrid_solve", "multigrid_step", "residual", "rf_smoother", "smooth_ms", "smooth_ms_min", "smooth_subspace"]

"""Tikhonov smoothing x = (L + Q)^-1 Q y of signals (id, k, y), exactly and over random forests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators import partition as parts
from sylvan.operators.forest import apply_roots, nroots, random_forest, rates
from sylvan.plans.ground import Rounds, ground
from sylvan.plans.tiles import Tiles
from sylvan.sources.graph import Graph

#: Vertices up to which a system is solved densely in one task; above it, by iterations over tables.
DENSE = 2000


def smooth(g: Graph, q, y: DataFrame, dense: int = DENSE) -> DataFrame:
    """(id, k, x). q is a number or (id, q) rows; rows that y lacks are 0. Systems of more than ``dense`` vertices
    are solved by Chebyshev iterations over tables."""
    rate, y = rates(g, q), y.select("id", "k", "y")
    if g.nv() > dense:
        return chebyshev(g, rate, y)
    tagged = (
        g.laplacian().select(F.lit(0).alias("what"), "i", "j", "v")
        .union(rate.select(F.lit(1), "id", "id", "q"))
        .union(y.select(F.lit(2), "id", F.col("k").cast("long"), "y"))
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        lap, rate, sig = (pdf[pdf["what"] == k] for k in range(3))
        ids = np.sort(rate["i"].to_numpy())
        at = lambda x: np.searchsorted(ids, x.to_numpy())
        mat, q = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        np.add.at(mat, (at(lap["i"]), at(lap["j"])), lap["v"].to_numpy())
        q[at(rate["i"])] = rate["v"]
        ks = np.sort(sig["j"].unique())
        rhs = np.zeros((len(ids), len(ks)))
        rhs[at(sig["i"]), np.searchsorted(ks, sig["j"].to_numpy())] = sig["v"]
        x = np.linalg.solve(mat + np.diag(q), q[:, None] * rhs)
        return pd.DataFrame({"id": np.repeat(ids, len(ks)), "k": np.tile(ks, len(ids)), "x": x.ravel()})

    return tagged.groupBy(F.lit(0).alias("all")).applyInPandas(solve, "id long, k int, x double")


#: Edges in one row of a tile, steps in one job, and steps above which conjugate gradients take over.
CHUNK, STEPS, MOST_STEPS = 500_000, 2, 120


def chebyshev(g: Graph, rate: DataFrame, y: DataFrame, tol: float = 1e-12, powers: int = 4) -> DataFrame:
    """(id, k, x) by Chebyshev's semi-iteration on x = D^-1 (W x + Q y), D = degrees + Q, for all k at once.

    It needs no inner products, only a bound of the size of D^-1 W's eigenvalues: the ``powers``-th root of the
    largest entry of (D^-1 W)^powers 1, one number. From it the number of steps is known beforehand
    that brings the error below ``tol``, relative to the solution. Products run by tiles of edges (``Tiles``), so that
    blocks of values travel and not rows of vertices or edges, and STEPS steps make one job. If the bound is so near 1
    that it takes more than MOST_STEPS steps, conjugate gradients take over."""
    base = ground(g.degree().join(rate, "id").select("id", "q", (F.col("d") + F.col("q")).alias("diag")))
    kind = y.schema["k"].dataType.simpleString()
    ks = [r["k"] for r in y.where("k is not null").select("k").distinct().orderBy("k").collect()]
    if not ks or base.isEmpty():
        return y.select("id", "k", F.col("y").alias("x")).where("false")
    tiles = Tiles(g.edges, base, len(ks), CHUNK)
    state, keep = tiles.state(), Rounds("powers")
    for power in range(powers):
        state = tiles.step(state, 1.0)
        if (power + 1) % STEPS == 0 or power == powers - 1:
            state = keep(state)
    rho = max(state.agg(F.max("most")).first()[0], 0.0) ** (1 / powers) * (1 + 1e-9)
    steps = int(np.ceil(np.arccosh(2 / tol) / np.arccosh(1 / rho))) if 0 < rho < 1 else MOST_STEPS * int(rho > 0) + 1
    if steps > MOST_STEPS:
        tiles.drop()
        return conjugate_gradients(g, rate, y)
    state, keep, omega = tiles.state(y, ks), Rounds("chebyshev"), 2.0
    for step in range(steps):
        omega = 1.0 if step == 0 else 1 / (1 - rho**2 * omega / (2 if step == 1 else 4))
        state = tiles.step(state, omega)
        if (step + 1) % STEPS == 0 or step == steps - 1:
            state = keep(state)
    tiles.drop()
    return tiles.values(state, ks, kind)


def conjugate_gradients(g: Graph, rate: DataFrame, y: DataFrame, tol: float = 1e-10, max_rounds: int = 1000) -> DataFrame:
    """The same by conjugate gradients, all k at once."""
    diag = ground(g.degree().join(rate, "id").select("id", "q", (F.col("d") + F.col("q")).alias("diag")))
    full = diag.crossJoin(y.select("k").distinct()).join(y, ["id", "k"], "left")
    return solve_cg(g.edges.select("src", "dst", (-F.col("weight")).alias("v")), full.select("id", "k", "diag", (F.col("q") * F.coalesce("y", F.lit(0.0))).alias("b")), tol, max_rounds)


def solve_cg(off: DataFrame, system: DataFrame, tol: float = 1e-10, max_rounds: int = 1000) -> DataFrame:
    """(id, k, x) of A x = b for every k, by conjugate gradients with the diagonal as preconditioner. ``off``
    (src, dst, v) is the symmetric positive matrix without its diagonal, ``system`` (id, k, diag, b) the
    rest. Vectors stay tables; only the step sizes, a row for each k, come to the driver. Raises if it
    does not settle."""
    off, keep = ground(off), Rounds()
    start = F.col("b") / F.col("diag")
    state = keep(system.select("id", "k", "diag", F.lit(0.0).alias("x"), F.col("b").alias("r"), start.alias("p")))
    squares = lambda df: {r["k"]: r["v"] for r in df.groupBy("k").agg(F.sum(F.col("r") * F.col("r") / F.col("diag")).alias("v")).collect()}
    rz = squares(state)
    first = {k: max(v, 1e-300) for k, v in rz.items()}
    column = lambda values: F.create_map(*[F.lit(v) for k, x in values.items() for v in (k, float(x))])[F.col("k")] if values else F.lit(0.0)
    for _ in range(max_rounds):
        if all(rz[k] <= tol**2 * first[k] for k in rz):
            return state.select("id", "k", "x")
        ap = off.join(state.select(F.col("id").alias("dst"), "k", F.col("p").alias("pp")), "dst").groupBy(F.col("src").alias("id"), "k").agg(F.sum(F.col("v") * F.col("pp")).alias("ap"))
        state = keep(state.join(ap, ["id", "k"], "left").withColumn("ap", F.col("diag") * F.col("p") + F.coalesce("ap", F.lit(0.0))))
        pap = {r["k"]: r["v"] for r in state.groupBy("k").agg(F.sum(F.col("p") * F.col("ap")).alias("v")).collect()}
        alpha = column({k: rz[k] / pap[k] if pap[k] else 0.0 for k in rz})
        state = state.withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("ap")})
        new = squares(state)
        beta = column({k: new[k] / rz[k] if rz[k] else 0.0 for k in rz})
        state = keep(state.withColumn("p", F.col("r") / F.col("diag") + beta * F.col("p")).drop("ap"))
        rz = new
    raise RuntimeError(f"conjugate gradients did not settle in {max_rounds} rounds")


def smooth_rf(g: Graph, q, y: DataFrame, reps: int = 10, variant: int = 1, mean_correction: bool = False, seed: int = 0, forests: DataFrame | None = None) -> DataFrame:
    """(id, k, x): the mean over forests of the root's value (variant 1), or of the tree's mean, weighted by q if
    q varies (variant 2). ``mean_correction`` moves x to the mean that the exact solution keeps:
    that of y, weighted by q."""
    forests = random_forest(g, q, reps, seed) if forests is None else forests
    if variant == 1:
        each = apply_roots(forests, y)
    else:
        p = parts.partition(forests)
        each = parts.apply_weighted(p, y, rates(g, q)) if isinstance(q, DataFrame) else parts.apply(p, y)
    est = each.groupBy("id", "k").agg((F.sum("y") / reps).alias("x"))
    if not mean_correction:
        return est
    w = rates(g, q)
    shift = est.join(w, "id").groupBy("k").agg(F.sum(F.col("q") * F.col("x")).alias("sx"))
    aim = y.join(w, "id").groupBy("k").agg(F.sum(F.col("q") * F.col("y")).alias("sy"))
    both = shift.join(aim, "k").crossJoin(w.agg(F.sum("q").alias("sq"))).select("k", ((F.col("sy") - F.col("sx")) / F.col("sq")).alias("by"))
    return est.join(both, "k").select("id", "k", (F.col("x") + F.col("by")).alias("x"))


def mean_roots(forests: DataFrame) -> DataFrame:
    """(nroots): the mean number of roots."""
    return nroots(forests).agg(F.avg("nroots").alias("nroots"))


def sure(y: DataFrame, x: DataFrame, roots: DataFrame, s2: float) -> DataFrame:
    """(k, sure): Stein's estimate of the risk, -n s2 + |y - x|^2 + 2 s2 roots."""
    err = y.join(x, ["id", "k"]).groupBy("k").agg(F.count("*").alias("n"), F.sum((F.col("y") - F.col("x")) ** 2).alias("e"))
    return err.crossJoin(F.broadcast(roots)).select("k", (-F.col("n") * s2 + F.col("e") + 2 * s2 * F.col("nroots")).alias("sure"))


def objective(g: Graph, q: float, y: DataFrame, x: DataFrame) -> DataFrame:
    """(k, cost): q/2 |y - x|^2 + 1/2 x' L x."""
    data = y.join(x, ["id", "k"]).groupBy("k").agg(F.sum((F.col("y") - F.col("x")) ** 2).alias("e"))
    xs, xd = x.select(F.col("id").alias("src"), "k", F.col("x").alias("xs")), x.select(F.col("id").alias("dst"), "k", F.col("x").alias("xd"))
    rough = g.edges.where("src < dst").join(xs, "src").join(xd, ["dst", "k"]).groupBy("k").agg(F.sum(F.col("weight") * (F.col("xs") - F.col("xd")) ** 2).alias("l"))
    return data.join(rough, "k", "left").select("k", (q / 2 * F.col("e") + F.coalesce("l", F.lit(0.0)) / 2).alias("cost"))


def residual(g: Graph, q: float, y: DataFrame, x: DataFrame) -> DataFrame:
    """(id, x, res): x - y + L x / q for signals (id, y) and (id, x)."""
    return x.join(y.select("id", "y"), "id").join(g.laplacian_times(x), "id").select("id", "x", (F.col("x") - F.col("y") + F.col("lx") / q).alias("res"))


def gradient_step(g: Graph, q: float, y: DataFrame, x0: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(id, x, res): one step scaled by the Laplacian's diagonal; isolated vertices take the plain step."""
    lx = g.laplacian_times(x0)
    new = x0.join(y.select("id", "y"), "id").join(lx, "id").join(g.degree(), "id")
    step = (F.col("lx") + q * (F.col("x") - F.col("y"))) / F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)
    return residual(g, q, y, new.select("id", (F.col("x") - alpha * step).alias("x")))


def rf_smoother(g: Graph, q: float, y: DataFrame, x0: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(id, x, res): tree means of y over one forest; x0 is not used."""
    sig = y.select("id", F.lit(0).alias("k"), "y")
    x = parts.apply(parts.partition(random_forest(g, q, 1, seed)), sig).select("id", F.col("y").alias("x"))
    return residual(g, q, y, x)

"""Invariants and laws of forests, smoothing, moments and hierarchies."""

import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylvan.functions import skew
from sylvan.functions.rng import uniform, uniform_py
from sylvan.operators import connectivity, draws, forest
from sylvan.operators import partition as parts
from sylvan.plans import labels, moments, multiscale, smoothing
from sylvan.plans.ground import ground
from sylvan.sources import generators as gen
from sylvan.sources import tables
from sylvan.sources.graph import Graph

from .wilson import forests, walk


def dense(g):
    ids = sorted(r.id for r in g.vertices.collect())
    at = {v: k for k, v in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in g.edges.collect():
        w[at[r.src], at[r.dst]] = r.weight
    return ids, w


def as_array(df, col="x"):
    return np.array([r[col] for r in df.orderBy("id").collect()])


GRAPHS = {
    "grid": lambda s: gen.lattice(s, 4, 4),
    "cycle": lambda s: gen.cycle(s, 5),
    "wheel": lambda s: gen.wheel(s, 9),
    "bull": lambda s: gen.listed(s, gen.BULL),
    "tutte": lambda s: gen.listed(s, gen.TUTTE),
    "weighted": lambda s: gen.random_weighted(s, 6, 0.5, 3),
    "preferential": lambda s: gen.preferential(s, 30, 3, 1),
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("q", [0.1, 3.0])
def test_forest_is_correct(spark, name, q):
    g = GRAPHS[name](spark)
    g = Graph(ground(g.vertices), ground(g.edges))
    f = forest.random_forest(g, q, 3, 5)
    for r in forest.quality(g, f).collect():
        assert r.n == g.nv() and r.n_roots >= 1
        assert (r.bad_edges, r.bad_roots, r.unreached) == (0, 0, 0)


def test_tutte_is_cubic(spark):
    assert {r.d for r in GRAPHS["tutte"](spark).degree().collect()} == {3.0}


def test_both_samplers_agree(spark):
    g = gen.random_weighted(spark, 12, 0.4, 1)
    g = Graph(ground(g.vertices), ground(g.edges))
    a = forest.random_forest(g, 0.3, 3, 9).collect()
    b = forest.random_forest_distributed(g, 0.3, 3, 9).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


SAMPLED = {"weighted": lambda s: gen.random_weighted(s, 12, 0.4, 1), "lattice": lambda s: gen.lattice(s, 9, 7), "preferential": lambda s: gen.preferential(s, 60, 2, 3)}


def by_rows(f):
    return sorted(((r.rep, r.q_index, r.id, r.next, r.root, r.level) for r in f.collect()), key=str)


@pytest.mark.parametrize("name", SAMPLED)
def test_forests_equal_wilson_step_by_step(spark, name):
    """Also where stacks run out (low q), down a grid, with rates by vertex, and by joins until few are left."""
    g = SAMPLED[name](spark)
    g = Graph(ground(g.vertices), ground(g.edges))
    assert by_rows(forest.random_forest(g, 0.02, 3, 9)) == forests(g, [0.02], 3, 9)
    assert by_rows(forest.random_forest(g, 4.0, 3, 9, local=12)) == forests(g, [4.0], 3, 9)
    grid = [0.05, 3.0, 0.7]
    assert by_rows(forest.random_forest(g, None, 2, 4, grid=grid)) == forests(g, grid, 2, 4)
    q = g.vertices.select("id", F.when(F.col("id") % 7 == 0, 0.3).otherwise(0.0).alias("q"))
    assert by_rows(forest.random_forest(g, q, 2, 4)) == forests(g, [{r.id: r.q for r in q.collect()}], 2, 4)


def test_stacks_that_run_out_go_on(spark, monkeypatch):
    """With one arrow at a time at first, and a bounded task for what rounds of joins leave."""
    g = gen.random_weighted(spark, 8, 0.6, 3)
    g = Graph(ground(g.vertices), ground(g.edges))
    monkeypatch.setattr(forest, "FIRST", 1)
    monkeypatch.setattr(forest, "DEEPEST", 1)
    assert by_rows(forest.random_forest(g, None, 2, 7, grid=[0.3, 2.0])) == forests(g, [0.3, 2.0], 2, 7)
    assert by_rows(forest.random_forest(g, 0.8, 2, 7, local=7)) == forests(g, [0.8], 2, 7)


def hub(spark, n=1999):
    """A hub with fractional weights, whose sums round, and a neighbour of it with one edge more."""
    e = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"), (0.1 + F.col("id") % 7 / 10).alias("weight"))
    return Graph.from_edges(e.union(spark.createDataFrame([(1, 2, 0.3)], "a long, b long, weight double")))


@pytest.mark.parametrize("most", [100_000, 50])
def test_intervals_have_no_gap_and_no_overlap(spark, monkeypatch, most):
    """In one window and in chunks."""
    from sylvan.sources import graph

    monkeypatch.setattr(graph, "HUB", most)
    g = hub(spark)
    rows = sorted((r.lo, r.hi, r.dst, r.d, r.n) for r in g.cumulative().where("src = 0").collect())
    assert len(rows) == 1999 and rows[0][0] == 0 and rows[-1][1] == math.inf
    assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(rows, rows[1:]))
    assert [r[2] for r in rows] == list(range(1, 2000)) and {r[4] for r in rows} == {1999}
    assert {r[3] for r in rows} == {rows[0][3]} and abs(rows[0][3] - sum(0.1 + k % 7 / 10 for k in range(1, 2000))) < 1e-9
    # positions at and next to every edge lie in exactly one interval of their cell
    at = sorted({x for lo, *_ in rows for x in (lo, np.nextafter(lo, math.inf), max(np.nextafter(lo, 0), 0.0))} | {float(np.nextafter(rows[0][3], 0))})
    points = spark.createDataFrame([(0, float(t)) for t in at], "id long, t double").join(graph.totals(g.draw_index()), "id")
    hit = points.withColumn("cell", graph.cell_of(F.col("t"), F.col("d"), F.col("n"))).join(g.draw_index().drop("d", "n"), ["id", "cell"]).where("lo <= t and t < hi")
    got = {r.t: r["count"] for r in hit.groupBy("t").count().collect()}
    assert set(got) == set(at) and set(got.values()) == {1}
    cells = g.draw_index().where("id = 0").groupBy("cell").count()
    assert cells.count() == 1999 and cells.agg(F.max("count")).first()[0] <= 12


def test_a_draw_meets_a_cell_and_not_a_neighbourhood(spark):
    """Shares of weights, and how many rows the join gives."""
    g = hub(spark)
    points = spark.range(4000).select(F.lit(0).cast("long").alias("id"), F.col("id").alias("draw"))
    got = draws.random_successor_weighted(g, points, 3)
    assert got.where("next is null").count() == 0
    heavy = got.where("next % 7 = 6").count() / 4000
    assert abs(heavy - 0.7 * 285 / sum(0.1 + k % 7 / 10 for k in range(1, 2000))) < 0.03
    from sylvan.sources import graph

    at = points.join(graph.totals(g.draw_index()), "id").withColumn("t", uniform("v", 3, F.col("draw"), F.col("id")) * F.col("d"))
    met = at.withColumn("cell", graph.cell_of(F.col("t"), F.col("d"), F.col("n"))).join(g.draw_index().drop("d", "n"), ["id", "cell"]).count()
    assert met < 3 * 4000


def test_uniform_is_the_same_in_both_engines(spark):
    row = spark.range(3).select(uniform("u", 7, F.col("id"), F.lit(2)).alias("u")).collect()
    assert [r.u for r in row] == [uniform_py("u", 7, k, 2) for k in range(3)]


def test_root_law_and_number_of_roots(spark):
    g = gen.lattice(spark, 3, 3)
    ids, w = dense(g)
    q, reps = 0.7, 1500
    lap = np.diag(w.sum(axis=1)) - w
    k = q * np.linalg.inv(lap + q * np.eye(9))
    f = forest.random_forest(g, q, reps, 2).cache()
    hits = np.zeros((9, 9))
    for r in f.groupBy("id", "root").count().collect():
        hits[r.id, r.root] = r["count"] / reps
    assert np.abs(hits - k).max() < 5 * 0.5 / math.sqrt(reps)
    mean = forest.nroots(f).agg(F.avg("nroots")).first()[0]
    assert abs(mean - np.trace(k)) < 0.2


def test_spanning_trees_are_uniform(spark):
    k4 = gen.listed(spark, [(a, b) for a in range(4) for b in range(a)])
    trees = forest.spanning_tree(k4, 0, 1600, 4).where("next is not null").groupBy("rep").agg(F.sort_array(F.collect_list(F.concat_ws("-", F.least("id", "next"), F.greatest("id", "next")))).alias("t"))
    counts = [r["count"] for r in trees.groupBy("t").count().collect()]
    assert len(counts) == 16 and sum((c - 100) ** 2 / 100 for c in counts) < 37.7  # chi-square, 15 d.f., 0.001


def test_spanning_tree_refuses(spark):
    two = gen.listed(spark, [(0, 1), (2, 3)])
    with pytest.raises(IndexError):
        forest.spanning_tree(two, 9)
    with pytest.raises(ValueError):
        forest.spanning_tree(two, 0)
    assert forest.spanning_tree(two, 0, force=True).count() == 2
    with pytest.raises(ValueError):
        forest.random_forest(two, two.vertices.select("id", F.when(F.col("id") == 0, 1.0).otherwise(0.0).alias("q")))
    with pytest.raises(ValueError):
        forest.random_forest(two, 0.0)


@settings(deadline=None, max_examples=40)
@given(st.integers(2, 9), st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 5)), max_size=25), st.floats(0.05, 5), st.integers(0, 99))
def test_kernel_on_random_graphs(n, edges, q, seed):
    w = np.zeros((n, n))
    for a, b, x in edges:
        if a % n != b % n:
            w[a % n, b % n] = w[b % n, a % n] = x
    targets = [np.flatnonzero(w[i]) for i in range(n)]
    offsets = np.cumsum([0, *map(len, targets)])
    cum = np.concatenate([np.cumsum(w[i][t]) for i, t in enumerate(targets)]) if offsets[-1] else np.empty(0)
    nxt, root = walk(np.arange(n), offsets, np.concatenate(targets), cum, w.sum(axis=1), np.full(n, q), seed, 0, np.zeros(n, np.int64))
    for i in range(n):
        at, steps = i, 0
        while nxt[at] >= 0:
            assert w[at, nxt[at]] > 0
            at, steps = nxt[at], steps + 1
            assert steps <= n
        assert root[i] == at


def test_coupling_equals_cold_start(spark):
    g = gen.lattice(spark, 4, 4)
    both = forest.random_forest(g, None, 4, 3, grid=[0.2, 1.5])
    for k, q in enumerate([0.2, 1.5]):
        cold = forest.random_forest(g, q, 4, 3).select("rep", "id", "next", "root").collect()
        assert sorted(map(str, cold)) == sorted(map(str, both.where(F.col("q_index") == k).select("rep", "id", "next", "root").collect()))


def test_smoothing_keeps_eigenvectors(spark):
    g = gen.cycle(spark, 11)
    y = spark.range(11).select("id", F.lit(0).alias("k"), F.cos(2 * math.pi * F.col("id") / 11).alias("y"))
    x, ref = as_array(smoothing.smooth(g, 0.1, y)), as_array(y, "y")
    assert np.allclose(x / x[0], ref / ref[0])
    cg = as_array(smoothing.smooth(g, 0.1, y, dense=0))
    assert np.allclose(cg, x, atol=1e-8)


def test_partition_algebra(spark):
    g = gen.lattice(spark, 5, 5)
    f = forest.random_forest(g, 0.5, 1, 1)
    ids = g.vertices.select("id", F.lit(0).alias("k"), F.col("id").cast("double").alias("y"))
    got = forest.apply_roots(f, ids).join(f, "id")
    assert got.where("y <> root").count() == 0
    p, roots = parts.partition(f), f.select("id", F.lit(0).alias("k"), F.col("root").cast("double").alias("y"))
    assert parts.apply(p, roots).join(f, "id").where("abs(y - root) > 1e-9").count() == 0
    assert parts.diagonal(p).agg(F.sum("v")).first()[0] == pytest.approx(p.select("part").distinct().count())


def test_variants_and_mean_correction(spark):
    g = gen.lattice(spark, 4, 4)
    g = Graph(ground(g.vertices), ground(g.edges))
    y = ground(g.vertices.select("id", F.lit(0).alias("k"), uniform("y", 1, F.col("id")).alias("y")))
    exact = as_array(smoothing.smooth(g, 0.5, y))
    err = {v: np.mean([np.sum((as_array(smoothing.smooth_rf(g, 0.5, y, 20, v, seed=s)) - exact) ** 2) for s in range(3)]) for v in (1, 2)}
    assert err[2] <= err[1]
    centred = as_array(smoothing.smooth_rf(g, 0.5, y, 3, 1, True, 1))
    assert centred.mean() == pytest.approx(as_array(y, "y").mean())
    q = g.vertices.select("id", (F.col("id") % 3 + 0.5).alias("q"))
    qs, kept = as_array(q, "q"), as_array(smoothing.smooth_rf(g, q, y, 3, 2, True, 1))
    assert (qs * kept).sum() == pytest.approx((qs * as_array(y, "y")).sum())


def test_moments_match_truth(spark):
    g = gen.lattice(spark, 4, 3, periodic=True)
    grid, runs = [0.3, 1.0, 3.0], 300
    truth = {(r.q, r.k): r.y for r in moments.true_moments(moments.eigenvalues(g), grid, 3).collect()}
    for empirical in (False, True):
        for r in moments.collect_moments(g, grid, 3, runs, "leaves", 3, empirical).collect():
            assert abs(r.y - truth[r.q, r.k]) < 0.08 and r["var"] > 0
    with pytest.raises(ValueError):
        moments.coupled_forests(g, grid, 2, "nonsense")
    assert moments.fake_coupled_forests(g, grid, 2).count() == 6


def test_alias_tables_and_draws(spark):
    g = gen.random_weighted(spark, 8, 0.7, 2)
    table = ground(draws.alias_preprocess(g))
    share = draws.alias_shares(table).join(g.edges, ["src", "dst"], "full").join(g.degree().withColumnRenamed("id", "src"), "src")
    assert share.where("abs(p - weight / d) > 1e-9 or p is null").count() == 0
    rows = g.vertices.where("id < 2").crossJoin(spark.range(4000).select(F.col("id").cast("int").alias("draw")))
    ids, w = dense(g)
    for got in (draws.alias_draw(table, rows, 1), draws.random_successor_weighted(g, rows, 1)):
        for r in got.groupBy("id", "next").count().collect():
            assert abs(r["count"] / 4000 - w[r.id, r.next] / w[r.id].sum()) < 0.05


def test_multiscale_identities(spark):
    g = gen.random_weighted(spark, 10, 0.6, 4)
    g = Graph(ground(g.vertices), ground(g.edges))
    p = g.vertices.select("id", (F.col("id") % 4).alias("part"))
    y = g.vertices.select("id", F.lit(0).alias("k"), uniform("y", 2, F.col("id")).alias("y"))
    assert np.allclose(as_array(multiscale.smooth_ms(g, p, 0.4, y)), as_array(multiscale.smooth_ms_min(g, p, 0.4, y)))
    h = multiscale.Hierarchy.sample(g, 1.0, 2, 3)
    assert {r.s for r in h.total_weights().groupBy("level").agg(F.sum("w").alias("s")).collect()} == {10}
    with pytest.raises(ValueError):
        multiscale.Hierarchy.line(spark, 10, 2)
    with pytest.raises(ValueError):
        multiscale.multigrid_solve(h, y, 0.5, "none")


def test_multigrid_comes_near_the_solution(spark):
    h = multiscale.Hierarchy.line(spark, 64, 1)
    y = spark.range(64).select("id", F.when(F.col("id") < 32, 1.0).otherwise(-1.0).alias("y"))
    exact = as_array(smoothing.smooth(h.graph(0), 0.5, y.withColumn("k", F.lit(0))))
    x = as_array(multiscale.multigrid_solve(h, y, 0.5, alpha=0.6, steps=3))
    assert np.linalg.norm(x - exact) < 0.1 * np.linalg.norm(exact)
    rf = as_array(multiscale.multigrid_solve(h, y, 0.5, "rf", steps=1))
    assert np.isfinite(rf).all()


def test_label_propagation_on_planted_groups(spark):
    n = 60
    pairs = gen._pairs(spark, n).withColumn("u", uniform("g", 1, F.col("a"), F.col("b")))
    g = Graph.from_edges(pairs.where((F.col("u") < 0.01) | ((F.col("a") % 3 == F.col("b") % 3) & (F.col("u") < 0.6))), spark.range(n))
    g = Graph(g.vertices, ground(g.edges))
    y = spark.range(n).select("id", (F.col("id") % 3).cast("int").alias("k"), F.lit(1.0).alias("y"))
    for method in ("exact", "xbar"):
        got = labels.accuracy(labels.propagate_labels(g, labels.train_mask(y, 0.5, 2), 0.5, method, 30), y).first()
        assert got.n == n and got.accuracy > 0.9


def test_sources(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tred\nb \tblue\nc\tred\n")
    rows = tables.read_tsv(spark, str(tmp_path / "x.tsv"), ["id", "class"])
    assert [r.id for r in rows.collect()] == ["a", "b", "c"]
    codes = tables.dictionary_encode(rows.withColumn("n", F.ascii("id")), "class", "n")
    assert {(r.value, r.code) for r in codes.collect()} == {("red", 0), ("blue", 1)}
    px = spark.createDataFrame([(0, 1, 5.0), (1, 0, 7.0)], "row int, col int, value double")
    assert {(r.id, r.y) for r in tables.image_signal(px, 2).collect()} == {(2, 5.0), (1, 7.0)}
    g = Graph.from_coo(spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (1, 1, 9.0), (2, 2, 0.0)], "i long, j long, v double"))
    assert g.nv() == 3 and g.ne() == 1 and "Graph" in repr(g) and not g.is_directed
    assert connectivity.is_connected(gen.erdos_renyi(spark, 20, 120, 1))


FAMILIES = {
    "sparse": lambda s: gen.erdos_renyi(s, 40, 75, 2),
    "dense": lambda s: gen.erdos_renyi(s, 40, 600, 2),
    "preferential": lambda s: gen.preferential(s, 40, 4, 2),
    "periodic": lambda s: gen.lattice(s, 10, 4, periodic=True),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_coupled_moments_of_four_families(spark, name):
    """Moments on a log-spaced grid against eigenvalues, within the variance that is reported."""
    g = FAMILIES[name](spark)
    g = Graph(ground(g.vertices), ground(g.edges))
    d = [r.d for r in g.degree().collect()]
    grid = np.geomspace(np.mean(d) / 100, 2 * max(d), 4).tolist()
    truth = {(round(r.q, 9), r.k): r.y for r in moments.true_moments(moments.eigenvalues(g), grid, 3).collect()}
    for r in moments.collect_moments(g, grid, 3, 150, "standard", 4).collect():
        assert abs(r.y - truth[round(r.q, 9), r.k]) < 5 * math.sqrt(r["var"]) + 0.01, (r.q, r.k)


def test_grids_by_joins_equal_the_local_ones(spark):
    g = gen.random_weighted(spark, 8, 0.6, 3)
    g = Graph(ground(g.vertices), ground(g.edges))
    for own in (False, True):
        a = forest.random_forest(g, None, 1, 7, grid=[0.7, 3.0], moment_seeds=own)
        b = forest.random_forest_distributed(g, None, 1, 7, grid=[0.7, 3.0], moment_seeds=own, local=3)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_long_walks_of_few_vertices_take_few_rounds_by_joins(spark, monkeypatch):
    """With q far below the degrees nearly all cycles are popped in parts of at most ``local`` vertices, and not one a round."""
    g = gen.random_weighted(spark, 12, 0.6, 3)
    g, rounds, followed = Graph(ground(g.vertices), ground(g.edges)), [], forest._followed
    monkeypatch.setattr(forest, "_followed", lambda far, n: rounds.append(n) or followed(far, n))
    a = forest.random_forest(g, 0.05, 1, 7)
    b = forest.random_forest_distributed(g, 0.05, 1, 7, local=8)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    pops = a.agg(F.sum("level")).first()[0]
    assert 5 * len(rounds) < pops, (len(rounds), pops)


def test_levels_from_above_are_those_of_popping():
    """Vertices that take back what does not lead to them end at the levels where no cycle is left, also where stacks run out."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        n, depth = 2 + seed % 9, 40
        to, ends = (np.arange(n)[:, None] + rng.integers(1, n, (n, depth))) % n, rng.random((n, depth)) < 0.02
        start = np.arange(n) * depth
        at = start.copy()
        forest.pop_arrays(to.ravel(), ends.ravel().__getitem__, start, start + depth, at)
        kept = np.where(ends.any(1), ends.argmax(1), depth)
        due = np.bincount(np.concatenate([to[i, :k] for i, k in enumerate(kept)]), minlength=n)
        forest.drain(to.ravel(), start, kept, due)
        assert (kept == at - start).all() and (due == kept).all(), seed


def test_turns_grow_with_the_logarithm_of_the_pops(spark, monkeypatch):
    """Walks of a thousand steps on 12 vertices: parts of at most ``local`` vertices take far fewer turns than there are pops."""
    g = gen.random_weighted(spark, 12, 0.6, 3)
    g, turns, turn = Graph(ground(g.vertices), ground(g.edges)), [], forest._turn
    monkeypatch.setattr(forest, "_turn", lambda *a: turns.append(a) or turn(*a))
    a = forest.random_forest(g, 0.002, 1, 7)
    b = forest.random_forest_distributed(g, 0.002, 1, 7, local=8)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    pops = a.agg(F.sum("level")).first()[0]
    assert 0 < 10 * len(turns) < pops, (len(turns), pops)


def test_erdos_renyi_and_preferential_sizes(spark):
    for m in (0, 5, 44, 45):
        assert gen.erdos_renyi(spark, 10, m, 3).ne() == m
    g = gen.preferential(spark, 50, 2, 5)
    assert connectivity.is_connected(g) and 48 < g.ne() <= 96


def test_subspace_by_conjugate_gradients(spark):
    g = gen.random_weighted(spark, 10, 0.7, 2)
    g = Graph(ground(g.vertices), ground(g.edges))
    y = g.vertices.select("id", F.lit(0).alias("k"), uniform("y", 2, F.col("id")).alias("y"))
    basis = g.vertices.select("id", (F.col("id") % 4).alias("b"), (F.col("id") + 1.0).alias("v"))
    one, two = ({r.b: r.c for r in multiscale.smooth_subspace(g, basis, 0.7, y, dense).collect()} for dense in (100, 0))
    assert one.keys() == two.keys() and all(abs(one[b] - two[b]) < 1e-8 for b in one)


def test_conjugate_gradients_say_when_they_do_not_settle(spark):
    g = gen.lattice(spark, 30)
    y = g.vertices.select("id", F.lit(0).alias("k"), F.col("id").cast("double").alias("y"))
    with pytest.raises(RuntimeError):
        smoothing.conjugate_gradients(g, g.vertices.select("id", F.lit(0.01).alias("q")), y, max_rounds=3)


def test_loops_delete_the_tables_of_earlier_rounds(spark):
    from sylvan.plans.ground import Rounds, shared_dir

    keep, now = Rounds("rounds"), spark.range(5)
    for _ in range(4):
        now = keep(now.withColumn("id", F.col("id") * 2))
    assert sorted(r.id for r in now.collect()) == [0, 16, 32, 48, 64]
    assert sum(x.startswith("rounds-") for x in os.listdir(shared_dir(spark))) == 1


def test_components_of_a_star_and_a_path(spark):
    far = [(0, k, 1.0) for k in range(3001, 6001)] + [(k, k + 1, 1.0) for k in range(1, 200)]
    g = Graph.from_edges(spark.createDataFrame(far, "a long, b long, weight double"), spark.range(6001))
    sizes = connectivity.connected_components(g).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in sizes if r["count"] > 1) == [(0, 3001), (1, 200)]
    assert len(sizes) == 2 + 2800


def test_drawn_pairs_are_not_brought_together(spark, monkeypatch):
    """The first different pairs, found by counting ranges of ranges; no limit over all rows is left in the plan."""
    monkeypatch.setattr(gen, "RANGES", 3)
    rows = spark.range(200).select((F.col("id") * 37 % 1009).alias("k"), (F.col("id") * F.col("id")).alias("first"))
    for want in (1, 2, 50, 199, 200):
        assert sorted(r["first"] for r in gen._earliest(rows, want).collect()) == [i * i for i in range(want)]
    plan = gen.erdos_renyi(spark, 30, 100, 3).edges._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan


def test_partitions_of_parts_and_suppliers_grow_with_the_lines(spark, small, monkeypatch):
    """Sums over pairs and over edges have partitions by the rows, however few the session asks for."""
    monkeypatch.setattr(skew, "PART_ROWS", 500)
    g = tables.part_supplier(spark, small)
    n = tables.table(spark, small, "lineitem").count()
    assert n > 500 * 4 and g.edges.rdd.getNumPartitions() == -(-2 * n // 500)
    plan = g.edges._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and f", {-(-n // 500)})" in plan


def test_lines_of_parts_and_suppliers_are_shuffled_once(spark, small, monkeypatch):
    """Both directions of an edge come from one sum of its lines, not from a second one."""
    monkeypatch.setattr(skew, "PART_ROWS", 500)
    g = tables.part_supplier(spark, small)
    plan = g.edges.where("src < 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == plan.count("RepartitionByExpression") == 2 and "Union" in plan
    weights = {(r.src, r.dst): r.weight for r in g.edges.collect()}
    assert sum(weights.values()) == 2 * tables.table(spark, small, "lineitem").count()
    assert all(weights[b, a] == w for (a, b), w in weights.items())


def test_sums_begin_after_lines_are_dealt(spark, small, monkeypatch):
    """However many partitions the session has, no sum runs in the tasks that read a split, whose size grows with the table."""
    monkeypatch.setattr(skew, "PART_ROWS", 2000)
    g = tables.part_supplier(spark, small)
    assert 3 < int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = g.edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2


def test_neighbours_of_embeddings_equal_brute_force(spark, tmp_path):
    """In blocks and a few pairs at a time, with copies, which tie, and a vector of zeros, which is near none."""
    x = np.random.default_rng(2).integers(-2, 3, (300, 5)).astype(float)
    x[7], x[40:140] = 0, x[3]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    with np.errstate(all="ignore"):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos, want = np.round(unit @ unit.T, 6), set()
    for i in range(300):
        near = sorted((-cos[i, j], j) for j in range(300) if i != j and np.isfinite(cos[i, j]))[:5]
        want |= {edge for _, j in near for edge in ((i, j), (j, i))}
    got = {(r.src, r.dst) for r in tables.embedding_knn(spark, str(tmp_path), block=100, cells=1000).edges.collect()}
    assert got == want

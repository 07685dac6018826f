"""Events of coupled forests, searches, Euler tours and moves, subset counts, and the solver by polynomials."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.functions.rng import uniform
from sylvan.operators import draws, events, forest, search
from sylvan.plans import moments, smoothing, tiles
from sylvan.plans.ground import Store, ground
from sylvan.sources import generators as gen
from sylvan.sources import sink
from sylvan.sources.graph import Graph

from .wilson import arrays, forests


def stored(g):
    return Graph(ground(g.vertices), ground(g.edges))


@pytest.mark.parametrize("first", [64, 1])
def test_events_equal_cold_starts_between_them(spark, monkeypatch, first):
    """The forest is constant between two events and changes at each as the event says; also where stacks run out."""
    monkeypatch.setattr(events, "_depth", lambda rows: first)
    g = stored(gen.random_weighted(spark, 10, 0.5, 6))
    high, low, reps = 6.0, 0.3, 2
    local = arrays(g)
    got = {rep: [] for rep in range(reps)}
    for r in events.coupled_events(g, high, low, reps, 5).orderBy("rep", "event").collect():
        got[r.rep].append(r)
    assert all(len(v) >= 4 for v in got.values())
    for rep, rows in got.items():
        assert [r.event for r in rows] == list(range(1, len(rows) + 1))
        cuts = [high, *(r.q for r in rows), low]
        assert cuts == sorted(cuts, reverse=True)
        middle = [math.sqrt(a * b) for a, b in zip(cuts, cuts[1:])]
        by_q = {q: {i: root for r, k, i, _, root, _ in forests(local, [q], reps, 5) if r == rep} for q in middle}
        edge = lambda q: {i: root for r, k, i, _, root, _ in forests(local, [q], reps, 5) if r == rep}
        assert edge(high) == by_q[middle[0]] and edge(low) == by_q[middle[-1]]
        for r, a, b in zip(rows, middle, middle[1:]):
            before, after = by_q[a], by_q[b]
            assert edge(math.sqrt(a * r.q)) == before and edge(math.sqrt(b * r.q)) == after
            assert before[r.root] == r.root
            assert r.n_rerooted == sum(before[i] != after[i] for i in before) and r.n_roots == sum(i == x for i, x in after.items())


def test_events_refuse_and_isolated_vertices_stay(spark):
    g = stored(Graph.from_edges(spark.createDataFrame([(0, 1)], "a long, b long"), spark.range(4)))
    rows = events.coupled_events(g, 50.0, 1e-6, 1, 2).collect()
    assert rows and {r.root for r in rows} <= {0, 1} and {r.n_roots for r in rows} <= {3, 4} and rows[-1].n_roots == 3
    with pytest.raises(ValueError):
        events.coupled_events(g, 1.0, 0.0)


def test_bfs_against_plain_search(spark):
    g = stored(gen.preferential(spark, 60, 2, 4))
    near = {}
    for r in g.edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
    starts, depth, level = [0, 7], {0: 0, 7: 0}, [0, 7]
    while level:
        level = sorted({b for a in level for b in near[a]} - set(depth))
        depth |= {b: max(depth.values()) + 1 for b in level}
    sources = spark.createDataFrame([(i,) for i in [*starts, 7]], "id long")
    got = {r.id: r for r in search.bfs_graph(g, sources).collect()}
    assert {i: r.depth for i, r in got.items()} == depth
    assert all(r.parent == min((b for b in near[i] if depth[b] == r.depth - 1), default=None) for i, r in got.items())
    assert max(r.depth for r in search.bfs_graph(g, sources, 1).collect()) == 1
    assert search.bfs_graph(g, sources.where("id < 0")).count() == 0
    one_way = spark.createDataFrame([(0, a, b) for a, b in ((1, 2), (2, 3), (3, 1), (3, 4), (1, 4))], "rep int, src long, dst long")
    assert {(r.id, r.depth, r.parent) for r in search.bfs(one_way, spark.createDataFrame([(0, 1)], "rep int, id long")).collect()} == {(1, 0, None), (2, 1, 1), (4, 1, 1), (3, 2, 2)}


def tours(spark, parents):
    rows = []
    for i, p in parents.items():
        r = i
        while parents[r] is not None:
            r = parents[r]
        rows.append((0, i, p, r))
    return ground(search.euler_tour(spark.createDataFrame(rows, "rep int, id long, next long, root long")))


PATH_AND_STAR = {0: None, **{k: k - 1 for k in range(1, 70)}, 100: None, **{k: 100 for k in range(101, 140)}, 200: None, 201: 110}


def test_depths_of_a_deep_forest_take_few_rounds(spark, monkeypatch):
    """A path of 40 below a root, a lone root, and a cycle with a tail that no root reaches; one table a doubling, not one a level."""
    rows = [(0, 0, None), *((0, i, i - 1) for i in range(1, 41)), (0, 50, None), (1, 0, 1), (1, 1, 0), (1, 2, 1)]
    f = ground(spark.createDataFrame(rows, "rep int, id long, next long"))
    tables, call = [], search.Rounds.__call__
    monkeypatch.setattr(search.Rounds, "__call__", lambda self, df: tables.append(1) or call(self, df))
    got = sorted(tuple(r) for r in search.bfs_parents(f).select("rep", "id", "depth", "parent").collect())
    assert got == sorted([(0, i, i, i - 1) for i in range(1, 41)] + [(0, 0, 0, None), (0, 50, 0, None)], key=lambda r: r[:2])
    assert len(tables) <= 9


def test_euler_tour_against_a_walk(spark):
    got = {r.id: r for r in tours(spark, PATH_AND_STAR).collect()}
    kids, at, want = {}, 0, {}
    for i, p in PATH_AND_STAR.items():
        kids.setdefault(p, []).append(i)

    def walk(i, depth):
        nonlocal at
        want[i] = [at, None, depth]
        at += 1
        for c in sorted(kids.get(i, [])):
            walk(c, depth + 1)
        want[i][1] = at
        at += 1

    for r in kids[None]:
        at = 0
        walk(r, 0)
    assert {i: [r.enter, r.leave, r.depth] for i, r in got.items()} == want
    assert all(r.size == (r.leave - r.enter + 1) // 2 for r in got.values()) and got[0].size == 70 and got[110].size == 2


@pytest.mark.parametrize("moves", [{10: 100}, {69: 5, 110: 69}, {0: 201}, {10: 110, 110: 20, 200: 201}, {10: 201, 110: 69}, {0: 30}])
def test_moved_subtrees_equal_roots_found_anew(spark, moves):
    """Into another tree, within a tree, into moving subtrees, and in a circle, which has no root."""
    tour = tours(spark, PATH_AND_STAR)
    got = {r.id: (r.next, r.root) for r in search.move_subtrees(tour, spark.createDataFrame([(0, *m) for m in moves.items()], "rep int, id long, next long")).collect()}
    parents = PATH_AND_STAR | moves
    for i in parents:
        seen, r = set(), i
        while r is not None and r not in seen:
            seen.add(r)
            r = parents[r]
        root = None if r is not None else next(x for x in seen if parents[x] is None)
        assert got[i] == (parents[i], root)


def test_subset_counts_equal_listed_subsets(spark):
    """12 maps: 4095 subsets, and rows that do not double with each map."""
    rng, n, nm = np.random.default_rng(3), 25, 12
    maps = [rng.choice(6, n) + rng.choice([0, 9], n) for _ in range(nm)]
    rows = [(0, m, 0, i, int(maps[m][i])) for m in range(nm) for i in range(n)]
    table = ground(spark.createDataFrame(rows, "run int, m int, q_index int, id long, root long"))
    got = {r.k: r["count"] for r in moments.n_self_roots(table, nm).collect()}
    for k in range(1, nm + 1):
        hits = 0
        for chosen in combinations(range(nm), k):
            at = np.arange(n)
            for m in chosen:
                at = maps[m][at]
            hits += int((at == np.arange(n)).sum())
        assert got[k] == pytest.approx(hits / math.comb(nm, k))


def system(spark, g, q):
    ids = sorted(r.id for r in g.vertices.collect())
    w = np.zeros((len(ids), len(ids)))
    for r in g.edges.collect():
        w[ids.index(r.src), ids.index(r.dst)] = r.weight
    return ids, np.diag(w.sum(axis=1)) - w + np.diag(q)


def test_chebyshev_solves_as_dense_does(spark, monkeypatch):
    monkeypatch.setattr(smoothing, "CHUNK", 3)
    g = stored(gen.preferential(spark, 40, 3, 2))
    y = ground(g.vertices.select("id", F.lit(0).alias("k"), uniform("y", 2, F.col("id")).alias("y")).union(g.vertices.where("id < 5").select("id", F.lit(3), F.lit(-1e6))))
    q = {i: 0.5 + i % 3 for i in range(40)}
    rate = g.vertices.select("id", (0.5 + F.col("id") % 3).alias("q"))
    ids, a = system(spark, g, [q[i] for i in range(40)])
    got = smoothing.chebyshev(g, rate, y).collect()
    for k in (0, 3):
        rhs = np.zeros(40)
        for r in y.where(F.col("k") == k).collect():
            rhs[r.id] = q[r.id] * r.y
        want = np.linalg.solve(a, rhs)
        x = np.array([v for _, v in sorted((r.id, r.x) for r in got if r.k == k)])
        assert np.abs(x - want).max() <= 1e-9 * np.abs(want).max()


def test_chebyshev_gives_way_where_it_would_be_slow(spark, monkeypatch):
    """A vertex with all the rate, and isolated ones."""
    called = []
    monkeypatch.setattr(smoothing, "conjugate_gradients", lambda *a: called.append(1) or "cg")
    monkeypatch.setattr(smoothing, "MOST_STEPS", 60)
    path = stored(gen.lattice(spark, 50))
    y = path.vertices.select("id", F.lit(0).alias("k"), F.lit(1.0).alias("y"))
    assert smoothing.chebyshev(path, path.vertices.select("id", F.lit(1e-4).alias("q")), y) == "cg" and called
    lone = Graph(spark.range(3), spark.createDataFrame([], "src long, dst long, weight double"))
    out = smoothing.chebyshev(lone, lone.vertices.select("id", F.lit(2.0).alias("q")), y.where("id = 1"))
    assert {(r.id, r.x) for r in out.collect()} == {(0, 0.0), (1, 1.0), (2, 0.0)}
    assert smoothing.chebyshev(Graph(spark.range(0), lone.edges), lone.vertices.where("false").select("id", F.lit(1.0).alias("q")), y).count() == 0


def test_a_store_grows(spark):
    s = Store("test")
    assert not s
    first = s.add(spark.range(2))
    assert s and s.add(spark.range(5, 6)).count() == 3 and first.count() == 2
    assert forest.pop_arrays is not None


def test_traces_are_within_their_bound(spark):
    g = stored(gen.preferential(spark, 50, 3, 2))
    truth = {(r.q, r.k): r.y for r in moments.true_moments(moments.eigenvalues(g), [0.8, 4.0], 3).collect()}
    got = moments.trace_moments(g, [0.8, 4.0], 3, 30).collect()
    assert {(r.q, r.k) for r in got} == set(truth)
    assert all(abs(r.y - truth[r.q, r.k]) <= r.bound < 0.25 for r in got)


def test_first_moments_without_eigenvalues(spark):
    g = stored(gen.lattice(spark, 5, 5))
    one, two = ({(round(r.q, 9), r.mc): r for r in moments.first_moment_check(g, 2, seed=3, points=2, dense=d).collect()} for d in (2000, 5))
    assert one.keys() == two.keys()
    for k in one:
        assert (one[k].mean, one[k]["var"]) == (two[k].mean, two[k]["var"])
        assert abs(one[k].true_mean - two[k].true_mean) < 6 and one[k].true_mean > 0


def test_running_stats_in_blocks_equal_one_window(spark, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK", 7)
    rows = spark.range(100).select((F.col("id") % 2).cast("int").alias("q_index"), F.floor(F.col("id") / 2).cast("int").alias("mc"), (1e6 + F.sin(F.col("id"))).alias("value"))
    values = {q: [r.value for r in rows.where(F.col("q_index") == q).orderBy("mc").collect()] for q in (0, 1)}
    for r in moments.mc_running_stats(rows).collect():
        x = np.array(values[r.q_index][: r.mc + 1])
        assert r.mean == pytest.approx(x.mean(), rel=1e-12)
        assert r["var"] is None if len(x) == 1 else r["var"] == pytest.approx(x.var(ddof=1), rel=1e-6)


@pytest.mark.parametrize("most", [10, 10_000])
def test_alias_levels_encode_the_weights(spark, most):
    e = spark.range(1, 501).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"), (0.1 + F.col("id") % 11).alias("weight"))
    g = stored(Graph.from_edges(e))
    chunks, slots = (ground(t) for t in draws.alias_levels(g, most))
    assert slots.groupBy("src", "chunk").count().agg(F.max("count")).first()[0] <= (500 if most > 500 else 30)
    assert chunks.where("src = 0").count() == (1 if most > 500 else 50)
    outer = {(r.src, r.dst): r.p for r in draws.alias_shares(chunks.withColumnRenamed("chunk", "dst")).collect()}
    inner = draws.alias_shares(slots.select(F.struct("src", "chunk").alias("src"), "slot", "dst", "prob", "alias")).collect()
    total = sum(0.1 + k % 11 for k in range(1, 501))
    for r in inner:
        p = r.p * outer[r.src.src, r.src.chunk]
        assert p == pytest.approx((0.1 + r.dst % 11) / total if r.src.src == 0 else 1.0, abs=1e-12)
    rows = spark.range(6000).select(F.lit(0).cast("long").alias("id"), F.col("id").alias("draw"))
    got = draws.alias_draw_levels(chunks, slots, rows, 4)
    assert got.count() == 6000 and got.where("next is null").count() == 0
    assert abs(got.where("next % 11 = 10").count() / 6000 - 45 * 10.1 / total) < 0.03


def test_stored_forests_are_pruned_and_joined_without_a_shuffle(spark):
    g = stored(gen.lattice(spark, 6, 6))
    f = ground(forest.random_forest(g, None, 3, 2, grid=[0.5, 2.0]))
    y = g.vertices.select("id", F.lit(0).alias("k"), (F.col("id") * 1.5).alias("y"))
    sink.write_forest(f, "kept_forest", 4)
    sink.write_signal(y, "kept_signal", 4)
    try:
        one = sink.read_forest(spark, "kept_forest", rep=1, q_index=0)
        want = f.where("rep = 1 and q_index = 0").select("id", "next", "root")
        assert sorted(map(str, one.select("id", "next", "root").collect())) == sorted(map(str, want.collect()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = one.join(spark.table("kept_signal"), "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert "PartitionFilters: [isnotnull(rep" in plan or "PartitionFilters: [isnotnull(q_index" in plan
        assert len(one.inputFiles()) <= 4 < len(spark.table("kept_forest").inputFiles())
        assert joined.count() == 36
        assert sink.read_forest(spark, "kept_forest").count() == 6 * 36
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table kept_forest")
        spark.sql("drop table kept_signal")
    assert [r.text for r in sink.describe(one.sparkSession.createDataFrame([(0, 1, None), (0, 2, 1)], "rep int, id long, next long")).collect()] == ["forest of 1 trees on 2 vertices, 1 arrows"]


def test_one_way_edges(spark):
    """An adjacency matrix of one triangle is told from a graph; unequal weights count as one-way too."""
    cells = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 3, 2.0)], "i long, j long, v double")
    assert {tuple(r) for r in Graph.from_coo(cells).one_way().collect()} == {(2, 3), (3, 4), (4, 3)}
    assert Graph.from_edges(cells.toDF("a", "b", "weight")).one_way().isEmpty()


def test_tiles_of_a_hub_stay_small_and_take_many_signals(spark, monkeypatch):
    """A vertex with all edges fills no row of a tile beyond its chunk, and 5 signals in rows of 2 equal dense solutions bit by bit in reruns."""
    monkeypatch.setattr(tiles, "TOGETHER", 2)
    star = Graph.from_edges(spark.range(1, 900).select(F.lit(0).alias("a"), F.col("id").alias("b"), (F.col("id") % 3 + 1).alias("weight")), spark.range(901))
    g = stored(star)
    base = ground(g.degree().select("id", F.lit(9e3).alias("q"), (F.col("d") + 9e3).alias("diag")))
    t = tiles.Tiles(g.edges, base, 5, 20)
    lengths = [r.n for r in spark.table(t.table).where("part >= 0").select((F.length("weight") / 8).alias("n")).collect()]
    assert sum(lengths) == 2 * 899 and max(lengths) <= 60
    t.drop()
    y = ground(g.vertices.crossJoin(spark.range(5).select((F.col("id") * 7).cast("int").alias("k"))).select("id", "k", uniform("y", 2, F.col("id"), F.col("k")).alias("y")))
    rate = g.vertices.select("id", F.lit(9e3).alias("q"))
    one, again = ({(r.id, r.k): r.x for r in smoothing.chebyshev(g, rate, y).collect()} for _ in range(2))
    dense = {(r.id, r.k): r.x for r in smoothing.smooth(g, 9e3, y).collect()}
    assert one == again and one.keys() == dense.keys()
    assert max(abs(one[k] - dense[k]) for k in dense) < 1e-9


def test_queries_by_lines_run_in_partitions_by_rows(spark, monkeypatch):
    """Partitions are set while the query runs, and the session's own numbers are back afterwards, after an error too."""
    from sylvan import queries
    from sylvan.functions import skew

    monkeypatch.setattr(skew, "PART_ROWS", 1000)
    name = "spark.sql.shuffle.partitions"
    own, seen = spark.conf.get(name), []
    count = queries._count(spark, "/root/testdata/sf0.001", "lineitem")
    probe = queries.by_lines(lambda s, sf: seen.append(s.conf.get(name)) or s.range(3))
    assert probe(spark, "/root/testdata/sf0.001").count() == 3 and seen == [str(-(-4 * count // 1000))]
    with pytest.raises(KeyError), skew.sized(spark, 10**6):
        raise KeyError
    assert spark.conf.get(name) == own


def test_the_forest_of_parts_and_suppliers_runs_in_partitions_by_lines(spark, monkeypatch):
    from sylvan import queries
    from sylvan.functions import skew

    monkeypatch.setattr(skew, "PART_ROWS", 2000)
    seen, rows = [], spark.createDataFrame([(0, 1, None, 1)], "rep int, id long, next long, root long")
    monkeypatch.setattr(queries.forest, "random_forest", lambda *a: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or rows)
    small = "/root/testdata/sf0.001"
    assert queries.QUERIES["random_forest_part_supplier"](spark, small).count() == 1
    assert seen == [str(-(-4 * queries._count(spark, small, "lineitem") // 2000))]


def test_short_ways_of_many_vertices_take_few_doublings(spark, monkeypatch):
    """A star of 5000 with a cycle that has a tail of 5: doubling ends with the ways and not with the number of vertices."""
    arrows = [(0, 0, None), *((0, i, 0) for i in range(1, 5000)), (0, 6000, 6001), (0, 6001, 6000), *((0, 6000 + i, 5999 + i) for i in range(2, 7))]
    far = spark.createDataFrame(arrows, "rep int, id long, next long").selectExpr("rep", "id", "coalesce(next, id) as to", "next is null as done")
    tables, call = [], forest.Rounds.__call__
    monkeypatch.setattr(forest.Rounds, "__call__", lambda self, df: tables.append(1) or call(self, df))
    got = {r.id: (r.to, r.done) for r in forest._followed(far, 5007).collect()}
    assert all(got[i] == (0, True) for i in range(5000)) and {got[6000 + i][0] for i in range(7)} == {6000, 6001}
    assert not any(got[6000 + i][1] for i in range(7)) and len(tables) <= 5


def test_large_graphs_draw_by_their_edges(spark, monkeypatch):
    """The same forests by joins without an index of all edges: only those of vertices that the first round leaves are indexed."""
    g = gen.random_weighted(spark, 40, 0.3, 5)
    g = Graph(ground(g.vertices.union(spark.range(100, 102).select("id"))), ground(g.edges))
    want = forest.random_forest(g, None, 2, 3, grid=[2.0, 6.0]).collect()
    monkeypatch.setattr(forest, "LOCAL", 4)
    indexed, index = [], Graph.draw_index
    monkeypatch.setattr(Graph, "draw_index", lambda self: indexed.append(self.nv()) or index(self))
    got = forest.random_forest(g, None, 2, 3, grid=[2.0, 6.0], local=4).select(*want[0].__fields__).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and indexed and max(indexed) < 42


@pytest.mark.parametrize("scale", [1.0, 0.3, 300.0])
def test_small_whole_weights_take_a_byte_of_a_tile(spark, scale):
    """A step reads all tiles, so an edge takes 5 bytes and a place 4; other weights are kept as they are, and products are right."""
    edges = [(i, j, (1 + (i + j) % 3) * scale) for i in range(20) for j in range(20) if i != j]
    g = Graph(spark.range(20), ground(spark.createDataFrame(edges, "src long, dst long, weight double")))
    base = ground(spark.range(20).selectExpr("id", "1.0D as q", "2.0D as diag"))
    made = tiles.Tiles(g.edges, base)
    size = spark.table(made.table).where("part >= 0").selectExpr(f"sum(length(row) + length(col) + length({made.weight}) - 4 * n_to)").first()[0]
    assert size == len(edges) * (5 if scale == 1 else 12)
    got = {r.id: r.x for r in made.values(made.step(made.state(), 1.0), [0], "int").collect()}
    assert all(abs(got[i] - sum(w for a, b, w in edges if a == i) / 2) < 1e-9 for i in range(20))
    made.drop()

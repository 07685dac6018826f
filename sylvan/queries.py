"""Named queries over the provided tables, one or more for each operator."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.skew import sized
from sylvan.operators import connectivity, draws, events, forest, search
from sylvan.operators import partition as parts
from sylvan.plans import labels, moments, multiscale, smoothing
from sylvan.plans.ground import ground, shared_dir
from sylvan.sources import generators, sink, tables
from sylvan.sources.graph import Graph

Q, REPS, SEED = 1000.0, 4, 1
GRID, NM, RUNS = [500.0, 1000.0, 4000.0], 3, 4
DIGITS = 6

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def trade(spark, sf) -> Graph:
    g = tables.nation_trade(spark, sf)
    return Graph(g.vertices, ground(g.edges))


def stored(g: Graph) -> Graph:
    """A graph all of whose vertices have edges, from one stored table."""
    edges = ground(g.edges)
    return Graph(edges.select(F.col("src").alias("id")).distinct(), edges)


def by_rows_of(name: str):
    """A query of a graph made from a table, in partitions by its number of rows: each gives two edges at most, of which a
    draw index or an alias table makes two rows. The result is written inside, so that its last steps run so too."""

    def wrap(f):
        @wraps(f)
        def run(spark, sf):
            with sized(spark, 4 * _count(spark, sf, name)):
                return ground(f(spark, sf))

        return run

    return wrap


#: For the graph of parts and suppliers.
by_lines = by_rows_of("lineitem")


def rated(g: Graph) -> DataFrame:
    return g.vertices.select("id", (F.col("id") * 50.0 + 500).alias("q"))


def forests(spark, sf) -> tuple[Graph, DataFrame]:
    g = trade(spark, sf)
    return g, ground(forest.random_forest(g, Q, REPS, SEED))


def regions(spark, sf) -> DataFrame:
    return tables.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("part"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def signal(spark, sf) -> DataFrame:
    return tables.nation_signal(spark, sf)


@query
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return tables.nation_trade(spark, sf).degree()


@query
def degree_user_flow(spark, sf):
    return tables.user_flow(spark, sf).degree()


@query
def degree_part_supplier(spark, sf):
    return tables.part_supplier(spark, sf).degree()


@query
@by_lines
def is_directed(spark, sf):
    """Edges of parts and suppliers, and how many of them have no equal one back."""
    g = tables.part_supplier(spark, sf)
    g = Graph(g.vertices, ground(g.edges))
    back = g.one_way().agg(F.count("*").alias("n_one_way"))
    return g.edges.agg(F.count("*").alias("n_edges")).join(F.broadcast(back)).select("n_edges", "n_one_way", (F.col("n_one_way") > 0).alias("is_directed"))


@query
def neighbors(spark, sf):
    n = tables.part_supplier(spark, sf).neighbors()
    return n.select("id", "n_neighbors", F.array_join("neighbors", ",").alias("neighbors"))


@query
def laplacian(spark, sf):
    return tables.nation_trade(spark, sf).laplacian()


@query
def graph_size(spark, sf):
    g = stored(tables.part_supplier(spark, sf))
    nv = g.vertices.agg(F.count("*").alias("nv"))
    return nv.crossJoin(g.edges.agg(F.sum((F.col("src") < F.col("dst")).cast("long")).alias("ne")))


@query
def laplacian_times(spark, sf):
    g = tables.nation_trade(spark, sf)
    return rounded(g.laplacian_times(signal(spark, sf).select("id", F.col("y").alias("x"))), "lx")


def _draws(g: Graph, n: int) -> DataFrame:
    return g.vertices.crossJoin(F.broadcast(g.edges.sparkSession.range(n).select(F.col("id").cast("int").alias("draw"))))


@query
def random_successor_uniform(spark, sf):
    g = trade(spark, sf)
    return draws.random_successor_uniform(g, _draws(g, 20), SEED)


@query
def random_successor_weighted(spark, sf):
    g = trade(spark, sf)
    return draws.random_successor_weighted(g, _draws(g, 20), SEED)


@query
def alias_table(spark, sf):
    return draws.alias_shares(draws.alias_preprocess(trade(spark, sf))).select("src", "dst", F.round("p", 9).alias("p"))


@query
def alias_slots(spark, sf):
    return rounded(draws.alias_preprocess(trade(spark, sf)), "prob")


@query
def alias_draw(spark, sf):
    g = trade(spark, sf)
    return draws.alias_draw(ground(draws.alias_preprocess(g)), _draws(g, 20), SEED)


@query
@by_lines
def alias_levels(spark, sf):
    """What tables of two levels encode, with up to 100 neighbours a chunk: the suppliers are hubs."""
    chunks, slots = draws.alias_levels(stored(tables.part_supplier(spark, sf)), 100)
    outer = draws.alias_shares(chunks.withColumnRenamed("chunk", "dst")).select("src", F.col("dst").alias("chunk"), F.col("p").alias("p0"))
    key = F.struct("src", "chunk").alias("src")
    inner = draws.alias_shares(slots.select(key, "slot", "dst", "prob", "alias")).select("src.src", "src.chunk", "dst", "p")
    return inner.join(outer, ["src", "chunk"]).select("src", "dst", F.round(F.col("p") * F.col("p0"), 7).alias("p"))


@query
def random_forest(spark, sf):
    return forest.random_forest(stored(tables.user_flow(spark, sf)), 20.0, 2, SEED).select("rep", "id", "next", "root")


@query
@by_lines
def random_forest_part_supplier(spark, sf):
    return forest.random_forest(stored(tables.part_supplier(spark, sf)), 20.0, 2, SEED).select("rep", "id", "next", "root")


@query
def random_forest_distributed(spark, sf):
    return forest.random_forest_distributed(trade(spark, sf), Q, REPS, SEED, local=20).select("rep", "id", "next", "root")


@query
def coupled_grid_distributed(spark, sf):
    return forest.random_forest_distributed(trade(spark, sf), None, 2, SEED, grid=GRID, local=20).select("rep", "q_index", "id", "next", "root")


@query
def death_thresholds(spark, sf):
    return rounded(forest.death_thresholds(*forests(spark, sf), SEED), "q_star")


@query
def coupled_events(spark, sf):
    """All changes of the coupled forests of the trade graph from the highest q of the grid to the lowest."""
    return rounded(events.coupled_events(trade(spark, sf), max(GRID), min(GRID), REPS, SEED), "q")


@query
@by_rows_of("events")
def forest_bfs(spark, sf):
    """Depth and parent of every vertex of two forests of the user flow."""
    return search.bfs_parents(ground(forest.random_forest(stored(tables.user_flow(spark, sf)), 20.0, 2, SEED)))


@query
@by_lines
def graph_bfs(spark, sf):
    g = stored(tables.part_supplier(spark, sf))
    return search.bfs_graph(g, g.vertices.where("id = 0"))


def _tours(spark, sf) -> DataFrame:
    return ground(search.euler_tour(ground(forest.random_forest(stored(tables.part_supplier(spark, sf)), 20.0, 2, SEED))))


@query
@by_lines
def forest_tour(spark, sf):
    return _tours(spark, sf)


@query
@by_lines
def subtree_moves(spark, sf):
    """The largest subtree of each tree moves under the smallest root."""
    tour = _tours(spark, sf)
    top = tour.where("next is not null").groupBy("rep", "root").agg(F.max_by("id", F.struct("size", -F.col("id"))).alias("id"))
    least = tour.groupBy("rep").agg(F.min("root").alias("next"))
    return search.move_subtrees(tour, top.join(least, "rep").select("rep", "id", "next"))


@query
def forest_out_neighbors(spark, sf):
    g, f = forests(spark, sf)
    return forest.out_neighbors(f, g.vertices.where("id < 10")).select("rep", "id", F.array_join("neighbors", ",").alias("neighbors"))


@query
def random_forest_vector_q(spark, sf):
    g = trade(spark, sf)
    return forest.random_forest(g, rated(g), REPS, SEED).select("rep", "id", "next", "root")


@query
def forest_nroots(spark, sf):
    return forest.nroots(forests(spark, sf)[1])


@query
def forest_edges(spark, sf):
    return forest.digraph(forests(spark, sf)[1])


@query
def forest_quality(spark, sf):
    return forest.quality(*forests(spark, sf))


@query
def root_resolution(spark, sf):
    return forest.resolve_roots(forests(spark, sf)[1])


@query
def connected_components(spark, sf):
    g = tables.part_supplier(spark, sf)
    few = g.edges.where("weight >= 3")
    return connectivity.connected_components(Graph(g.vertices, few))


@query
def spanning_tree(spark, sf):
    return forest.spanning_tree(trade(spark, sf), 3, REPS, SEED)


@query
def spanning_tree_random_root(spark, sf):
    return forest.spanning_tree(trade(spark, sf), None, 1, SEED)


@query
def stored_forests(spark, sf):
    """Forests and the signal as bucketed tables; of the second repetition each vertex' balance and arrow."""
    forest_table, signal_table = f"forest_{uuid.uuid4().hex}", f"signal_{uuid.uuid4().hex}"
    sink.write_forest(forests(spark, sf)[1], forest_table)
    sink.write_signal(signal(spark, sf), signal_table)
    f = sink.read_forest(spark, forest_table, rep=1)
    return rounded(f.join(spark.table(signal_table), "id").select("id", "next", "root", "y"), "y")


@query
def forest_text(spark, sf):
    return sink.describe(forests(spark, sf)[1])


@query
def partition(spark, sf):
    return parts.partition(forests(spark, sf)[1])


@query
def partition_sizes(spark, sf):
    return parts.sizes(parts.partition(forests(spark, sf)[1]))


@query
def partition_count(spark, sf):
    return parts.count(parts.partition(forests(spark, sf)[1]))


@query
def partition_average(spark, sf):
    return rounded(parts.average(parts.partition(forests(spark, sf)[1]), signal(spark, sf)), "z")


@query
def partition_average_constant(spark, sf):
    return parts.average(parts.partition(forests(spark, sf)[1]), 2.5)


@query
def partition_sum(spark, sf):
    return rounded(parts.total_by_part(parts.partition(forests(spark, sf)[1]), signal(spark, sf)), "z")


@query
def partition_propagate(spark, sf):
    p = parts.partition(forests(spark, sf)[1])
    return rounded(parts.propagate(p, parts.total_by_part(p, signal(spark, sf))), "y")


@query
def partition_apply(spark, sf):
    return rounded(parts.apply(parts.partition(forests(spark, sf)[1]), signal(spark, sf)), "y")


@query
def partition_diag(spark, sf):
    return rounded(parts.diagonal(parts.partition(forests(spark, sf)[1])), "v")


@query
def forest_apply(spark, sf):
    return rounded(forest.apply_roots(forests(spark, sf)[1], signal(spark, sf)), "y")


@query
def smooth_exact(spark, sf):
    return rounded(smoothing.smooth(trade(spark, sf), Q, signal(spark, sf)), "x")


@query
def smooth_exact_vector_q(spark, sf):
    g = trade(spark, sf)
    return rounded(smoothing.smooth(g, rated(g), signal(spark, sf)), "x")


@query
def smooth_cg(spark, sf):
    g = trade(spark, sf)
    return rounded(smoothing.conjugate_gradients(g, forest.rates(g, Q), signal(spark, sf)), "x")


@query
def smooth_chebyshev(spark, sf):
    """Prices of parts and balances of suppliers on the graph of who supplies what."""
    prices = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("k"), F.col("p_retailprice").alias("y"))
    balances = tables.table(spark, sf, "supplier").select((F.col("s_suppkey") + tables.SUPPLIER_BASE).alias("id"), F.lit(0), "s_acctbal")
    return rounded(smoothing.smooth(stored(tables.part_supplier(spark, sf)), 20.0, prices.union(balances), dense=0), "x")


@query
def smooth_rf_v1(spark, sf):
    return rounded(smoothing.smooth_rf(trade(spark, sf), Q, signal(spark, sf), REPS, 1, seed=SEED), "x")


@query
def smooth_rf_v2(spark, sf):
    return rounded(smoothing.smooth_rf(trade(spark, sf), Q, signal(spark, sf), REPS, 2, seed=SEED), "x")


@query
def smooth_rf_vector_q(spark, sf):
    g = trade(spark, sf)
    return rounded(smoothing.smooth_rf(g, rated(g), signal(spark, sf), REPS, 2, seed=SEED), "x")


@query
def smooth_rf_mean_corrected(spark, sf):
    return rounded(smoothing.smooth_rf(trade(spark, sf), Q, signal(spark, sf), REPS, 1, True, SEED), "x")


@query
def sure(spark, sf):
    g, f = forests(spark, sf)
    y = signal(spark, sf)
    return rounded(smoothing.sure(y, smoothing.smooth_rf(g, Q, y, REPS, 2, forests=f), smoothing.mean_roots(f), 4.0), "sure")


@query
def objective(spark, sf):
    y = signal(spark, sf)
    return smoothing.objective(trade(spark, sf), Q, y, y.select("id", "k", (F.col("y") / 2).alias("x"))).select("k", F.round(F.col("cost") / 1e6, DIGITS).alias("cost"))


@query
def grad_step(spark, sf):
    y = signal(spark, sf)
    return rounded(smoothing.gradient_step(trade(spark, sf), Q, y, y.select("id", F.col("y").alias("x"))), "x", "res")


@query
def rf_smoother(spark, sf):
    return rounded(smoothing.rf_smoother(trade(spark, sf), Q, signal(spark, sf), seed=SEED), "x", "res")


@query
def reduced_graph(spark, sf):
    return parts.reduced_graph(tables.nation_trade(spark, sf), regions(spark, sf)).edges


@query
def smooth_ms(spark, sf):
    return rounded(multiscale.smooth_ms(trade(spark, sf), regions(spark, sf), Q, signal(spark, sf)), "x")


@query
def smooth_ms_min(spark, sf):
    return rounded(multiscale.smooth_ms_min(trade(spark, sf), regions(spark, sf), Q, signal(spark, sf)), "x")


@query
def smooth_subspace(spark, sf):
    g = trade(spark, sf)
    basis = g.vertices.select("id", F.lit(0).cast("long").alias("b"), F.lit(1.0).alias("v")).union(g.vertices.select("id", F.lit(1).cast("long"), F.col("id").cast("double")))
    return rounded(multiscale.smooth_subspace(g, basis, Q, signal(spark, sf)), "c")


@query
def hierarchy(spark, sf):
    return multiscale.Hierarchy.sample(trade(spark, sf), Q, 2, SEED).total_weights()


def _years(spark, sf) -> tuple[int, int]:
    """The first and the last year of orders."""
    year = F.year("o_orderdate")
    return tuple(tables.table(spark, sf, "orders").agg(F.min(year), F.max(year)).first())


def monthly(spark, sf) -> DataFrame:
    """(id, x): orders by month, numbered from January of the first year."""
    first, _ = _years(spark, sf)
    o = tables.table(spark, sf, "orders").groupBy(((F.year("o_orderdate") - first) * 12 + F.month("o_orderdate") - 1).cast("long").alias("id"))
    return ground(o.agg(F.count("*").cast("double").alias("x")))


def _line(spark, sf) -> tuple[multiscale.Hierarchy, DataFrame]:
    """A path of the months that orders span, cut to a multiple of four, with the signal of their numbers."""
    x = monthly(spark, sf)
    n = x.count() // 4 * 4
    return multiscale.Hierarchy.line(spark, n, 2), x.where(F.col("id") < n)


def _count(spark, sf, name: str) -> int:
    return tables.table(spark, sf, name).count()


@query
def coarsen(spark, sf):
    h, x = _line(spark, sf)
    return multiscale.HSignal(x, h).coarsen().coarsen().x


@query
def interpolate(spark, sf):
    h, x = _line(spark, sf)
    return multiscale.HSignal(x, h).coarsen().coarsen().interpolate().interpolate().x


@query
def multigrid(spark, sf):
    """Orders by month smoothed on their path."""
    h, x = _line(spark, sf)
    two = multiscale.Hierarchy(h.graphs[:2], h.partitions[:1])
    return rounded(multiscale.multigrid_solve(two, x.select("id", F.col("x").alias("y")), 0.5, alpha=0.6, steps=2), "x")


@query
def grid_partition(spark, sf):
    return multiscale.grid_partition(spark, _count(spark, sf, "customer"))


@query
def mgrid_1d(spark, sf):
    (h, _), out = _line(spark, sf), None
    for level in range(h.depth() + 1):
        e = h.graph(level).edges.select(F.lit(level).alias("level"), "src", "dst", "weight")
        out = e if out is None else out.union(e)
    return out


def _calendar(spark, sf, periodic: bool = False) -> Graph:
    """Months by years of orders."""
    first, last = _years(spark, sf)
    return generators.lattice(spark, 12, last - first + 1, periodic=periodic)


@query
def lattice_edges(spark, sf):
    return _calendar(spark, sf, True).edges


@query
def image_signal(spark, sf):
    """Orders by month (rows) and year (columns) as an image."""
    o = tables.table(spark, sf, "orders").groupBy((F.month("o_orderdate") - 1).alias("row"), (F.year("o_orderdate") - 1992).alias("col")).agg(F.count("*").alias("value"))
    return tables.image_signal(o, 12)


@query
def from_adjacency(spark, sf):
    """The trade graph from its adjacency matrix with zeros and a diagonal: edges and all vertices."""
    g = trade(spark, sf)
    matrix = g.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v")).union(g.vertices.select("id", "id", F.lit(7.0))).union(g.vertices.select("id", (F.col("id") + 1) % 25, F.lit(0.0)))
    a = Graph.from_coo(matrix)
    return a.edges.union(a.vertices.select("id", F.lit(-1).cast("long"), F.lit(0.0)))


@query
def small_graphs(spark, sf):
    """A cycle of regions, a wheel of nations, and the two listed graphs."""
    made = {"cycle": generators.cycle(spark, _count(spark, sf, "region")), "wheel": generators.wheel(spark, _count(spark, sf, "nation")), "bull": generators.listed(spark, generators.BULL), "tutte": generators.listed(spark, generators.TUTTE)}
    out = None
    for name, g in made.items():
        e = g.edges.select(F.lit(name).alias("name"), "src", "dst", "weight")
        out = e if out is None else out.union(e)
    return out


def _random_pairs(spark, sf) -> Graph:
    """As many vertices as customers and as many edges as orders."""
    return generators.erdos_renyi(spark, _count(spark, sf, "customer"), _count(spark, sf, "orders"), SEED)


@query
def erdos_renyi(spark, sf):
    return _random_pairs(spark, sf).edges


@query
def barabasi_albert(spark, sf):
    return generators.preferential(spark, _count(spark, sf, "customer"), 3, SEED).edges


@query
def random_weighted_graph(spark, sf):
    return rounded(generators.random_weighted(spark, _count(spark, sf, "nation"), 0.5, SEED).edges, "weight")


@query
def erdos_renyi_size(spark, sf):
    g = _random_pairs(spark, sf)
    return g.vertices.agg(F.count("*").alias("nv")).crossJoin(g.edges.agg((F.count("*") / 2).cast("long").alias("ne")))


@query
def self_roots(spark, sf):
    return moments.self_roots(forests(spark, sf)[1])


@query
def n_self_roots(spark, sf):
    maps = ground(moments.root_maps(trade(spark, sf), GRID, NM, RUNS, "standard", SEED))
    return rounded(moments.n_self_roots(maps, NM), "count")


@query
def n_self_roots_flow(spark, sf):
    """All subsets of six root maps of the user flow."""
    maps = ground(moments.root_maps(stored(tables.user_flow(spark, sf)), [20.0], 6, 1, "standard", SEED))
    return rounded(moments.n_self_roots(maps, 6), "count")


@query
def coupled_moments(spark, sf):
    return rounded(moments.coupled_forests_moments(trade(spark, sf), GRID, NM, "leaves_pq", SEED), "count")


@query
def indep_moments(spark, sf):
    return rounded(moments.fake_coupled_forests(trade(spark, sf), GRID, NM, SEED), "count")


@query
def collect_moments(spark, sf):
    return moments.collect_moments(trade(spark, sf), GRID, NM, RUNS, "standard", SEED).select("q", "k", F.round("y", 9).alias("y"), F.round("var", 12).alias("var"))


@query
def collect_moments_empirical(spark, sf):
    return moments.collect_moments(trade(spark, sf), GRID, NM, RUNS, "standard", SEED, empirical=True).select("q", "k", F.round("y", 9).alias("y"), F.round("var", 12).alias("var"))


@query
def true_moments(spark, sf):
    return moments.true_moments(moments.eigenvalues(trade(spark, sf)), GRID, 2).select("q", "k", F.round("y", 8).alias("y"))


@query
def trace_moments(spark, sf):
    """Of a graph with more vertices than eigenvalues are taken of."""
    return rounded(moments.trace_moments(stored(tables.part_supplier(spark, sf)), [20.0], 2, 2, SEED), "y", "bound")


@query
def mc_running_stats(spark, sf):
    counts = moments.root_maps(trade(spark, sf), GRID, 1, 10, "standard", SEED).groupBy("q_index", F.col("run").alias("mc")).agg(F.sum((F.col("id") == F.col("root")).cast("double")).alias("value"))
    return rounded(moments.mc_running_stats(counts), "mean", "var")


@query
def first_moment_check(spark, sf):
    """Running numbers of roots on the trade graph against its eigenvalues."""
    return rounded(moments.first_moment_check(trade(spark, sf), 10, seed=SEED), "q", "mean", "var", "true_mean", "true_var")


@query
def embedding_knn(spark, sf):
    return tables.embedding_knn(spark, sf).edges


def _ssl(spark, sf):
    g = tables.embedding_knn(spark, sf)
    y = tables.embedding_labels(spark, sf)
    return Graph(g.vertices, ground(g.edges)), y


@query
def ssl_label_propagation(spark, sf):
    g, y = _ssl(spark, sf)
    return labels.propagate_labels(g, labels.train_mask(y, 0.3, SEED), 1.0)


@query
def ssl_accuracy(spark, sf):
    g, y = _ssl(spark, sf)
    return rounded(labels.accuracy(labels.propagate_labels(g, labels.train_mask(y, 0.3, SEED), 1.0), y), "accuracy")


@query
def denoise(spark, sf):
    """Orders by month and year as an image, smoothed exactly and by forests."""
    image = image_signal(spark, sf).withColumn("id", F.col("id") - 12 * (_years(spark, sf)[0] - 1992))
    return rounded(labels.denoise(_calendar(spark, sf), ground(image), 0.4, REPS, SEED), "y", "exact", "v1", "v2")


@query
def tsv_dictionary(spark, sf):
    """A table as tab-separated text, read back and coded in the order of first appearance."""
    path = f"{shared_dir(spark)}/tsv-{uuid.uuid4().hex}"
    tables.table(spark, sf, "customer").select(F.col("c_custkey").cast("string"), F.concat(F.lit(" "), "c_mktsegment")).write.csv(path, sep="\t")
    rows = tables.read_tsv(spark, path, ["key", "segment"]).select(F.col("key").cast("long").alias("key"), "segment")
    return tables.dictionary_encode(rows, "segment", "key")


@query
def checked_edges(spark, sf):
    """Trade pairs both of whose nations lie in regions 0 or 1."""
    g = tables.nation_trade(spark, sf)
    known = regions(spark, sf).where("part < 2").select("id")
    return tables.checked_edges(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), known)


@query
def one_hot(spark, sf):
    return tables.one_hot(regions(spark, sf).select("id", F.col("part").cast("int").alias("k")))

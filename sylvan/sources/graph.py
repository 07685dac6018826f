"""The graph model: vertices (id) and edges (src, dst, weight) in both directions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.functions.skew import spread
from sylvan.plans.ground import ground

#: Neighbours above which a vertex' weights are summed in chunks, and the most chunks of one.
HUB, CHUNKS = 100_000, 1024


def cell_of(t: Column, d: Column, n: Column) -> Column:
    """The cell of a position t in a degree d cut into n; grows with t, whatever the rounding."""
    return F.least(F.floor(t / d * n), n - 1)


def totals(index: DataFrame) -> DataFrame:
    """(id, d, n) of the vertices that have neighbours, from a draw index."""
    return index.where("cell = 0 and lo = 0").select("id", "d", "n").dropDuplicates(["id"])


@dataclass
class Graph:
    """Undirected weighted graph. Vertices are a table of their own, so isolated ones stay."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, rows: int = 0) -> Graph:
        """From (a, b[, weight]) in any direction: parallel edges add up, self-loops go. Where there are many, say about
        how many ``rows``, so that sums run in partitions of a bounded size."""
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        e = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), weight.alias("weight"))
        # both directions are written out after the sum, which so reads each edge once
        e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
        e = spread(e, rows, "a", "b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))
        both = e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(e.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
        if vertices is None:
            vertices = both.select(F.col("src").alias("id")).distinct()
        return cls(vertices.select(F.col("id").cast("long").alias("id")), both)

    @classmethod
    def from_coo(cls, adjacency: DataFrame) -> Graph:
        """From an adjacency matrix (i, j, v) that holds both triangles; zeros are no edges."""
        ids = adjacency.select(F.col("i").alias("id")).union(adjacency.select("j")).distinct()
        e = adjacency.where("v <> 0 and i <> j").select(F.col("i").cast("long").alias("src"), F.col("j").cast("long").alias("dst"), F.col("v").cast("double").alias("weight"))
        return cls(ids.select(F.col("id").cast("long").alias("id")), e)

    is_directed = False

    def one_way(self) -> DataFrame:
        """(src, dst): edges without an equal one back. None in an undirected graph, whatever it was made from."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return self.edges.join(back, ["src", "dst", "weight"], "left_anti").select("src", "dst")

    def degree(self) -> DataFrame:
        """(id, d): weighted degree, 0 for isolated vertices."""
        d = self.edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("d"))
        return self.vertices.join(d, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))

    def neighbors(self) -> DataFrame:
        """(id, n_neighbors, neighbors): sorted neighbour ids."""
        n = self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))
        return self.vertices.join(n, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors")).withColumn("n_neighbors", F.size("neighbors").cast("long"))

    def laplacian(self) -> DataFrame:
        """(i, j, v): degrees on the diagonal, minus the weights elsewhere."""
        off = self.edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("v"))
        return self.degree().select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("d").alias("v")).union(off)

    def nv(self) -> int:
        return self.vertices.count()

    def ne(self) -> int:
        return self.edges.where("src < dst").count()

    def cumulative(self) -> DataFrame:
        """(src, dst, lo, hi, d, n): each edge's interval of its vertex' degree d, by dst, and the number of
        neighbours. An interval begins where the one before ends, whatever the rounding of sums, and the
        last one has no end. Vertices of more than HUB neighbours are summed in chunks by many tasks."""
        n = self.edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("least"), F.max("dst").alias("most"))
        wide = n.where(F.col("n") > HUB).select("src", "n", "least", (F.floor((F.col("most") - F.col("least")) / CHUNKS) + 1).alias("width"))
        hubs = not wide.isEmpty()
        wide = ground(wide) if hubs else wide
        e = self.edges.join(wide.select("src"), "src", "left_anti") if hubs else self.edges
        # frames of one window, so that rows are sorted and held once; they add up in one order, so an end is the next one's begin
        order, first, end = Window.partitionBy("src").orderBy("dst"), Window.unboundedPreceding, Window.unboundedFollowing
        upto, before, whole = (order.rowsBetween(first, x) for x in (0, -1, end))
        hi = F.when(F.lead("dst").over(order).isNull(), float("inf")).otherwise(F.sum("weight").over(upto))
        e = e.select("src", "dst", F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("lo"), hi.alias("hi"), F.sum("weight").over(whole).alias("d"), F.count("*").over(whole).alias("n"))
        return e.union(self._cumulative_of_hubs(wide)) if hubs else e

    def _cumulative_of_hubs(self, wide: DataFrame) -> DataFrame:
        """The same for the vertices of ``wide`` (src, n, least, width): up to CHUNKS chunks of neighbours by equal widths of
        ids are summed each by itself and begin at the sums of those before."""
        part = Window.partitionBy("src", "chunk").orderBy("dst")
        e = self.edges.join(wide, "src").select("src", "dst", "weight", "n", F.floor((F.col("dst") - F.col("least")) / F.col("width")).alias("chunk"))
        e = ground(e.withColumns({"upto": F.sum("weight").over(part), "last": F.lead("dst").over(part).isNull()}))
        by_chunk = Window.partitionBy("src").orderBy("chunk")
        base = F.coalesce(F.sum("upto").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ends = e.where("last").select("src", "chunk", "upto", base.alias("base"), F.lead("chunk").over(by_chunk).isNull().alias("final"))
        ends = ends.select("src", "chunk", "base", "final", F.max(F.col("base") + F.col("upto")).over(Window.partitionBy("src")).alias("d"))
        e = e.join(ends, ["src", "chunk"]).withColumn("sum", F.col("base") + F.col("upto"))
        hi = F.when(F.col("last") & F.col("final"), float("inf")).otherwise(F.col("sum"))
        return e.select("src", "dst", F.coalesce(F.lag("sum").over(part), "base").alias("lo"), hi.alias("hi"), "d", "n")

    def draw_index(self) -> DataFrame:
        """(id, cell, dst, lo, hi, d, n): the intervals by cells of the degree d, of which a vertex has as many
        as its n neighbours. A position t of a vertex lies in cell floor(t / d * n), which meets two
        intervals on average, so a draw is an equi-join with a row or two and a hub is as many keys as it
        has neighbours. Intervals that reach over several cells come once for each: 2 n rows at most."""
        e = self.cumulative()
        last = F.when(F.col("hi") == float("inf"), F.col("n") - 1).otherwise(cell_of(F.col("hi"), F.col("d"), F.col("n")))
        return e.select(F.col("src").alias("id"), F.explode(F.sequence(cell_of(F.col("lo"), F.col("d"), F.col("n")), last)).alias("cell"), "dst", "lo", "hi", "d", "n")

    def laplacian_times(self, x: DataFrame, value: str = "x") -> DataFrame:
        """(id, lx): L x for a signal (id, value); absent entries are 0."""
        wx = self.edges.join(x.select(F.col("id").alias("dst"), F.col(value).alias("__x")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("__x")).alias("wx"))
        own = self.degree().join(x.select("id", F.col(value).alias("__x")), "id", "left").join(wx, "id", "left")
        return own.select("id", (F.col("d") * F.coalesce("__x", F.lit(0.0)) - F.coalesce("wx", F.lit(0.0))).alias("lx"))

    def __repr__(self) -> str:
        return f"Graph({self.vertices}, {self.edges})"

"""Graphs and signals derived from tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.sources.graph import Graph

#: Added to supplier keys, which would otherwise collide with part keys.
SUPPLIER_BASE = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, joined by the number of line items between a customer's and a supplier's nation."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ends = lines.join(t("customer").select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = ends.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    return Graph.from_edges(counts, t("nation").select(F.col("n_nationkey").cast("long").alias("id")))


def nation_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, y): mean account balance of a nation's customers, in cents over a whole number."""
    c = table(spark, sf_dir, "customer")
    mean = c.groupBy(F.col("c_nationkey").cast("long").alias("id")).agg((F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / F.count("*") / 100).alias("y"))
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return v.join(mean, "id", "left").select("id", F.lit(0).alias("k"), F.coalesce("y", F.lit(0.0)).alias("y"))


def user_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Users of consecutive events. The one window over all events is cut by day: the last event of
    each day is joined to the first of the next day that has one."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    in_day = Window.partitionBy("day").orderBy("ts", "event_id")
    inside = e.select(F.lag("user_id").over(in_day).alias("a"), F.col("user_id").alias("b")).where("a is not null")
    days = e.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    across = days.select(F.lag("last").over(Window.orderBy("day")).alias("a"), F.col("first").alias("b")).where("a is not null")
    return Graph.from_edges(inside.union(across).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("weight")))


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers, joined by their number of line items."""
    lines = table(spark, sf_dir, "lineitem")
    n = lines.count()
    return Graph.from_edges(lines.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("b")), rows=n)


def embedding_knn(spark: SparkSession, sf_dir: str, k: int = 5, block: int = 16_384, cells: int = 2_000_000) -> Graph:
    """Each vector with its k nearest by cosine (rounded to 6 digits, ties by id), symmetrised. Vectors are
    dealt to blocks by hash; a task compares one block with another, about ``cells`` pairs at a time, and gives the
    k nearest of each row there, and the nearest of these are the nearest of all. The search is
    exact, so the work is the square of the rows, but a task never holds more than two blocks, and rows travel as often as there are blocks."""
    import numpy as np
    import pandas as pd

    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    n, some = vecs.count(), int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))
    blocks = max(1, -(-n // block), min(some, -(-n // 1024)))
    each = vecs.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def units(pdf: pd.DataFrame) -> tuple:
        x = np.array(pdf["embedding"].tolist(), float)
        with np.errstate(all="ignore"):
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        known = np.isfinite(x).all(axis=1)
        return pdf["id"].to_numpy(np.int64)[known], x[known]

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "cos": np.zeros(0)})]
        if not len(left) or not len(right):
            return found[0]
        (a, x), (b, y) = units(left), units(right.sort_values("id"))
        short, among = x.astype(np.float32), y.astype(np.float32).T
        together, meet = max(1, cells // max(len(b), 1)), np.isin(a, b).any()
        groups = max(k, min(64, len(b)))
        # single precision finds all that can be among the k nearest, with room for its errors and for rounding; these few are compared in double
        room = 2e-6 + 4 * (x.shape[1] + 2) * 2.0**-24
        for at in range(0, len(a), together):
            part = slice(at, at + together)
            cos = short[part] @ among
            if meet:
                cos[a[part, None] == b] = -np.inf
            least = np.full((len(cos), 1), -np.inf, np.float32)
            if len(b) > groups:
                # k groups have a value of at least the k-th largest of their maxima
                most = cos[:, : len(b) // groups * groups].reshape(len(cos), groups, -1).max(axis=2)
                least = np.partition(most, -k, axis=1)[:, -k, None] - np.float32(room)
            row, col = np.nonzero((cos >= least) & (cos > -np.inf))
            exact = (x[part] @ y.T)[row, col] if len(row) > 64 * len(cos) else np.einsum("ij,ij->i", x[part][row], y[col])
            exact = np.round(exact, 6)
            order = np.lexsort((col, -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append(pd.DataFrame({"a": a[part][row[first]], "b": b[col[first]], "cos": exact[first]}))
        return pd.concat(found)

    parts = min(blocks * blocks, 10_000)
    queries = each.select("id", "embedding", F.col("own").alias("x"), F.col("other").cast("long").alias("y")).repartition(parts, "x", "y")
    among = each.select("id", "embedding", F.col("other").cast("long").alias("x"), F.col("own").alias("y")).repartition(parts, "x", "y")
    near = queries.groupBy("x", "y").cogroup(among.groupBy("x", "y")).applyInPandas(nearest, "a long, b long, cos double")
    best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("c"), "b"))), 1, k).alias("best"))
    near = best.select("a", F.explode("best.b").alias("b"))
    return Graph.from_edges(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), vecs.select("id"))


def embedding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, k, y): one-hot labels, long and sparse."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("k"), F.lit(1.0).alias("y"))


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated values without a header; all columns strings, stripped."""
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"`{c}` string" for c in columns))
    return raw.select(*(F.trim(c).alias(c) for c in columns))


def dictionary_encode(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): codes 0.. in the order in which values first appear by ``order``. Codes come from
    ranks inside hash ranges of the first positions plus the ranges' starts, not from one window."""
    firsts = rows.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    top = firsts.agg(F.max("first"), F.min("first")).first()
    if top[0] is None:
        return firsts.select("value", F.lit(0).cast("long").alias("code"))
    width = max(1, (top[0] - top[1] + 1) // 1024)
    firsts = firsts.withColumn("part", F.floor((F.col("first") - top[1]) / width))
    starts = firsts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("first", "value")) - 1
    return firsts.withColumn("r", inside).join(starts, "part").select("value", (F.col("base") + F.col("r")).alias("code"))


def checked_edges(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs (a, b) both of whose ends are known vertices (id)."""
    return pairs.join(vertices.select(F.col("id").alias("a")), "a", "left_semi").join(vertices.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")


def one_hot(classes: DataFrame) -> DataFrame:
    """(id, k, y) from (id, k)."""
    return classes.select("id", "k", F.lit(1.0).alias("y"))


def image_signal(pixels: DataFrame, height: int) -> DataFrame:
    """(id, k, y) from (row, col, value), column-major as ``lattice(height, width)``."""
    return pixels.select((F.col("col") * height + F.col("row")).cast("long").alias("id"), F.lit(0).alias("k"), F.col("value").cast("double").alias("y"))

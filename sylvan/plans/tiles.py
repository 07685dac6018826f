"""Products of a graph's weights with signals, by tiles, for iterations that take many of them.

Vertices are dealt to blocks by hash and numbered inside them. The edges from one block to another are a tile:
rows of three arrays, of about a given number of edges each, in a table bucketed by tile. A product sends each block's values
to the tiles that read them, a message a tile and not one an edge, and adds up what the tiles give. With blocks as
many as the root of the edges over EDGES, a task holds a tile or a few, and messages grow slower than edges times rounds of them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.functions.skew import spread
from sylvan.plans.ground import ground, shared_dir

#: Edges of a tile, values of a block in one row, and signals that are solved together at most.
EDGES, VALUES, TOGETHER = 2_000_000, 1_000_000, 16

_STATE = "i int, g int, diag binary, x binary, old binary, c binary, most double"


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _floats(b) -> np.ndarray:
    return np.frombuffer(b, np.float64)


class Tiles:
    """The weights of ``edges`` (src, dst, weight), a stored table with both directions, among the vertices of ``base`` (id, q, diag)."""

    def __init__(self, edges: DataFrame, base: DataFrame, signals: int = 1, chunk: int = 500_000):
        spark = base.sparkSession
        n, m, cores = base.count(), edges.count(), spark.sparkContext.defaultParallelism
        self.spark, self.together = spark, TOGETHER
        self.blocks = max(2, int(np.ceil(np.sqrt(max(m / EDGES, cores)))), -(-n * min(max(signals, 1), TOGETHER) // VALUES))
        self.base = base.withColumn("i", _block("id", self.blocks))
        self.lists = ground(self.base.groupBy("i").applyInPandas(_listed, "i int, ids binary, q binary, diag binary"))
        self.table = f"tiles_{uuid.uuid4().hex}"
        self._cut(edges, m, chunk)

    def _cut(self, edges: DataFrame, m: int, chunk: int) -> None:
        """Edges from block j to block i in rows of about ``chunk``, however many a vertex or a tile has, and a row without edges on the
        diagonal, which carries a block's own columns."""
        p = self.blocks
        e = edges.withColumns({"i": _block("dst", p), "j": _block("src", p)})
        parts = ground(e.groupBy("i", "j").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")))
        by = ["i", "j", "part"]
        e = e.join(F.broadcast(parts), ["i", "j"]).withColumn("part", F.pmod(F.xxhash64("dst", "src"), F.col("parts")).cast("int")).select(*by, "src", "dst", "weight")
        each = parts.select("i", "j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        to, of = (self.lists.select(F.col("i").alias(at), F.col("ids").alias(name)).hint("shuffle_hash") for at, name in (("i", "to"), ("j", "of")))
        ids = each.join(to, "i").join(of, "j").select(*by, "to", "of")
        rows = spread(e, m, *by).groupBy(*by).cogroup(ids.groupBy(*by)).applyInPandas(_tile, "i int, j int, part int, n_to int, n_of int, row binary, col binary, weight binary, light binary")
        none, size = F.lit(b""), (F.length("ids") / 8).cast("int")
        rows = rows.union(self.lists.select("i", F.col("i").alias("j"), F.lit(-1), size, size, none, none, none, none)).withColumn("t", F.col("i") * p + F.col("j"))
        to = f"{shared_dir(self.spark)}/{self.table}"
        rows.repartition(p * p, "t").write.bucketBy(p * p, "t").sortBy("t", "part").option("path", to).saveAsTable(self.table)
        # a step reads one of the two columns
        self.weight, self.other = ("light", "weight") if self.spark.table(self.table).where("light is null").isEmpty() else ("weight", "light")

    def state(self, c: DataFrame | None = None, ks: list | None = None) -> DataFrame:
        """Rows of blocks with x and old 0 and c = q y / diag for signals y (id, k, y), ``together`` values of k in
        a row; without them x = 1 and c = 0."""
        if c is None:
            one = self.lists.withColumn("g", F.lit(0))
            return one.groupBy("i", "g").applyInPandas(_ones, _STATE)
        place = self.spark.createDataFrame([(k, s) for s, k in enumerate(ks)], f"k {c.schema['k'].dataType.simpleString()}, s int")
        y = c.join(F.broadcast(place), "k").select(_block("id", self.blocks).alias("i"), F.floor(F.col("s") / self.together).cast("int").alias("g"), "id", "s", F.coalesce("y", F.lit(0.0)).alias("y"))
        groups = self.spark.range(-(-len(ks) // self.together)).select(F.col("id").cast("int").alias("g"))
        lists = self.lists.crossJoin(F.broadcast(groups))
        return lists.groupBy("i", "g").cogroup(y.groupBy("i", "g")).applyInPandas(_started(len(ks), self.together), _STATE)

    def step(self, state: DataFrame, omega: float) -> DataFrame:
        """x becomes omega (D^-1 W x + c - old) + old, and old what x was. A block's own columns go with its values to the tile on
        the diagonal and on to where the products are added, so that a step reads the state once."""
        own = F.col("j") == F.col("i")
        sent = state.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        sent = sent.select((F.col("i") * self.blocks + F.col("j")).alias("t"), "g", "x", *(F.when(own, F.col(n)).alias(n) for n in ("diag", "old", "c")))
        met = sent.hint("shuffle_hash").join(self.spark.table(self.table).drop("j", self.other).withColumnRenamed(self.weight, "weight"), "t")
        alone = (F.when(F.col("part") < 0, F.col(n)).alias(n) for n in ("diag", "old", "c"))
        met = met.select("t", "i", "g", "part", "n_to", "n_of", "row", "col", "weight", "x", *alone)
        given = met.mapInPandas(_product, "i int, g int, o int, m binary, x binary, diag binary, old binary, c binary")
        return given.groupBy("i", "g").applyInPandas(_updated(omega), _STATE)

    def values(self, state: DataFrame, ks: list, kind: str) -> DataFrame:
        """(id, k, x)."""
        met = state.select("i", "g", "x").join(self.lists.select("i", "ids").hint("shuffle_hash"), "i")
        return met.mapInPandas(_rows(ks, self.together), f"id long, k {kind}, x double")

    def drop(self) -> None:
        self.spark.sql(f"drop table {self.table}")


def _listed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    if not pdf["diag"].all():
        raise ZeroDivisionError("a vertex has neither edges nor a rate")
    q, diag = (pdf[c].to_numpy(np.float64).tobytes() for c in ("q", "diag"))
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "q": [q], "diag": [diag]})


def _tile(edges: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """Edges by their places in the lists of two blocks, sorted, so that sums run in the same order each time. ``row`` has the
    number of edges of each place, and small whole weights are there as bytes too (``light``), as each step reads all of a tile."""
    edges = edges.sort_values(["dst", "src"])
    out = lists[["i", "j", "part"]].copy()
    for side, ids, size, place in (("dst", "to", "n_to", "row"), ("src", "of", "n_of", "col")):
        ids, own = np.frombuffer(lists[ids].iloc[0], np.int64), edges[side].to_numpy()
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        if (ids[at] != own).any():
            raise ValueError("an edge leads to no vertex")
        at = np.bincount(at, minlength=len(ids)) if place == "row" else at
        out[size], out[place] = len(ids), [at.astype(np.int32).tobytes()]
    weight = edges["weight"].to_numpy(np.float64)
    small = ((weight >= 0) & (weight < 256) & (weight == np.floor(weight))).all()
    light = weight.astype(np.uint8).tobytes() if small else None
    return out.assign(weight=[weight.tobytes()], light=[light])[["i", "j", "part", "n_to", "n_of", "row", "col", "weight", "light"]]


def _ones(pdf: pd.DataFrame) -> pd.DataFrame:
    diag = _floats(pdf["diag"].iloc[0])
    none = np.zeros(len(diag)).tobytes()
    return pd.DataFrame({"i": pdf["i"], "g": pdf["g"], "diag": [diag.tobytes()], "x": [np.ones(len(diag)).tobytes()], "old": [none], "c": [none], "most": 1.0})


def _started(signals: int, together: int):
    def run(key, lists: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        i, g = key
        if not len(lists):
            return pd.DataFrame({n.split()[0]: [] for n in _STATE.split(", ")})
        ids, q, diag = np.frombuffer(lists["ids"].iloc[0], np.int64), _floats(lists["q"].iloc[0]), _floats(lists["diag"].iloc[0])
        full = np.zeros((min(together, signals - g * together), len(ids)))
        at = np.minimum(np.searchsorted(ids, y["id"].to_numpy(np.int64)), len(ids) - 1)
        known = ids[at] == y["id"].to_numpy(np.int64)
        np.add.at(full, (y["s"].to_numpy(int)[known] - g * together, at[known]), y["y"].to_numpy(float)[known])
        none = np.zeros(full.shape).tobytes()
        return pd.DataFrame({"i": [i], "g": [g], "diag": [diag.tobytes()], "x": [none], "old": [none], "c": [(q * full / diag).tobytes()], "most": 0.0})

    return run


def _product(batches):
    """What each tile of a task gives, added up by block, and the own columns of blocks on the diagonal."""
    sums, order = {}, {}
    for pdf in batches:
        alone = pdf["part"] < 0
        if alone.any():
            yield pdf[alone].assign(o=-1, m=None)[["i", "g", "o", "m", "x", "diag", "old", "c"]]
        for r in pdf[~alone].itertuples():
            x, col = _floats(r.x).reshape(-1, r.n_of), np.frombuffer(r.col, np.int32)
            w = np.frombuffer(r.weight, np.uint8 if len(r.weight) == len(col) else np.float64)
            row = np.repeat(np.arange(r.n_to), np.frombuffer(r.row, np.int32))
            total = sums.setdefault((r.i, r.g), np.zeros((len(x), r.n_to)))
            order.setdefault((r.i, r.g), r.t)
            for k in range(len(x)):
                total[k] += np.bincount(row, w * x[k][col], minlength=r.n_to)
    for (i, g), total in sums.items():
        yield pd.DataFrame({"i": [i], "g": [g], "o": [order[i, g]], "m": [total.tobytes()], "x": None, "diag": None, "old": None, "c": None})


def _updated(omega: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["o"] < 0].iloc[0]
        diag = _floats(own["diag"])
        x, old, c = (_floats(own[n]).reshape(-1, len(diag)) for n in ("x", "old", "c"))
        wx = np.zeros(x.shape)
        for m in pdf[pdf["o"] >= 0].sort_values("o")["m"]:
            wx += _floats(m).reshape(x.shape)
        wx = wx / diag + c
        new = wx if omega == 1 else omega * (wx - old) + old
        return pd.DataFrame({"i": [key[0]], "g": [key[1]], "diag": [own["diag"]], "x": [new.tobytes()], "old": [own["x"]], "c": [own["c"]], "most": [new.max()]})

    return run


def _rows(ks: list, together: int):
    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                for s, x in enumerate(_floats(r.x).reshape(-1, len(ids))):
                    yield pd.DataFrame({"id": ids, "k": ks[r.g * together + s], "x": x})

    return run

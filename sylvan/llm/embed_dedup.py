"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank.

Equal vectors form one class, found by a 128-bit hash with map-side combining, and only
classes are searched. A rotation of the centred principal components is learned on a bounded
sample (``FIT_ROWS`` rows chosen by hash) by iterative quantisation (Gong and Lazebnik, 2011)
and cut at each bit's median, so bits are balanced; further rotations from other starts give
more bits than dimensions. A code is cut into substrings of about log2(classes) bits, one
hash table each. The number of tables is the smallest for which simulated pairs at exactly
``threshold`` are found with probability ``recall``, so pairs above it are found more often;
where MOST_TABLES do not reach it, substrings are shortened until they do, to nothing if need be
(one bucket, which a handful of vectors may come to).

All rows of a bucket are compared in blocks (``bucket_blocks``) as matrix products in double
precision; a pair that shares several buckets counts in the first one only, which both codes
tell, so pairs are never listed. A task returns one row per vector and block: the number of
rows linked and one edge of the block's spanning stars; components come from those edges.

Vectors of every length are indexed, each length with a rotation of its own, and link with those
of their length. Vectors that are null, zero, or hold null or non-finite components link with
nothing and are their own component. Rows that repeat a vec_id are vectors of their own that
share the id; null ids stay null. An empty table gives an empty table. Columns other than
``vec_id`` and ``embedding`` are carried along unless the result has the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_blocks, connected_components, groups_of, local_labels, lookup, materialize

THRESHOLD, RECALL = 0.95, 0.97
#: Rows that the rotation is learned from; rows of a block and of a piece of its product; rows of a task.
FIT_ROWS, BLOCK, STRIP, SHARD_ROWS = 10_000, 2048, 512, 20_000
MOST_TABLES, MOST_BITS = 256, 48
_OUT = ["n_links", "component_id", "kept"]


def learn(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(projection, cut points): ``bits`` columns, in groups of one rotation each."""
    x = sample - sample.mean(axis=0)
    _, vecs = np.linalg.eigh(x.T @ x)
    rng, mats = np.random.default_rng(seed), [np.empty((x.shape[1], 0))]
    while sum(m.shape[1] for m in mats) < bits:
        pcs = vecs[:, ::-1][:, : min(x.shape[1], bits)]
        v = x @ pcs
        r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        mats.append(pcs @ r)
    p = np.concatenate(mats, axis=1)[:, :bits]
    return p, np.median(sample @ p, axis=0)


def keys_of(unit: np.ndarray, p: np.ndarray, cut: np.ndarray, width: int) -> np.ndarray:
    """One substring value a table for each row."""
    if not width:
        return np.zeros((len(unit), 1), np.int64)
    bits = (unit @ p >= cut).reshape(len(unit), -1, width)
    return bits @ (1 << np.arange(width, dtype=np.int64))


def plan(sample: np.ndarray, n: int, threshold: float, recall: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Projection, cut points and substring width for ``n`` classes."""
    rng = np.random.default_rng(11)
    x = sample[rng.integers(len(sample), size=2000)]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(1 - threshold**2) * noise / np.where(size > 0, size, 1)
    width = int(np.clip(np.ceil(np.log2(max(n, 2))), 4, MOST_BITS))
    all_p, all_cut = learn(sample, 0)
    while width:
        for most in (m for m in (16, 64, MOST_TABLES) if m <= MOST_TABLES):  # further rotations only if the first ones don't suffice
            if all_p.shape[1] < width * most:
                all_p, all_cut = learn(sample, width * most)
            p, cut = all_p[:, : width * most], all_cut[: width * most]
            met = np.logical_or.accumulate(keys_of(x, p, cut, width) == keys_of(y, p, cut, width), axis=1).mean(axis=0)
            if (met >= recall).any():
                tables = int(np.argmax(met >= recall)) + 1
                return p[:, : tables * width], cut[: tables * width], width
        width -= 1
    return np.empty((sample.shape[1], 0)), np.empty(0), 0


def _unit(column) -> np.ndarray:
    x = np.array(list(column), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_blocks(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(id, links, label) for the rows of the given block pairs, of one vector length, that have a link."""
    unit, keys = _unit(pdf["embedding"]), np.array(pdf["keys"].tolist())
    table, ids, n, b = (pdf[c].to_numpy() for c in ("table", "id", "n", "b"))
    bi, bj = pdf["bi"].to_numpy(), pdf["bj"].to_numpy()
    order, starts, ends = groups_of(table, pdf["key"].to_numpy(), bi, bj)
    out = []
    for s, e in zip(starts, ends):
        rows = order[s:e]
        one = bi[rows[0]] == bj[rows[0]]
        left = rows if one else rows[b[rows] == bi[rows[0]]]
        right = rows if one else rows[b[rows] == bj[rows[0]]]
        if not len(left) or not len(right) or one and len(left) < 2:
            continue
        found = []
        for at in range(0, len(left), STRIP):
            i, j = np.nonzero(unit[left[at : at + STRIP]] @ unit[right].T >= threshold)
            i += at
            if one:
                i, j = i[i < j], j[i < j]
            i, j = left[i], right[j]
            first = np.argmax(keys[i] == keys[j], axis=1) == table[rows[0]]
            found.append((i[first], j[first]))
        i, j = (np.concatenate(x) for x in zip(*found))
        if not len(i):
            continue
        place = np.zeros(len(pdf), np.int64)
        place[rows] = np.arange(len(rows))
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, place[i], n[j])
        np.add.at(links, place[j], n[i])
        label = local_labels(len(rows), place[i], place[j])
        got = np.flatnonzero(links)
        out.append(pd.DataFrame({"id": ids[rows[got]], "links": links[got], "label": ids[rows[label[got]]]}))
    return pd.concat(out) if out else pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "label": pd.Series(dtype="int64")})


def _rotations(classes: DataFrame, threshold: float, recall: float, fit_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """By vector length, for the lengths of two classes and more."""
    out = {}
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").collect():
        share = min(1.0, fit_rows / r["n"])
        picked = classes.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
        sample = picked.select("embedding").limit(2 * fit_rows).toPandas()["embedding"]
        if len(sample):
            out[r["dim"]] = plan(_unit(sample), r["n"], threshold, recall)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``vectors`` with n_links, component_id and kept."""
    spark = vectors.sparkSession
    vectors = vectors.drop(*_OUT)
    e = F.col("embedding")
    usable = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    own = vectors.withColumns({"__h1": F.xxhash64("embedding"), "__h2": F.xxhash64(F.lit(0x5EED), "embedding"), "__ok": F.coalesce(usable, F.lit(False))})
    classes = own.where("__ok").groupBy("__h1", "__h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumnRenamed("__h1", "id").withColumn("dim", F.size("embedding")), "classes")
    size = classes.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    model = spark.sparkContext.broadcast(_rotations(classes, threshold, recall, fit_rows))

    @F.pandas_udf("array<bigint>")
    def codes(col: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(col), dtype=object)
        for dim, at in col.groupby(col.map(len)).groups.items():
            if dim in model.value:
                out[at] = list(keys_of(_unit(col[at]), *model.value[dim]))
        return out

    coded = classes.select("id", "n", "dim", "embedding", codes("embedding").alias("keys")).where("keys is not null")
    coded = materialize(coded, "codes")
    members = coded.select("id", "dim", F.posexplode("keys").alias("table", "bits")).select("id", "table", F.xxhash64("dim", "bits").alias("key"))
    pairs = bucket_blocks(members, "buckets", BLOCK)
    rows = materialize(pairs, "pairs")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    work = rows.join(coded, "id").withColumn("shard", F.pmod(F.xxhash64("table", "key", "bi", "bj"), F.lit(shards)))
    found = materialize(work.groupBy("dim", "shard").applyInPandas(lambda pdf: link_blocks(pdf, threshold), "id long, links long, label long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    near = connected_components(found.select(F.col("id").alias("a"), F.col("label").alias("b")), "stars")
    # a component is named by the smallest vec_id of its classes, not by a hash
    named = near.join(classes.select("id", "rep"), "id")
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("m"))
    named = lookup(named, lowest, ["component"], "m", size["c"], ["id"], how="inner").select("id", "component_id")
    result = classes.select("id", "__h2", "rep", "n").join(links, "id", "left").join(named, "id", "left")
    result = result.select(F.col("id").alias("__h1"), "__h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = lookup(own, result, ["__h1", "__h2"], "n", size["n"], ["vec_id"])
    good = F.col("__ok") & F.col("n").isNotNull()
    return out.select(
        *vectors.columns,
        F.when(good, F.col("n_links")).otherwise(0).alias("n_links"),
        F.when(good, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        F.when(good, F.col("vec_id").eqNullSafe(F.col("component_id"))).otherwise(True).alias("kept"),
    )

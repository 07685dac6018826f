"""Clustering around centroids, each vector compared only with those in its annulus.

A centroid c can be nearest to x only if | |c| - |x| | is at most the distance from x to any one
centroid. So centroids are sorted by norm, the distance to the one whose norm is next to |x| is
the upper bound, a binary search gives the first and last centroid within the annulus, and just
these are compared exactly (annular search: Hamerly and Drake, 2015). Norms are rounded, so the
annulus is widened by more than their error; those on its boundary are always compared. Of equal
distances the smaller centroid number wins.

All arithmetic is on whole numbers: component x stands for floor(scale * x). Sums and distances
are exact, so results depend neither on partitions nor on the order of rows. Vectors are kept
that have exactly ``dim`` components, none null or not finite, and none beyond LARGEST in size
once scaled (squared distances would not fit into a long); others are not in the result.

The scaled vectors are stored once. A round is one job: each task assigns its rows batch by batch
and sends one row a centroid with exact sums, and ``k`` such rows reach the driver, which holds
nothing but centroids. No row travels by its cluster, so a cluster of any size is spread.

With fewer than ``k`` vectors there are as many centroids; equal vectors may start several, of
which the first takes all and the others stay where they are. A repeated vec_id is a vector of
its own each time, a null one hashes as empty text. A sum of distances that does not fit into a long is null. An empty table gives an empty table. Of the
input only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
LARGEST = 1 << 27
#: Below this size products and sums of squares of 64 components are exact in doubles.
_SMALL = 1 << 22


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance for each row of whole numbers, and how many
    comparisons that took."""
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if largest < _SMALL and x.shape[1] <= 64:
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)

    def squared(rows, number):
        gap = x[rows] - centroids[number]
        return (gap * gap).sum(axis=1).astype(np.int64)

    norms, own = (np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) for a in (centroids, x))
    by_norm = np.argsort(norms, kind="stable")
    norms = norms[by_norm]
    every = np.arange(len(x))
    after = np.clip(np.searchsorted(norms, own), 1, max(len(norms) - 1, 1))
    beside = np.where(np.abs(norms[after - 1] - own) <= np.abs(norms[np.minimum(after, len(norms) - 1)] - own), after - 1, np.minimum(after, len(norms) - 1))
    best = by_norm[beside]
    least = squared(every, best)
    compared = len(x)
    bound = np.sqrt(least.astype(np.float64))
    slack = 1e-9 * (bound + own) + 1e-6
    lo, hi = np.searchsorted(norms, own - bound - slack), np.searchsorted(norms, own + bound + slack, "right")
    for at, number in enumerate(by_norm):
        rows = np.flatnonzero((lo <= at) & (at < hi) & (beside != at))
        if not len(rows):
            continue
        compared += len(rows)
        d = squared(rows, number)
        nearer = (d < least[rows]) | (d == least[rows]) & (number < best[rows])
        best[rows[nearer]], least[rows[nearer]] = number, d[nearer]
    return best, least, compared


def scaled(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v) with whole numbers for the vectors that are kept."""
    e, whole = F.col("embedding"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fit = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LARGEST))
    return vectors.where((F.size(e) == dim) & fit).select("vec_id", whole.alias("v"))


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed:vec_id; of equal ids, by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.orderBy(key, "v").limit(k).collect()], np.int64)


def _step(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    dim = centroids.shape[1]

    def sums(batches):
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            best = assign(x, centroids)[0]
            order = np.argsort(best, kind="stable")
            here, at = np.unique(best[order], return_index=True)
            n += np.bincount(best, minlength=len(n))
            if len(here):
                total[here] += np.add.reduceat(x[order], at, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    # sums of a task fit into a long for rows in their 2^36s; those of all tasks are decimals
    parts = rows.select("v").mapInArrow(sums, "cluster int, n long, total array<bigint>")
    wide = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(dim)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():
        out[r["cluster"]] = [int(r[f"s{k}"]) // r["n"] for k in range(dim)]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared) of the kept vectors, cluster_inertia and inertia (sums of
    distances) and the digest of the final centroid. ``k`` centroids are broadcast and ``dim`` sums for
    each come to the driver every round."""
    rows = materialize(scaled(vectors, dim, scale), "whole")
    centroids = start(rows, k, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        now = _step(rows, centroids)
        if np.array_equal(now, centroids):
            break  # further rounds would change nothing
        centroids = now

    def final(batches):
        for batch in batches:
            best, least, _ = assign(_matrix(batch.column("v"), dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    found = materialize(rows.mapInArrow(final, f"vec_id {kind}, cluster int, distance long"), "assigned")
    own = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}
    every = None if None in own.values() or sum(own.values()) >= 1 << 63 else sum(own.values())
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = found.sparkSession.createDataFrame([(c, d, every, digest[c]) for c, d in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

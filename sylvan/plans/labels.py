"""Label propagation and denoising by smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.functions.rng import uniform
from sylvan.plans.smoothing import smooth, smooth_rf
from sylvan.sources.graph import Graph


def train_mask(labels: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """The rows (id, k, y) of about ``share`` of the vertices."""
    return labels.where(uniform("train", seed, F.col("id")) < share)


def propagate_labels(g: Graph, y: DataFrame, q: float, method: str = "exact", reps: int = 10, seed: int = 0) -> DataFrame:
    """(id, label): the class with the largest smoothed value, the smallest of equal ones; vertices that no
    label reaches get none. Methods: exact, xtilde (roots' values), xbar (trees' means)."""
    if method not in ("exact", "xtilde", "xbar"):
        raise ValueError(f"unknown method {method}")
    x = smooth(g, q, y) if method == "exact" else smooth_rf(g, q, y, reps, 1 if method == "xtilde" else 2, seed=seed)
    return x.groupBy("id").agg(F.max_by("k", F.struct(F.round("x", 9), -F.col("k"))).alias("label"))


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """(n, accuracy) over all labelled vertices; a vertex without prediction counts as wrong."""
    both = labels.select("id", "k").join(predicted, "id", "left")
    return both.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("k") == F.col("label"), F.lit(False)).cast("double")).alias("accuracy"))


def denoise(g: Graph, y: DataFrame, q: float, reps: int = 20, seed: int = 0) -> DataFrame:
    """(id, y, exact, v1, v2): a signal and its three smoothings."""
    one = lambda x, name: x.select("id", F.col("x").alias(name))
    out = y.select("id", "y").join(one(smooth(g, q, y), "exact"), "id")
    return out.join(one(smooth_rf(g, q, y, reps, 1, seed=seed), "v1"), "id").join(one(smooth_rf(g, q, y, reps, 2, seed=seed), "v2"), "id")

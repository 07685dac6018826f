"""Breakpoints of the coupled forests: q goes down continuously, and the forest changes where a root dies.

With all stacks fixed, a vertex whose top arrow has the draw u is a root while q is above u / (1 - u) * degree.
So going down, the next event is at the largest such value among the roots. There the root takes
its arrow: its tree joins the one that the arrow leads to, or, if that is its own, a cycle is popped and
the tree is walked anew, with new draws at that q. No other tree changes. Between two events the
forest is the one that a cold start on the same stacks gives (``forest.random_forest``).

Arrows are drawn by joins, as many levels of a stack as are needed; the events of a repetition depend
on each other and are worked off in one task, in a queue by q, with one tree as arrays at a time.
A repetition has to fit into a task (``forest.LOCAL`` vertices). For larger graphs choose values of
q and take ``forest.random_forest`` with a grid, which has no such bound.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators.forest import LOCAL, _depth, _given, _resolve, drawn, pop_arrays
from sylvan.plans.ground import ground
from sylvan.sources.graph import Graph, totals

_EVENTS = "rep int, event int, q double, root long, n_rerooted long, n_roots long"


class _Repetition:
    """The arrows of one repetition and its forest at some q."""

    def __init__(self, pdf: pd.DataFrame, q: float):
        pdf = pdf.sort_values(["id", "level"])
        self.ids, self.start = np.unique(pdf["id"].to_numpy(), return_index=True)
        self.stop, self.at = np.append(self.start[1:], len(pdf)), self.start.copy()
        u = pdf["u"].to_numpy()
        self.star = u / (1 - u) * pdf["d"].to_numpy()
        self.to = np.searchsorted(self.ids, pdf["goal"].to_numpy())
        self.root = np.full(len(self.ids), -1)
        self.walk(np.arange(len(self.ids)), q)

    def walk(self, live: np.ndarray, q: float) -> None:
        """Pops the cycles of ``live`` at q, and finds its roots; all others keep theirs. A stack that ran out
        leaves the root -1."""
        dies = lambda arrow: self.star[arrow] < q
        pop_arrays(self.to, dies, self.start, self.stop, self.at, live)
        known, own = self.at[live] < self.stop[live], np.arange(len(live))
        top = np.minimum(self.at[live], len(self.to) - 1)
        ends, place = ~known | dies(top), np.full(len(self.ids), -1)
        place[live] = own
        inside = np.where(ends, -1, place[self.to[top]])
        last = np.where(~known, -1, np.where(ends, live, np.where(inside < 0, self.root[self.to[top]], -1)))
        self.root[live] = last[_resolve(np.where(inside < 0, own, inside))]

    def threshold(self, vertex: int) -> float:
        return float(self.star[self.at[vertex]])

    def event(self, vertex: int, q: float) -> int:
        """The root ``vertex`` takes its arrow; how many vertices have another root then."""
        tree = np.flatnonzero(self.root == vertex)
        ahead = self.root[self.to[self.at[vertex]]]
        if ahead != vertex:
            self.root[tree] = ahead
            return len(tree)
        self.walk(tree, q)
        return int((self.root[tree] != vertex).sum())


def _queue(high: float, low: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, rep, out = _Repetition(pdf, high), pdf["rep"].iloc[0], []
        is_root = state.root == np.arange(len(state.ids))
        queue = [(-state.threshold(v), v) for v in np.flatnonzero(is_root).tolist()]
        heapq.heapify(queue)
        roots = len(queue)
        while queue and -queue[0][0] >= low and (state.root >= 0).all():
            q, v = heapq.heappop(queue)
            tree = np.flatnonzero(state.root == v)
            n = state.event(v, -q)
            new = tree[state.root[tree] == tree].tolist()
            roots += len(new) - 1
            for r in new:
                heapq.heappush(queue, (-state.threshold(r), r))
            out.append((rep, len(out) + 1, -q, int(state.ids[v]), n, roots))
        if (state.root < 0).any():  # a stack ran out: nothing of this repetition counts yet
            out = [(rep, -1, 0.0, 0, 0, 0)]
        return pd.DataFrame(out, columns=["rep", "event", "q", "root", "n_rerooted", "n_roots"])

    return run


def coupled_events(g: Graph, high: float, low: float, reps: int = 1, seed: int = 0) -> DataFrame:
    """(rep, event, q, root, n_rerooted, n_roots): the events between ``high`` and ``low``, numbered from 1 as q goes
    down: the root that dies, the vertices whose root changes, and the roots there are then."""
    if not 0 < low <= high:
        raise ValueError("q goes down from high to low, both positive")
    if g.nv() > LOCAL:
        raise ValueError(f"a repetition of more than {LOCAL} vertices does not fit into a task; use random_forest with a grid")
    spark, index = g.edges.sparkSession, ground(g.draw_index())
    base = ground(g.vertices.join(totals(index), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("n", F.lit(0)).alias("n")))
    arrows = index.select("id", "cell", "dst", "lo", "hi")
    left = base.select("id").crossJoin(F.broadcast(spark.range(reps).select(F.col("id").cast("int").alias("rep")))).withColumn("level", F.lit(0).cast("long"))
    out, deep = [], _depth(base.count() * reps)
    while True:
        rows = _given(drawn(base, arrows, left, str(seed), F.lit(deep).cast("long")))
        found = ground(rows.groupBy("rep").applyInPandas(_queue(high, low), _EVENTS))
        out.append(found.where("event > 0"))
        again = [r["rep"] for r in found.where("event < 0").select("rep").collect()]
        if not again:
            return reduce(DataFrame.union, out)
        left, deep = left.where(F.col("rep").isin(again)), 2 * deep

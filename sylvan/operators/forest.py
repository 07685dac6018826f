"""Random spanning forests and trees.

Every vertex owns a stack of arrows that are pure functions of (seed, rep, id, level): draw u makes
the vertex a root if u * (q + d) < q, else draw v picks a neighbour by weight. Popping the
cycles of the top arrows until none is left gives a forest from p(forest) ~ q^roots * product
of weights (Wilson 1996; Propp and Wilson 1998), and the same one in whatever order
cycles are popped. Lowering q on the same stacks couples the forests of a grid of q.

So the order is chosen to suit Spark. Arrows are drawn by joins, several levels of a stack at a
time and by all tasks. While a repetition has more than ``LOCAL`` vertices whose root is not
known, all cycles of all repetitions are popped by joins with pointer doubling; a vertex that
reached a root is done and takes no further part, so few rounds leave far fewer. Once what is left of a
repetition fits, its drawn arrows meet in one task, which pops them as arrays; where a stack
runs out, more of it is drawn. Nothing of a graph passes through the driver, and no task holds more
of it than LOCAL vertices with the arrows drawn for them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.functions.rng import uniform
from sylvan.plans.ground import Rounds, Store, ground
from sylvan.sources.graph import Graph, cell_of, totals

#: Vertices of a repetition that one task may pop, and arrows of a stack that are drawn at first: more
#: where there are few vertices, up to DEEPEST, so that AT_ONCE are drawn together.
LOCAL, FIRST, DEEPEST, AT_ONCE = 100_000, 4, 64, 100_000

#: Turns of one job in which parts of a repetition pop their own cycles, fewer where there are many vertices.
TURNS = 16

#: Steps of a walk on average above which repetitions pop cycles in parts.
LONG = 12


def rates(g: Graph, q) -> DataFrame:
    """(id, q) from a number or from (id, q) rows; a vertex without a row has rate 0."""
    if isinstance(q, DataFrame):
        return g.vertices.join(q.select("id", F.col("q").cast("double").alias("q")), "id", "left").select("id", F.coalesce("q", F.lit(0.0)).alias("q"))
    return g.vertices.select("id", F.lit(float(q)).alias("q"))


def _checked(g: Graph, q) -> None:
    """Every component needs a vertex that can become a root, else no walk would end."""
    if not isinstance(q, DataFrame):
        if q <= 0:
            raise ValueError("q must be positive")
        return
    from sylvan.operators.connectivity import connected_components

    some = connected_components(g).join(rates(g, q), "id").groupBy("component").agg(F.max("q").alias("q"))
    if some.where("q <= 0").limit(1).count():
        raise ValueError("a component has no vertex with a positive q")


def random_forest(g: Graph, q, reps: int = 1, seed: int = 0, grid: list[float] | None = None, check: bool = True, moment_seeds: bool = False, local: int = LOCAL) -> DataFrame:
    """(rep, q_index, id, next, root, level): ``reps`` forests, next null at roots; level is the height in
    its stack of a vertex' arrow. With ``grid``, one for each of its values of q, coupled by going
    down the grid on the same stacks (``moment_seeds``: with stacks of its own for each value)."""
    if check:
        _checked(g, q if grid is None else min(grid))
    spark = g.edges.sparkSession
    every = [q] if grid is None else [float(x) for x in grid]
    down = [0] if grid is None else sorted(range(len(every)), key=lambda k: -every[k])
    seeds = [f"{seed}.{k}" for k in down] if moment_seeds else [str(seed)]
    bottom = g.vertices.crossJoin(F.broadcast(spark.range(reps).select(F.col("id").cast("int").alias("rep")))).withColumn("level", F.lit(0).cast("long"))
    n = g.nv()
    base, arrows = _indexed(g) if n <= max(local, LOCAL) else (None, None)
    if n <= local:
        walks = [([k], s) for k, s in zip(down, seeds)] if moment_seeds else [(down, seeds[0])]
        return reduce(DataFrame.union, [_descended(base, arrows, bottom, [(k, every[k]) for k in ks], s, g, n * reps) for ks, s in walks])
    out, levels = [], bottom
    for step, k in enumerate(down):
        rate = rates(g, every[k])
        rated = None if base is None else ground(base.join(rate, "id"))
        forest = _popped(g, rate, rated, arrows, bottom if moment_seeds else levels, seeds[step if moment_seeds else 0], local)
        levels = forest.select("id", "rep", "level")
        out.append(forest.select("rep", F.lit(k).alias("q_index"), "id", "next", "root", "level"))
    return reduce(DataFrame.union, out)


def random_forest_distributed(g: Graph, q, reps: int = 1, seed: int = 0, grid: list[float] | None = None, moment_seeds: bool = False, check: bool = True, local: int = 0) -> DataFrame:
    """The same forests with no more than ``local`` vertices of a repetition in a task: by joins alone for 0."""
    return random_forest(g, q, reps, seed, grid, check, moment_seeds, local)


def _indexed(g: Graph) -> tuple[DataFrame, DataFrame]:
    """What draws by joins read: (id, d, n) of all vertices and the drawing index (id, cell, dst, lo, hi)."""
    index = ground(g.draw_index())
    base = ground(g.vertices.join(totals(index), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("n", F.lit(0)).alias("n")))
    return base, index.select("id", "cell", "dst", "lo", "hi")


def drawn_by_all(g: Graph, tops: DataFrame, seed) -> DataFrame:
    """(rep, id, level, next, u, d) as ``drawn`` gives them. Where all vertices draw, each edge takes those of its vertex' draws that
    fall into its interval, so that no index of all edges is written and read again."""
    key = (seed, F.col("rep"), F.col("id"), F.col("level"))
    tops = tops.select("rep", "id", "level", uniform("u", *key).alias("u"), uniform("v", *key).alias("v"))
    own = tops.groupBy("id").agg(F.collect_list(F.struct("rep", "level", "u", "v")).alias("draws"))
    met = g.cumulative().withColumnRenamed("src", "id").join(own.hint("merge"), "id")
    mine = F.filter("draws", lambda x: (x["v"] * F.col("d") >= F.col("lo")) & (x["v"] * F.col("d") < F.col("hi")))
    met = met.select("id", "dst", "d", F.explode(mine).alias("x"))
    alone = tops.join(g.edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    lone = alone.select("rep", "id", "level", F.lit(None).cast("long").alias("next"), "u", F.lit(0.0).alias("d"))
    return met.select("x.rep", "id", "x.level", F.col("dst").alias("next"), "x.u", "d").unionByName(lone)


def drawn(base: DataFrame, arrows: DataFrame, tops: DataFrame, seed, many=None) -> DataFrame:
    """(rep, id, level, next, u, d): the arrow of each (rep, id, level), or of ``many`` levels from it on. next is
    where it leads unless the vertex dies by u; null for isolated vertices."""
    at = tops.join(base.select("id", "d", "n"), "id")
    if many is not None:
        at = at.withColumn("level", F.explode(F.sequence(F.col("level"), F.col("level") + many - 1)))
    key = (seed, F.col("rep"), F.col("id"), F.col("level"))
    at = at.select("rep", "id", "level", "d", "n", uniform("u", *key).alias("u"))
    moves = at.where("n > 0").withColumn("t", uniform("v", *key) * F.col("d")).withColumn("cell", cell_of(F.col("t"), F.col("d"), F.col("n")))
    moves = moves.join(arrows, ["id", "cell"]).where("lo <= t and t < hi").select("rep", "id", "level", F.col("dst").alias("next"), "u", "d")
    return moves.unionByName(at.where("n = 0").select("rep", "id", "level", F.lit(None).cast("long").alias("next"), "u", "d"))


def _resolve(to: np.ndarray) -> np.ndarray:
    """The end of each position's way by doubling: ways that end do so at a position that points at itself,
    the others come to a cycle."""
    for _ in range(int(len(to)).bit_length()):
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    return to


def pop_arrays(to: np.ndarray, ends, start: np.ndarray, stop: np.ndarray, at: np.ndarray, live: np.ndarray | None = None) -> None:
    """Pops cycles until none is left among known arrows. Vertex i's arrows are at start[i] .. stop[i] - 1; ``at`` is the
    one on top and is moved on. Arrow a leads to vertex to[a], or, if ``ends`` says so, out of the game. Only
    ``live`` vertices (by default all) may be on a cycle."""
    n = len(start)
    live, place = np.arange(n) if live is None else live, np.full(n, -1)
    place[live] = np.arange(len(live))
    while len(live):
        own, top = np.arange(len(live)), at[live]
        ended = (top >= stop[live]) | ends(np.minimum(top, len(to) - 1))
        goal = np.where(ended, -1, place[np.where(ended, 0, to[np.minimum(top, len(to) - 1)])])
        goal = np.where(goal < 0, own, goal)  # a vertex whose way has an end is live no more, and its place is -1
        far = _resolve(goal)
        looping = goal[far] != far
        at[live[np.unique(far[looping])]] += 1
        place[live[~looping]] = -1
        live = live[looping]
        place[live] = np.arange(len(live))


def _given(picked: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What ``_grid_walk`` reads, without nulls: the vertex that an arrow leads to (its own if it is ``lone``), and its
    root where ``known`` (rep, next, __root) has it."""
    picked = picked.withColumn("__root", F.lit(None).cast("long")) if known is None else picked.join(known, ["rep", "next"], "left")
    rows = {"lone": F.col("next").isNull(), "goal": F.coalesce("next", "id"), "outer": F.col("__root").isNotNull(), "outer_root": F.coalesce("__root", F.lit(0))}
    return picked.select("rep", "id", "level", "u", "d", *(["q"] if "q" in picked.columns else []), *(c.alias(n) for n, c in rows.items()))


def _grid_walk(qs: list[tuple[int, float]]):
    """The task that pops some repetitions together going down ``qs``; rows without a root where stacks ran out,
    after which there are none of that repetition."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "id", "level"])
        lone, goal, outer, outer_root, rep, own = (pdf[c].to_numpy() for c in ("lone", "goal", "outer", "outer_root", "rep", "id"))
        names, (reps, which) = np.unique(own), np.unique(rep, return_inverse=True)
        keys, start = np.unique(which * len(names) + np.searchsorted(names, own), return_index=True)
        ids, of = own[start], which[start]
        to = which * len(names) + np.minimum(np.searchsorted(names, goal), len(names) - 1)
        to = np.minimum(np.searchsorted(keys, to), len(keys) - 1)
        if (~outer & ((ids[to] != goal) | (of[to] != which))).any():
            raise ValueError("an arrow leads to no vertex of its repetition")
        stop = np.append(start[1:], len(pdf))
        at, low = start.copy(), pdf["level"].to_numpy()[start]
        u, d = pdf["u"].to_numpy(), pdf["d"].to_numpy()
        out, over = [], np.zeros(len(reps), bool)
        for k, q in qs:
            q = pdf["q"].to_numpy() if q is None else q
            dies = lone | (u * (q + d) < q)
            pop_arrays(to, (dies | outer).__getitem__, start, stop, at)
            known = at < stop
            top = np.minimum(at, len(u) - 1)
            goes = known & ~dies[top] & ~outer[top]
            far = _resolve(np.where(goes, to[top], np.arange(len(ids))))
            root = np.where(outer[top] & ~dies[top], outer_root[top], ids)[far]
            none, done = dies[top] | ~known, known[far]
            nxt, root = (pd.Series(x).astype("Int64").mask(pd.Series(gone)) for x, gone in ((np.where(none, 0, goal[top]), none), (root, ~done)))
            frame = pd.DataFrame({"rep": reps[of], "q_index": k, "id": ids, "next": nxt, "root": root, "level": low + at - start})
            out.append(frame[~over[of]])
            over[of[~done]] = True
        return pd.concat(out)

    return run


_WALKED = "rep int, q_index int, id long, next long, root long, level long"


def _depth(rows: int) -> int:
    return min(max(FIRST, AT_ONCE // max(rows, 1)), DEEPEST)


def _descended(base: DataFrame, arrows: DataFrame, tops: DataFrame, qs: list[tuple[int, object]], seed: str, g: Graph, size: int) -> DataFrame:
    """Forests of all ``qs`` (index, q), from the highest on, of repetitions that fit into a task each. Where a stack
    ran out, the repetition goes on from the levels it reached, with twice as many arrows."""
    vector = isinstance(qs[0][1], DataFrame)
    if vector:
        base = ground(base.join(rates(g, qs[0][1]), "id"))
        qs = [(qs[0][0], None)]
    # repetitions that a task takes together: LOCAL vertices at most, and work for every core
    n, cores = base.count(), base.sparkSession.sparkContext.defaultParallelism
    width = max(1, min(LOCAL // max(n, 1), -(-size // (max(n, 1) * cores))))
    out, order, depth = [], [k for k, _ in qs], _depth(size)
    left = {None: tops.select("rep", "id", "level")}
    while left:
        found, again = [], {}
        for first, rows in left.items():
            these = qs if first is None else qs[order.index(first) :]
            deep = F.greatest(F.lit(depth).cast("long"), F.col("level"))
            picked = drawn(base, arrows, rows, seed, deep)
            picked = picked.join(base.select("id", "q"), "id") if vector else picked
            walked = ground(_given(picked).groupBy(F.floor(F.col("rep") / width).alias("bunch")).applyInPandas(_grid_walk(these), _WALKED))
            open_ = walked.where("root is null").groupBy("q_index").agg(F.collect_set("rep").alias("reps")).collect()
            for r in open_:
                mine = (F.col("q_index") == r["q_index"]) & F.col("rep").isin(r["reps"])
                again.setdefault(r["q_index"], []).append(walked.where(mine).select("rep", "id", "level"))
                walked = walked.where(~mine)
            found.append(walked)
        out += found
        left = {k: reduce(DataFrame.union, v) for k, v in again.items()}
    return reduce(DataFrame.union, out)


def _popped(g: Graph, rate: DataFrame, base: DataFrame | None, arrows: DataFrame | None, levels: DataFrame, seed: str, local: int) -> DataFrame:
    """(rep, id, level, next, root) from rates (id, q), rates and degrees (id, d, n, q), the drawing index and the stacks' levels (id,
    rep, level). A round takes the top arrows of the vertices whose root is not known yet, follows them by
    pointer doubling, and pops the vertices on cycles, which are those that some vertex still points at
    after all doublings. Vertices that reached a root are done: no cycle is on their way. They go to one
    table, which a round joins by the few vertices that it asks for. Without an index all first draw by their edges, and one is made of
    the edges of those that the first round leaves. Repetitions of fewer than two times ``local``
    vertices first pop what they can in parts, if walks are long: where more than one of LONG top arrows ends, rounds are few."""

    def topmost(tops: DataFrame) -> DataFrame:
        a = (drawn_by_all(g, tops, seed) if base is None else drawn(base, arrows, tops, seed)).join(rate, "id")
        dies = F.col("next").isNull() | (F.col("u") * (F.col("q") + F.col("d")) < F.col("q"))
        return a.select("rep", "id", "level", F.when(~dies, F.col("next")).alias("next"))

    def indexed(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        ids = ground(left.select("id").distinct())
        b, a = _indexed(Graph(ids, ground(g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))))
        return ground(b.join(rate, "id")), a

    keep, settled = Rounds(), Store("settled")
    active = keep(topmost(levels))
    ends = active.agg(F.avg(F.col("next").isNull().cast("double"))).first()[0]
    long = ends is not None and ends * LONG <= 1
    while True:
        sizes = active.groupBy("rep").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
        n = sizes["n"] or 0
        if not n:
            return settled.read()
        if base is None and long and sizes["most"] < 2 * local:
            base, arrows = indexed(active)
        if sizes["most"] <= local:
            return settled.add(_finished(base, arrows, active.select("rep", "id", "level"), seed, settled))
        if long and sizes["most"] < 2 * local:
            active = keep(topmost(_in_turns(base, arrows, active.select("rep", "id", "level"), seed, local, n)))
        far = active.withColumns({"to": F.coalesce("next", "id"), "done": F.col("next").isNull()})
        if settled:
            asked = active.select("rep", "next").where("next is not null").distinct()
            known = settled.read().select("rep", F.col("id").alias("next"), F.col("root").alias("__root")).join(asked, ["rep", "next"], "left_semi")
            far = far.join(known, ["rep", "next"], "left").select("rep", "id", "level", "next", F.coalesce("__root", "to").alias("to"), (F.col("done") | F.col("__root").isNotNull()).alias("done"))
        far = _followed(far, n)
        settled.add(far.where("done").select("rep", "id", "level", "next", F.col("to").alias("root")))
        left = far.where("not done")
        loops = left.select("rep", F.col("to").alias("id")).distinct()
        left = left.select("rep", "id", "level", "next")
        if base is None:
            base, arrows = indexed(left)
        popped = left.join(loops, ["rep", "id"], "left_semi").withColumn("level", F.col("level") + 1)
        active = keep(left.join(loops, ["rep", "id"], "left_anti").unionByName(topmost(popped.select("rep", "id", "level"))))


_TURN = "rep int, part boolean, id long, place long, size long, level long, moved long, dry boolean, due long, goals array<long>"


def drain(to: np.ndarray, start: np.ndarray, kept: np.ndarray, due: np.ndarray) -> None:
    """Takes back last arrows of vertices that keep more than lead to them, until none does: ``kept`` and ``due`` are moved down.
    Vertex i's arrows begin at start[i] and lead to vertices to[a], -1 for others; due[i] of all arrows that are kept lead to i."""
    low = np.flatnonzero(due < kept)
    while len(low):
        many = kept[low] - due[low]
        back = np.repeat(start[low] + kept[low] - np.cumsum(many), many) + np.arange(many.sum())
        kept[low] = due[low]
        near, fewer = np.unique(to[back], return_counts=True)
        near, fewer = near[near >= 0], fewer[near >= 0]
        due[near] -= fewer
        low = near[due[near] < kept[near]]


def _turn(turn: int, local: int):
    """The task of a part of a repetition: adds up what other parts say (rows without goals), drains the part, pops the cycles inside it, and
    says to others how many arrows at them are gone. Places are shuffled alike in all parts, so that the next turn has other parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        said = pdf["goals"].isna()
        mine, said = pdf[~said].sort_values("place"), pdf[said]
        place, due = mine["place"].to_numpy(), mine["due"].to_numpy().copy()
        np.add.at(due, np.searchsorted(place, said["place"].to_numpy()), said["due"].to_numpy())
        goals, many = np.concatenate(mine["goals"].to_list()).astype(np.int64), mine["goals"].map(len).to_numpy()
        start, kept = np.cumsum(many) - many, many.copy()
        to = np.minimum(np.searchsorted(place, goals), len(place) - 1)
        to = np.where(place[to] == goals, to, -1)
        drain(to, start, kept, due)
        gone = np.arange(len(goals)) - np.repeat(start, many) >= np.repeat(kept, many)
        others, fewer = np.unique(goals[gone & (to < 0)], return_counts=True)
        stop, at = start + kept, start.copy()
        if len(goals):
            pop_arrays(to, (to < 0).__getitem__, start, stop, at)
        size, moved = int(mine["size"].iloc[0]), at - start
        part = np.random.default_rng((turn, size)).permutation(size) >= local
        counts = {"level": mine["level"] + moved, "moved": mine["moved"] + moved, "dry": mine["dry"].to_numpy() & (kept == many), "due": due - moved}
        mine = mine.assign(part=part[place], **counts, goals=[goals[a:b] for a, b in zip(at, stop)])
        say = pd.DataFrame({"rep": mine["rep"].iloc[0], "part": part[others], "id": 0, "place": others, "size": size, "level": 0, "moved": 0, "dry": False, "due": -fewer, "goals": None})
        return pd.concat([mine, say]) if len(say) else mine

    return run


def _in_turns(base: DataFrame, arrows: DataFrame, tops: DataFrame, seed: str, local: int, n: int) -> DataFrame:
    """(rep, id, level) of the ``n`` vertices of ``tops``, repetitions of fewer than two times ``local``, after popping cycles from below and
    from above. Popped arrows are cycles, so as many lead to a vertex as from it, and one that ends a way is never popped. Of all
    levels of which that holds the highest are those where no cycle is left. From above, vertices keep all arrows before their first that
    ends a way, and whoever keeps more than lead to it takes back the last: where all are near each other, such turns grow with the logarithm
    of the pops. From below, cycles are popped, which is sooner done where ways are short. Neither needs an order, so parts do both: ``local`` vertices
    in one task, the others in another, and other vertices in the next turn. A job takes many turns; jobs go on while vertices move, at most until
    none has to take back any. Where a stack runs out, the repetition goes on from the levels reached."""
    mine = Window.partitionBy("rep")
    places = ground(tops.select("rep", "id", (F.row_number().over(mine.orderBy("id")) - 1).cast("long").alias("place"), F.count("*").over(mine).alias("size")))
    depth = F.lit(max(FIRST, AT_ONCE // n)).cast("long")

    def stacks(tops: DataFrame) -> DataFrame:
        a = drawn(base, arrows, tops, seed, depth).join(base.select("id", "q"), "id")
        a = a.join(places.select("rep", F.col("id").alias("next"), F.col("place").alias("goal")), ["rep", "next"], "left")
        # a vertex without a place has its root already
        ends = F.col("goal").isNull() | (F.col("u") * (F.col("q") + F.col("d")) < F.col("q"))
        listed = F.array_sort(F.collect_list(F.struct("level", F.coalesce("goal", F.lit(-1).cast("long")).alias("goal"))))
        a = a.groupBy("rep", "id").agg(F.min("level").alias("level"), F.min(F.when(ends, F.col("level"))).alias("end"), listed.alias("a"))
        goals = F.when(F.col("end").isNull(), F.col("a.goal")).otherwise(F.slice("a.goal", F.lit(1), (F.col("end") - F.col("level")).cast("int")))
        zero, dry = F.lit(0).cast("long"), F.col("end").isNull()
        a = ground(a.join(places, ["rep", "id"]).select("rep", (F.col("place") >= local).alias("part"), "id", "place", "size", "level", zero.alias("moved"), dry.alias("dry"), goals.alias("goals")))
        due = a.select("rep", F.explode("goals").alias("place")).groupBy("rep", "place").agg(F.count("*").alias("due"))
        return a.join(due, ["rep", "place"], "left").withColumn("due", F.coalesce("due", zero))

    out, keep, state, turn = Store("turned"), Rounds("turns"), stacks(tops), 0
    while True:
        for turn in range(turn + 1, turn + 1 + max(2, min(TURNS, AT_ONCE // n))):
            state = state.groupBy("rep", "part").applyInPandas(_turn(turn, local), _TURN)
        state = keep(state)
        said, used, empty = F.col("goals").isNull(), F.col("dry"), F.size("goals") == 0
        found = state.agg(F.max(said).alias("said"), F.max(used).alias("dry"), F.max(used & empty).alias("empty"), F.sum("moved").alias("moved")).first()
        below = state.where(~said).select("rep", "id", "level")
        above = state.where(~said).select("rep", "id", (F.col("level") + F.size("goals")).alias("level"))
        if not found["said"] and found["dry"]:
            again = state.where("dry").select("rep").distinct()
            out.add(above.join(again, "rep", "left_anti"))
            state = stacks(ground(above.join(again, "rep", "left_semi")))
        elif not found["said"] or not (found["moved"] or found["empty"]):
            return out.add(above if not found["said"] else below)
        elif found["empty"]:
            state = stacks(ground(below))
        else:
            state = state.withColumn("moved", F.lit(0).cast("long"))


def _finished(base: DataFrame, arrows: DataFrame, tops: DataFrame, seed: str, settled: Store) -> DataFrame:
    """(rep, id, level, next, root) of the vertices left, a repetition a task, beside those whose roots are known."""
    out = Store("finished")
    tops = ground(tops)
    depth = _depth(tops.count())
    while True:
        deep = F.greatest(F.lit(depth).cast("long"), F.col("level"))
        picked = drawn(base, arrows, tops, seed, deep).join(base.select("id", "q"), "id")
        asked = picked.where("next is not null").select("rep", "next").distinct()
        known = None
        for done in (settled, out):
            if done:
                rows = done.read().select("rep", F.col("id").alias("next"), F.col("root").alias("__root")).join(asked, ["rep", "next"], "left_semi")
                known = rows if known is None else known.unionByName(rows)
        walked = ground(_given(picked, known).groupBy("rep").applyInPandas(_grid_walk([(0, None)]), _WALKED))
        out.add(walked.where("root is not null").select("rep", "id", "level", "next", "root"))
        tops = walked.where("root is null").select("rep", "id", "level")
        if not tops.limit(1).count():
            return out.read()


def _followed(far: DataFrame, n: int) -> DataFrame:
    """``far``, of at most ``n`` rows that are not done, with ``to`` moved on by pointer doubling to the root,
    where done, or on to a cycle. Only rows that are not done are joined, two doublings a table. A way of many steps
    has ways of all fewer steps on it, and places that are reached become fewer until they are those on cycles; so when
    neither open ways nor the places they reach became fewer, none will."""
    keep, doublings, left = Rounds(), int(np.ceil(np.log2(n + 1))), None
    far = keep(far)
    for k in range(doublings):
        way = far.select("rep", F.col("id").alias("to"), F.col("to").alias("further"), F.col("done").alias("ends"))
        step = far.where("not done").join(way, ["rep", "to"]).withColumns({"to": F.col("further"), "done": F.col("ends")})
        far = far.where("done").unionByName(step.select(*far.columns))
        if k % 2 or k == doublings - 1:
            far = keep(far)
            before, left = left, far.where("not done").groupBy("rep", "to").count().agg(F.sum("count"), F.count("*")).first()
            if not left[1] or left == before:
                break
    return far


def resolve_roots(forest: DataFrame) -> DataFrame:
    """(rep, id, root) from parent pointers (rep, id, next) alone, by pointer doubling."""
    far = _followed(forest.select("rep", "id", F.coalesce("next", "id").alias("to"), F.col("next").isNull().alias("done")), forest.count())
    return far.select("rep", "id", F.col("to").alias("root"))


def out_neighbors(forest: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, id, neighbors): where the arrows of the vertices (id) lead, an empty list at roots."""
    return forest.join(ids.select("id"), "id", "left_semi").select("rep", "id", F.array_compact(F.array("next")).alias("neighbors"))


def death_thresholds(g: Graph, forest: DataFrame, seed: int = 0) -> DataFrame:
    """(rep, id, q_star): for each root of a forest sampled with ``seed`` the value u / (1 - u) * degree of q below
    which, going down, it stops being one."""
    u = uniform("u", seed, F.col("rep"), F.col("id"), F.col("level"))
    return forest.where("next is null").join(g.degree(), "id").select("rep", "id", (u / (1 - u) * F.col("d")).alias("q_star"))


def spanning_tree(g: Graph, root: int | None = None, reps: int = 1, seed: int = 0, force: bool = False) -> DataFrame:
    """(rep, id, next, root): uniform (by weight) spanning trees rooted at ``root``, or at a vertex drawn
    from the seed. Raises for an unknown root, and for a graph of several parts unless ``force``,
    which then gives the tree of the root's part."""
    from sylvan.operators.connectivity import connected_components

    if root is None:
        root = g.vertices.orderBy(uniform("root", seed, F.col("id")), "id").first()["id"]
    comp = connected_components(g)
    mine = comp.where(F.col("id") == root).first()
    if mine is None:
        raise IndexError(f"{root} is not a vertex")
    inside = comp.where(F.col("component") == mine["component"]).select("id")
    if inside.count() < g.nv():
        if not force:
            raise ValueError("the graph is not connected")
        g = Graph(inside, g.edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi"))
    only = g.vertices.select("id", F.when(F.col("id") == root, 1e300).otherwise(0.0).alias("q"))
    return random_forest(g, only, reps, seed, check=False).drop("q_index", "level")


def nroots(forest: DataFrame) -> DataFrame:
    """(rep, nv, nroots, ne)."""
    return forest.groupBy("rep").agg(F.count("*").alias("nv"), F.sum((F.col("id") == F.col("root")).cast("long")).alias("nroots"), F.count("next").alias("ne"))


def digraph(forest: DataFrame) -> DataFrame:
    """(rep, src, dst): arrows from child to parent."""
    return forest.where("next is not null").select("rep", F.col("id").alias("src"), F.col("next").alias("dst"))


def quality(g: Graph, forest: DataFrame) -> DataFrame:
    """(rep, n, n_roots, bad_edges, bad_roots, unreached): violations, all 0 for a forest. An arrow must be an edge,
    a root must point nowhere, and every vertex must reach a root, the one it names."""
    reach = resolve_roots(forest).select("rep", "id", F.col("root").alias("reached"))
    edge = g.edges.select(F.col("src").alias("id"), F.col("dst").alias("next"), F.lit(True).alias("is_edge"))
    f = forest.select("rep", "id", "next", "root").join(edge, ["id", "next"], "left").join(reach, ["rep", "id"])
    count = lambda c: F.sum(c.cast("long"))
    ends = forest.where("next is null").select("rep", F.col("id").alias("reached"), F.lit(True).alias("is_root"))
    f = f.join(ends, ["rep", "reached"], "left")
    return f.groupBy("rep").agg(
        F.count("*").alias("n"), count(F.col("next").isNull()).alias("n_roots"), count(F.col("next").isNotNull() & F.col("is_edge").isNull()).alias("bad_edges"),
        count((F.col("id") == F.col("root")) != F.col("next").isNull()).alias("bad_roots"), count(F.col("is_root").isNull() | (F.col("reached") != F.col("root"))).alias("unreached"),
    )


def apply_roots(forest: DataFrame, y: DataFrame) -> DataFrame:
    """(rep, id, k, y): the signal's value at each vertex' root."""
    return forest.select("rep", "id", "root").join(y.select(F.col("id").alias("root"), "k", "y"), "root").select("rep", "id", "k", "y")

"""Breadth-first search, and Euler tours of forests with subtrees that move to other trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.operators.forest import _followed
from sylvan.plans.ground import Rounds, Store


def bfs(edges: DataFrame, sources: DataFrame, both_ways: bool = False, deepest: int | None = None) -> DataFrame:
    """(rep, id, depth, parent) of all vertices that arrows (rep, src, dst) reach from ``sources`` (rep, id), level by
    level; the parent is the smallest vertex of the level before, null at the sources.

    Each level is one join of the last one with the arrows, and is appended to the result. If every arrow
    has its reverse (``both_ways``), what a level reaches was met in the last two levels or
    never, so only these are read again. ``deepest`` ends the search at that depth."""
    found, keep = Store("found"), Rounds("level")
    level = keep(sources.select("rep", "id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent")).distinct())
    depth = 0
    while level.limit(1).count() and (deepest is None or depth <= deepest):
        found.add(level)
        seen = found.read().where(F.col("depth") >= depth - 1) if both_ways else found.read()
        ahead = level.select("rep", F.col("id").alias("src")).join(edges.select("rep", "src", "dst"), ["rep", "src"])
        ahead = ahead.groupBy("rep", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        depth += 1
        level = keep(ahead.join(seen.select("rep", "id"), ["rep", "id"], "left_anti").select("rep", "id", F.lit(depth).cast("long").alias("depth"), "parent"))
    return found.read() if found else level


def bfs_graph(g, sources: DataFrame, deepest: int | None = None) -> DataFrame:
    """(id, depth, parent) in a graph from ``sources`` (id)."""
    one = F.lit(0).alias("rep")
    return bfs(g.edges.select(one, "src", "dst"), sources.select(one, "id"), True, deepest).drop("rep")


def bfs_parents(forest: DataFrame) -> DataFrame:
    """(rep, id, depth, parent) of the vertices of a forest (rep, id, next) that its roots reach against the arrows. As a vertex
    has one arrow, its depth is the length of its way, found by doubling: rounds are the logarithm of the
    deepest, and vertices of known depth are read but not joined again. Ways into cycles never end and are left out."""
    done = F.col("to").isNull()
    keep, left = Rounds("ways"), None
    way = keep(forest.select("rep", "id", F.col("next").alias("parent"), F.col("next").alias("to"), F.col("next").isNotNull().cast("long").alias("depth")))
    while True:
        open_, most = way.where(~done).agg(F.count("*"), F.max("depth")).first()
        # no way that ends is longer than all vertices, and ways double until they end
        if not open_ or (open_ == left and most > forest.count()):
            return way.where(done).select("rep", "id", "depth", "parent")
        on = way.select("rep", F.col("id").alias("to"), F.col("to").alias("further"), F.col("depth").alias("more"))
        step = way.where(~done).join(on, ["rep", "to"]).select("rep", "id", "parent", F.col("further").alias("to"), (F.col("depth") + F.col("more")).alias("depth"))
        way, left = keep(way.where(done).unionByName(step.select(*way.columns))), open_


def euler_tour(forest: DataFrame) -> DataFrame:
    """(rep, id, next, root, enter, leave, size, depth): where a walk around each tree, children by id, first
    and last stands at a vertex, the vertices below it (itself included), and the arrows to its root.

    A vertex is two positions of one list, which is ranked by doubling: each position knows the
    distance, and the change of depth, to the one it points at. The rounds are the logarithm of the
    largest tree whatever its depth, and a vertex lies below another if its positions lie between."""
    f = forest.select("rep", "id", "next", "root")
    by = Window.partitionBy("rep", "next").orderBy("id")
    kids = f.where("next is not null").select("rep", "id", "next", F.lead("id").over(by).alias("sibling"), (F.row_number().over(by) == 1).alias("eldest"))
    first = kids.where("eldest").select("rep", F.col("next").alias("id"), F.col("id").alias("child"))
    f = f.join(first, ["rep", "id"], "left").join(kids.select("rep", "id", "sibling"), ["rep", "id"], "left")
    enter = f.select("rep", "id", F.lit(False).alias("end"), F.coalesce("child", "id").alias("to"), F.col("child").isNull().alias("to_end"), F.lit(1).cast("long").alias("rise"))
    leave = f.select("rep", "id", F.lit(True).alias("end"), F.coalesce("sibling", "next").alias("to"), F.col("sibling").isNull().alias("to_end"), F.lit(-1).cast("long").alias("rise"))
    keep = Rounds("tour")
    way = keep(enter.unionByName(leave).withColumn("steps", F.col("to").isNotNull().cast("long")))
    while way.where("to is not null").limit(1).count():
        for _ in range(2):
            on = way.select("rep", F.col("id").alias("to"), F.col("end").alias("to_end"), F.col("to").alias("to2"), F.col("to_end").alias("to_end2"), F.col("steps").alias("steps2"), F.col("rise").alias("rise2"))
            step = way.where("to is not null").join(on, ["rep", "to", "to_end"])
            step = step.select("rep", "id", "end", F.col("to2").alias("to"), F.col("to_end2").alias("to_end"), (F.col("rise") + F.col("rise2")).alias("rise"), (F.col("steps") + F.col("steps2")).alias("steps"))
            way = way.where("to is null").unionByName(step)
        way = keep(way)
    # steps: positions after this one; rise: the sum of +1 and -1 from it to the end, in all 0
    at = way.groupBy("rep", "id").agg(F.max(F.when(~F.col("end"), F.col("steps"))).alias("e"), F.max(F.when(F.col("end"), F.col("steps"))).alias("l"), F.max(F.when(~F.col("end"), -F.col("rise"))).alias("depth"))
    whole = at.select("rep", F.col("id").alias("root"), F.col("e").alias("total"))
    out = forest.select("rep", "id", "next", "root").join(at, ["rep", "id"]).join(whole, ["rep", "root"])
    return out.select("rep", "id", "next", "root", (F.col("total") - F.col("e")).alias("enter"), (F.col("total") - F.col("l")).alias("leave"), ((F.col("e") - F.col("l") + 1) / 2).cast("long").alias("size"), "depth")


def move_subtrees(tour: DataFrame, moves: DataFrame) -> DataFrame:
    """(rep, id, next, root): the forest after each vertex of ``moves`` (rep, id, next) points at ``next`` with all that lies
    below it. A tree may have one move at most. Moves may go into subtrees that move themselves; the roots of
    those that lead each other in a circle are null, as they have none."""
    here = tour.select("rep", "id", "root", "enter", "leave")
    top = moves.select("rep", "id", F.col("next").alias("goal")).join(here, ["rep", "id"])
    goal = here.select("rep", F.col("id").alias("goal"), F.col("root").alias("goal_root"), F.col("enter").alias("goal_enter"))
    top = top.join(goal, ["rep", "goal"])
    own = top.select("rep", F.col("root").alias("goal_root"), F.col("id").alias("by"), F.col("enter").alias("by_enter"), F.col("leave").alias("by_leave"))
    top = top.join(own, ["rep", "goal_root"], "left")
    inside = (F.col("goal_enter") >= F.col("by_enter")) & (F.col("goal_enter") < F.col("by_leave")) & F.col("by").isNotNull()
    # a move that ends in a moving subtree follows that one's move
    keep = Rounds("moves")
    top = keep(top.withColumn("inside", F.coalesce(inside, F.lit(False))))
    far = _followed(top.select("rep", "id", F.when(F.col("inside"), F.col("by")).otherwise(F.col("id")).alias("to"), (~F.col("inside")).alias("done")), top.count())
    last = far.where("done").select("rep", "id", "to").join(top.select("rep", F.col("id").alias("to"), "goal_root"), ["rep", "to"]).select("rep", "id", F.col("goal_root").alias("new_root"))
    top = top.select("rep", "id", "goal", "root", F.col("enter").alias("from"), F.col("leave").alias("upto")).join(last, ["rep", "id"], "left").withColumnRenamed("id", "top")
    out = tour.join(top, ["rep", "root"], "left")
    below = F.coalesce(F.col("enter").between(F.col("from"), F.col("upto")), F.lit(False))
    moved = F.coalesce(F.col("id") == F.col("top"), F.lit(False))
    return out.select("rep", "id", F.when(moved, F.col("goal")).otherwise(F.col("next")).alias("next"), F.when(below, F.col("new_root")).otherwise(F.col("root")).alias("root"))

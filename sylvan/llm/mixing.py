"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words (`[^\\x20\\x09-\\x0D]+`). Sources in code-point order, null last, weigh
``weights`` in turn and share ``share`` of all words; a target stops at ``most`` times its
source's size and the excess is shared again by weight. Golden-ratio points, one a slot,
fall through the cumulative targets to sources; a source's slots are ranked, and its rank r
takes block r of the source's stream: its documents in a shuffled order, shuffled anew for
each further pass, cut into blocks of ``block`` words. ``schedule_mix`` gives that mix, the
pieces of documents by slot; ``mix`` adds them up by document.

Points of a source beyond its target's number of blocks stay unused, and the last block is
cut at the target; a source whose points fall short gets its last blocks in slots after those
of the points. So a source's words meet its target to the word, no document is taken more than
``most`` times, and up to every slot each source has its share but for a few blocks.

Orders come from md5 of doc_id and text, so reruns agree whatever the splits; rows that agree
in both are alike to them. Nothing is ordered in one task but the sources and the ``RANGES``
hash ranges of each: words before a document are the sum over the hash ranges before its own
plus a running sum inside it, and slots are ranked the same way by chunks. Repeated rows are
documents of their own, null or blank texts have size 0 and take 0, an empty table gives an
empty table, other input columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, materialize

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block; hexadecimal digits of a hash range, points of a chunk.
BLOCK, RANGES, CHUNK = 256, 3, 65536
#: Frac(i * PHI) is the i-th point; PHI_STEP is frac(STEP * PHI), which keeps all digits for large i.
PHI, STEP, PHI_STEP = 0.6180339887498949, 1 << 20, 0.607787409740351
#: Equal cells that carry the points to the sources' intervals.
CELLS = 4096


def word_count(c):
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, before, number, sources): one row a source, by water-filling in closed form."""
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.asc_nulls_last("source"))
    by_ratio = everything.orderBy("ratio", F.asc_nulls_last("source"))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    src = src.withColumns({"cap": (most * F.col("source_size")).cast("double"), "ratio": most * F.col("source_size") / F.col("w"), "want": share * F.sum("source_size").over(everything)})
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("want") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", level)
    # these levels rise while sources are capped and fall behind the last capped one, so the largest is the water's
    src = src.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("w")))
    src = src.withColumn("before", F.coalesce(F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return src.select("source", "source_size", "target", "before", F.row_number().over(by_name).cast("long").alias("number"), F.count("*").over(everything).alias("sources"))


def _stream(sizes: DataFrame, turn: int) -> DataFrame:
    """``sizes`` with ``off``: the words of its source before each document in this pass' order."""
    at = F.md5(F.concat(F.lit(f"{turn}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), "digest"))
    keyed = sizes.withColumns({"at": at, "range": F.substring(at, 1, RANGES)})
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("n"))
    first = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("at", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return keyed.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).select("rid", "source", "size", (F.col("base") + F.col("run")).alias("off"))


def schedule(src: DataFrame, words: float, block: int) -> DataFrame:
    """(source, rank, slot): each source's ranks up to its target, in the slots of its points."""
    spark, n = src.sparkSession, int(-(-words // block))
    ends = src.where("target > 0").select("source", (F.col("before") / words).alias("lo"), ((F.col("before") + F.col("target")) / words).alias("hi"), F.ceil(F.floor("target") / block).alias("need"), "number", "sources")
    cells = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))))
    x = F.col("id") % STEP * F.lit(PHI) + F.floor(F.col("id") / STEP) * F.lit(PHI_STEP)
    points = spark.range(n).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(cells, "cell").where("u >= lo and u < hi").select("source", "need", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = hit.groupBy("source", "need", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    hit = hit.withColumn("run", F.row_number().over(inside) - 1)
    ranked = hit.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select("source", (F.col("base") + F.col("run")).alias("rank"), "slot", "need").where("rank < need").drop("need")
    got = counts.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("got"))
    short = ends.join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    late = short.withColumn("rank", F.explode(F.expr("sequence(got, need - 1)")))
    return ranked.union(late.select("source", "rank", n + (F.col("rank") - F.col("got")) * F.col("sources") + F.col("number") - 1))


def _key(source):
    """A join key that tells null from every source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("k")


def _sizes(docs: DataFrame, text: str) -> DataFrame:
    return materialize(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"), F.monotonically_increasing_id().alias("rid")), "sizes")


def _pieces(sizes: DataFrame, src: DataFrame, most: int, block: int) -> DataFrame:
    """(slot, source, rank, rid, turn, start, n): ``n`` words of document ``rid`` from word ``start`` on."""
    words = src.agg(F.sum("target")).first()[0] or 0.0
    limits = src.select(F.col("source").alias("s"), "source_size", "target")
    turns = None
    for turn in range(most):
        at = F.col("off") + turn * F.col("source_size")
        part = _stream(sizes.where("size > 0"), turn).join(limits, F.col("source").eqNullSafe(F.col("s")))
        part = part.select("rid", "source", F.lit(turn).alias("turn"), at.alias("lo"), F.least(at + F.col("size"), F.floor("target")).alias("hi")).where("lo < hi")
        turns = part if turns is None else turns.union(part)
    pieces = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    first = F.greatest("lo", F.col("rank") * block)
    pieces = pieces.select("rid", _key("source"), "source", "rank", "turn", (first - F.col("lo")).alias("start"), (F.least("hi", (F.col("rank") + 1) * block) - first).alias("n"))
    slots = schedule(src, words, block).select(_key("source"), "rank", "slot")
    return pieces.join(slots, ["k", "rank"]).select("slot", "source", "rank", "rid", "turn", "start", "n")


def schedule_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, text: str = "text") -> DataFrame:
    """The mix itself: slot, source, rank (of the block in its source), doc_id, turn (pass), start and n
    (words of the document). Ordered by slot, rank and place it is the training stream."""
    sizes = _sizes(docs, text)
    src = materialize(source_targets(sizes, weights, share, most), "sources")
    return _pieces(sizes, src, most, block).join(sizes.select("rid", "doc_id"), "rid").drop("rid")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_pieces and first_slot (the pieces of the
    document in the mix, and the first slot that holds one, null without) for each document."""
    sizes = _sizes(docs, text)
    src = materialize(source_targets(sizes, weights, share, most), "sources")
    taken = _pieces(sizes, src, most, block).groupBy("rid").agg(F.sum("n").alias("taken"), F.count("*").alias("n_pieces"), F.min("slot").alias("first_slot"))
    limits = src.select(F.col("source").alias("s"), "source_size", "target")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        sizes.join(taken, "rid", "left")
        .join(limits, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", none("taken"), none("n_pieces"), "first_slot")
    )

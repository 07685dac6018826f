"""Line deduplication with DataFrame functions alone.

Every row is one document. A document's lines are its text cut at line feeds; a null or
empty text is one empty line. A line's key is the line without ASCII white space at both
ends and with A-Z lower-cased. Keys of at least ``min_chars`` code points that occur in at
least ``min_docs`` documents lose all their lines everywhere; the other lines keep their
order. An empty table gives an empty table; rows that repeat count as documents of their own;
columns of the result that the input also has are replaced, all others are carried along.

Counting is a partial aggregation over 128-bit hashes, one row per hash and task, so a line
in a third of all documents is no large group. The keys over the threshold are written to
the shared folder; the exploded hashes then join them (a broadcast when few, otherwise a
shuffle join through ``lookup``), and only positions travel: a text is moved once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hash_pair, lookup, lower_ascii, materialize

MIN_DOCS, MIN_CHARS = 10, 1
ADDED = ("n_lines", "n_dropped")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and n_lines (before dropping) and n_dropped."""
    docs = docs.drop(*ADDED)
    ident = [c for c in docs.columns if c == "doc_id"]
    key = F.xxhash64(F.coalesce(text, F.lit(""))), F.xxhash64(F.lit(0x5EED), F.coalesce(text, F.lit("")), *ident)
    own = docs.withColumns({"__t1": key[0], "__t2": key[1], "__lines": F.split(F.coalesce(text, F.lit("")), "\n", -1)})
    lines = F.transform("__lines", lambda x: lower_ascii(F.btrim(x, F.lit(SPACES))))
    keys = F.transform(lines, lambda x: F.struct(*(h.alias(f"h{i}") for i, h in enumerate(hash_pair(x), 1)), (F.length(x) >= min_chars).alias("long")))
    hashed = materialize(own.select("__t1", "__t2", keys.alias("k")), "hashes")
    counts = hashed.select(F.explode(F.array_distinct("k")).alias("k")).where("k.long").groupBy("k.h1", "k.h2").agg(F.count("*").alias("n"))
    frequent = materialize(counts.where(F.col("n") >= min_docs), "lines")
    total = frequent.agg(F.sum("n")).first()[0] or 0
    each = hashed.select("__t1", "__t2", F.posexplode("k").alias("pos", "k")).where("k.long").select("__t1", "__t2", "pos", "k.h1", "k.h2")
    found = lookup(each, frequent, ["h1", "h2"], "n", total, ["__t1", "__t2", "pos"], how="inner")
    drop = found.groupBy("__t1", "__t2").agg(F.collect_set("pos").alias("__drop"))
    n = F.size("__lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return (
        own.drop("__lines")
        .join(drop, ["__t1", "__t2"], "left")
        .withColumn("__lines", F.split(F.coalesce(text, F.lit("")), "\n", -1))
        .withColumns({"n_lines": n.cast("long"), "n_dropped": F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long"), text: kept})
        .drop("__t1", "__t2", "__lines", "__drop")
        .select(*docs.columns, *ADDED)
    )

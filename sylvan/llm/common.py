"""What the operators of this subpackage share: shared storage, components, blocks of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.skew import lookup
from sylvan.plans.ground import Rounds

#: ASCII white space `[\x20\x09-\x0D]`, and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from files
    that outlive any executor, and do not compute ``df`` again."""
    return Rounds(label, compression="zstd", **options)(df)


#: What lower() changes besides A-Z.
_OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does just that where no other capitals
    occur, far faster than translate(), which is left for the rest."""
    return F.when(c.rlike(_OTHER_CAPITALS), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def hash_pair(c: Column) -> tuple[Column, Column]:
    """128 bits in two longs with independent seeds."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)


def connected_components(edges: DataFrame, label: str, max_rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id that links ``edges`` (a, b) reach from each id they name.

    Large-star and small-star rounds (Kiveris et al., 2014). Each half round is written to the
    shared folder, where it replaces the one before; only two totals a round come to the
    driver. A hub is one row of the per-node minima, joined back by ``lookup``, so its edges stay
    spread out.
    """

    def star(sym: DataFrame, n: int, large: bool) -> DataFrame:
        # large: all neighbours of u; small: u's smaller neighbours and u itself
        mins = sym.groupBy("u").agg(F.min("v").alias("lo"), F.count("*").alias("n")).withColumn("lo", F.least("u", "lo"))
        out = lookup(sym, mins, ["u"], "n", n, ["u", "v"])
        out = out.where(F.col("v") > F.col("u")) if large else out
        return out.select(F.col("v").alias("a"), F.col("lo").alias("b")).where("a <> b")

    def total(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count("*").alias("n"), F.sum((F.xxhash64("a", "b") % 2**31).cast("long")).alias("h")).first()
        return row["n"], row["h"] or 0

    keep = Rounds(label, compression="zstd")
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = total(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        sym = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        big = keep(star(sym, 2 * seen[0], True).distinct())
        down = big.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        mins = down.groupBy("u").agg(F.min("v").alias("lo"), F.count("*").alias("n"))
        kept = lookup(down, mins, ["u"], "n", seen[0], ["u", "v"])
        now = keep(kept.select(F.col("v").alias("a"), F.col("lo").alias("b")).union(mins.select(F.col("u").alias("a"), F.col("lo").alias("b"))).where("a <> b").distinct())
        was, seen = seen, total(now)
        if was == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def bucket_blocks(members: DataFrame, label: str, block: int, row_id: str = "id", weight: str | None = None, heaviest: int = 0) -> DataFrame:
    """Pairs of blocks that together compare all rows of each (table, key) bucket.

    Buckets of one row go. A bucket of n rows is cut by a hash of ``row_id`` into
    ceil(n / block) blocks, or more if the column ``weight`` would come to more than ``heaviest``
    in one, and every row is sent once to each pair of blocks (bi <= bj) that holds its own
    block ``b``: no task ever gets more than about two blocks of a bucket, and every pair of
    rows meets in exactly one pair of blocks.
    """
    load = F.sum(weight) if weight else F.lit(0)
    counts = materialize(members.groupBy("table", "key").agg(F.count("*").alias("n_rows"), load.alias("__load")).where("n_rows > 1"), label)
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    found = lookup(members, counts, ["table", "key"], "n_rows", total, [row_id, "table"], how="inner")
    blocks = F.ceil(F.col("n_rows") / block)
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.col("__load") / heaviest))
    found = found.withColumn("b", F.pmod(F.xxhash64(row_id, F.lit(17)), blocks).cast("int"))
    found = found.withColumn("__o", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return found.withColumns({"bi": F.least("b", "__o"), "bj": F.greatest("b", "__o")}).drop("__o", "n_rows", "__load")


def sample_by_content(rows: DataFrame, most: int, by: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """About ``most`` rows (columns ``by`` and ``text``) of each value of ``by``, or all if there are fewer.

    Which ones is a function of the rows and not of files or partitions: of n rows equal in
    ``by`` and ``text``, floor(n * share + u) are taken, u in [0, 1) being a hash of the content. Only
    hashes are grouped, so texts do not travel but for the sampled ones; equal rows add up before
    they do. What is broadcast is bounded by ``most`` a value.
    """
    scale = 1 << 30
    marks = dict(zip(("__h1", "__h2"), hash_pair(F.concat_ws("\0", *by, text))))
    marked = rows.select(*by, text).withColumns(marks)
    equal = marked.groupBy(*by, "__h1", "__h2").agg(F.count("*").alias("__n"))
    if by:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("__all"))
        equal = equal.join(F.broadcast(sizes), list(by))
    else:
        equal = equal.withColumn("__all", F.lit(rows.count()))
    share = F.least(F.lit(1.0), most / F.greatest(F.col("__all"), F.lit(1)))
    draw = F.pmod(F.xxhash64("__h1", "__h2"), F.lit(scale)) / scale
    taken = equal.select(*by, "__h1", "__h2", F.floor(F.col("__n") * share + draw).cast("int").alias("__times")).where("__times > 0")
    found = marked.join(F.broadcast(taken), [*by, "__h1", "__h2"])
    once = found.groupBy(*by, "__h1", "__h2").agg(F.first(text).alias(text), F.first("__times").alias("__times"))
    return once.select(*by, text, F.explode(F.array_repeat(F.lit(1), F.col("__times"))).alias("__k")).drop("__k")


def groups_of(*columns):
    """Start and end of each run of equal rows, and the order that makes the runs."""
    import numpy as np

    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return order, starts, np.append(starts[1:], len(order))


def local_labels(n: int, i, j):
    """For n rows with links (i, j): the smallest row number that each row reaches."""
    import numpy as np

    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if np.array_equal(was, label):
            return label


def map_text(docs: DataFrame, text: str, keep: list[str], fields, start) -> DataFrame:
    """The columns ``keep`` of ``docs`` and new ``fields`` (a StructType) made from ``text``, Arrow
    batch by batch. ``start()`` runs once a task and returns the function from one text (str or
    None) to one tuple. Columns of other names do not leave the JVM."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = list(to_arrow_schema(fields))

    def run(batches):
        each = start()
        for batch in batches:
            out = [each(t.as_py()) for t in batch.column(text)]
            made = [pa.array([o[k] for o in out], type=f.type) for k, f in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *(f.name for f in new)])

    docs = docs.select(*dict.fromkeys([*keep, text]))
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *fields.fields]))

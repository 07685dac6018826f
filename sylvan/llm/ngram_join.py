"""N-gram Jaccard self-join through a MinHash LSH forest, with exact verification.

Words are those of ``decontaminate.words_of``; a document's set holds its shingles of
``width`` consecutive words (one shingle of all words if there are fewer, none without
words). Documents of equal sets form one class, known by a 128-bit digest; only classes
are joined, so copies cost nothing and are never expanded into pairs.

The forest has ``TREES`` tries; in each, a class stands under its label of minima, and a node is
what shares a prefix. Two classes are candidates where they meet in a node. Let ``base`` be the
longest prefix that finds a pair at exactly ``threshold`` with probability ``recall`` if all
trees take it. A class starts one minimum longer, which finds too few such pairs, and shortens to ``base`` the
trees in which it has least company, as many as the recall takes, and then all trees
with at most one class more. That one more is the partner looked for: whether it is there must not decide
which trees are shortened, or those in which it is would stay long and lose it (a tree in
which a class is alone is no proof of a search that would have found it). So the trees shortened include
those chosen without the partner, and the pair is found with ``recall`` whatever the others are. A node is cut at
the shortest prefix that one of its classes asks for, so both classes of a pair see the same nodes.

Buckets are compared in pairs of blocks (``bucket_blocks``), first with one byte a minimum:
a pair goes on if it has not met in an earlier tree, its sizes allow the threshold, and
its bytes agree no less than SLACK standard deviations below it. Only rows with such a pair
take their text to the second comparison, where intersections are counted exactly on 64-bit
shingle hashes. A task returns one row per class and block: rows linked and one edge of
the block's spanning stars. Components come from those edges.

Null, empty and word-free texts link with nothing. Every row is a document; rows that share a
doc_id each count, and so do rows without one: texts are fetched by doc_id and two hashes of
the text, once a class. A class is named by its smallest doc_id, null if none of its documents has one.
An empty table gives an empty table. Other input columns are not carried along by
``near_duplicates``; ``keep_one`` returns all of them.
"""

from __future__ import annotations

from math import log1p, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_blocks, connected_components, groups_of, local_labels, lookup, map_text, materialize
from .decontaminate import words_of

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9995
TREES, DEPTH = 24, 6
#: Rows and shingles of a block; rows of a first-comparison task; shingles of a second one; standard deviations.
BLOCK, HEAVIEST, SHARD_ROWS, SHARD_SHINGLES, SLACK = 1024, 1_000_000, 20_000, 1_500_000, 5.0
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s = s * _STEP + h[k : len(h) - n + 1 + k]
        s ^= s >> np.uint64(29)
    s ^= s >> np.uint64(30)
    s *= _MIX1
    s ^= s >> np.uint64(27)
    s *= _MIX2
    return np.unique(s ^ (s >> np.uint64(31)))


def _params(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2014)
    draw = lambda: rng.integers(0, 2**32, size=(n, 1), dtype=np.uint32)
    return draw() | np.uint32(1), draw()


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each of len(a) hash functions, 32 bits."""
    low, x = np.full(len(a), np.iinfo(np.uint32).max, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 256):  # a bounded piece of a long document at a time
        np.minimum(low, (x[None, at : at + 256] * a + b).min(axis=1), out=low)
    return low


def depth_for(threshold: float, recall: float, trees: int = 0, depth: int = 0) -> int:
    """The longest prefix at which all trees together find a pair at ``threshold`` with probability ``recall``."""
    trees, depth = trees or TREES, depth or DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def prefix_keys(sigs: np.ndarray, depth: int) -> np.ndarray:
    """64-bit key of each tree's prefix, one row a signature."""
    parts = sigs.reshape(len(sigs), TREES, DEPTH)[:, :, :depth].astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(depth):
        key = (key ^ parts[:, :, k]) * _MIX1
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def wanted_depths(sizes: list[int], threshold: float, recall: float, base: int) -> list[int]:
    """The prefix length that a class asks for in each of the trees where it has company, given the
    numbers of classes under its prefixes of length ``base`` there; elsewhere it is alone."""
    miss = [log1p(-min(threshold**d, 1 - 1e-12)) for d in (base, min(base + 1, DEPTH))]
    short = next((m for m in range(TREES) if m * miss[0] + (TREES - m) * miss[1] <= log1p(-recall)), TREES)
    if not short:
        return [min(base + 1, DEPTH)] * len(sizes)
    most = sorted([*sizes, *[1] * (TREES - len(sizes))])[short - 1] + 1  # one more: the partner itself
    return [base if n <= most else min(base + 1, DEPTH) for n in sizes]


def first_comparison(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows that have a pair to verify."""
    sig = np.frombuffer(b"".join(pdf["bytes"]), np.uint8).reshape(len(pdf), -1)
    keys = np.frombuffer(b"".join(pdf["keys"]), np.int64).reshape(len(pdf), -1)
    table, b, bi, bj, n = (pdf[c].to_numpy() for c in ("table", "b", "bi", "bj", "n_sh"))
    p = threshold + (1 - threshold) / 256
    least = (p - SLACK * sqrt(p * (1 - p) / sig.shape[1])) * sig.shape[1]
    order, starts, ends = groups_of(table, pdf["key"].to_numpy(), bi, bj)
    want = np.zeros(len(pdf), bool)
    for s, e in zip(starts, ends):
        rows, t = order[s:e], table[order[s]]
        one = bi[rows[0]] == bj[rows[0]]
        left = rows if one else rows[b[rows] == bi[rows[0]]]
        right = rows if one else rows[b[rows] == bj[rows[0]]]
        for k, x in enumerate(left):
            ys = right[k + 1 :] if one else right
            ys = ys[(np.minimum(n[ys], n[x]) >= threshold * np.maximum(n[ys], n[x]))]
            ys = ys[(sig[ys] == sig[x]).sum(axis=1) >= least]
            if t and len(ys):
                ys = ys[~(keys[ys, :t] == keys[x, :t]).any(axis=1)]
            if len(ys):
                want[x] = True
                want[ys] = True
    return pdf.loc[want, ["table", "key", "bi", "bj", "b", "id", "keys", "n_sh"]]


def _intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections, by products of bounded pieces of the incidence matrix."""
    sets = left + (right or [])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total, piece, m = np.zeros((len(left), len(right) if right else len(left)), np.float64), max(256, 4_000_000 // len(sets)), len(left)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, piece):
        lo, hi = np.searchsorted(col, [c, c + piece])
        mat = np.zeros((len(sets), piece), np.float32)
        mat[row[lo:hi], col[lo:hi] - c] = 1
        total += mat[:m] @ (mat[m:] if right else mat).T
    return total


def second_comparison(pdf: pd.DataFrame, threshold: float, width: int) -> pd.DataFrame:
    """(id, links, label): exact links of the classes in these block pairs."""
    made: dict[int, np.ndarray] = {}
    for i, text in zip(pdf["id"], pdf["text"]):
        if i not in made:
            s = shingles(text, width)
            if xxhash.xxh3_64_intdigest(s.tobytes(), 1) == i % 2**64:
                made[i] = s
    pdf = pdf[pdf["id"].isin(made.keys())].drop_duplicates(["table", "key", "bi", "bj", "id"]).reset_index(drop=True)
    if not len(pdf):
        return pd.DataFrame({"id": [], "links": [], "label": []})
    keys = np.frombuffer(b"".join(pdf["keys"]), np.int64).reshape(len(pdf), -1)
    table, b, bi, bj, n, ids = (pdf[c].to_numpy() for c in ("table", "b", "bi", "bj", "n", "id"))
    order, starts, ends = groups_of(table, pdf["key"].to_numpy(), bi, bj)
    out = []
    for s, e in zip(starts, ends):
        rows, t = order[s:e], table[order[s]]
        one = bi[rows[0]] == bj[rows[0]]
        left = rows if one else rows[b[rows] == bi[rows[0]]]
        right = rows if one else rows[b[rows] == bj[rows[0]]]
        if not len(left) or not len(right) or one and len(left) < 2:
            continue
        sa, sb = [made[ids[x]] for x in left], [made[ids[x]] for x in right]
        both = _intersections(sa, None if one else sb)
        na, nb = np.array([len(x) for x in sa], float)[:, None], np.array([len(x) for x in sb], float)[None, :]
        jac = both / (na + nb - both)
        i, j = np.nonzero(jac >= threshold - 1e-12)
        if one:
            i, j = i[i < j], j[i < j]
        i, j = left[i], right[j]
        fresh = np.argmax(keys[i] == keys[j], axis=1) == t
        i, j = i[fresh], j[fresh]
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
    return pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "label": []})


_SIGNED = T.StructType([T.StructField("id", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("n_sh", T.LongType()), T.StructField("sig", T.BinaryType())])


def _signing(width: int):
    a, b = _params(TREES * DEPTH)

    def one(text):
        s = shingles(text, width)
        if not len(s):
            return None, None, 0, None
        raw = s.tobytes()
        ints = [x - 2**64 if x >= 2**63 else x for x in (xxhash.xxh3_64_intdigest(raw, 1), xxhash.xxh3_64_intdigest(raw, 2))]
        return *ints, len(s), signature(s, a, b).tobytes()

    return one


def _hashes(text: str):
    """Two hashes of the text, by which it is found again."""
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(0x5EED), text)}


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs``: doc_id, the columns ``keep``, class_id (the smallest doc_id that links reach, itself included),
    copy_id (the smallest with the same shingles), n_links (other documents at or above the
    threshold) and kept (doc_id = class_id)."""
    return _groups(docs, threshold, recall, width, text, keep).drop("__group").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``docs`` without the documents that are not the first of their class; columns unchanged.
    Rows are told apart by a number written with them: of rows with the same doc_id those of
    the same class stay or go together, a row without doc_id goes if its class has one, and of a
    class without any the first row stays."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = materialize(_groups(rows, threshold, recall, width, text, ("__row",)).select("__row", "doc_id", "class_id", "__group"), "groups")
    nameless = found.where("class_id is null and __group is not null")
    first = nameless.groupBy("__group").agg(F.min("__row").alias("__row")).select("__row")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("__row").union(nameless.select("__row").join(first, "__row", "left_anti"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def _groups(docs: DataFrame, threshold: float, recall: float, width: int, text: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, ``keep``, class_id, copy_id, n_links and __group, which is the class and null without words."""
    docs = docs.select("doc_id", *keep, F.col(text).alias("text"))
    signed = map_text(docs.withColumns(_hashes("text")), "text", ["doc_id", *keep, "h1", "h2"], _SIGNED, lambda: _signing(width))
    signed = materialize(signed, "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h1", "h2")).alias("first")
    classes = signed.where("n_sh > 0").groupBy("id", "d2").agg(first, F.count("*").alias("n"), F.first("n_sh").alias("n_sh"), F.first("sig").alias("sig"))
    classes = materialize(classes.select("id", "d2", F.col("first.doc_id").alias("rep"), "first.h1", "first.h2", "n", "n_sh", "sig"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    found = _links(docs, classes, threshold, recall, width)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    near = connected_components(found.select(F.col("id").alias("a"), F.col("label").alias("b")), "stars")
    named = near.join(classes.select("id", "rep"), "id")
    lowest = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("m"))
    named = lookup(named, lowest, ["component"], "m", total, ["id"], how="inner").select("id", "class_id", "component")
    result = classes.select("id", "d2", "rep", "n").join(links, "id", "left").join(named, "id", "left")
    result = result.select(
        "id", "d2", "n", F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("component", "id").alias("__group")
    )
    per_doc = lookup(signed.select("doc_id", *keep, "id", "d2"), result, ["id", "d2"], "n", total, ["doc_id", *keep])
    return per_doc.select(
        "doc_id", *keep, F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "__group"
    )


def _forest(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """id, n, n_sh, rep, h1, h2, bytes (of the signature), keys (of each tree's node, the class' own id
    where it is alone) and tables (the trees where it is not)."""
    base = depth_for(threshold, recall)

    @F.pandas_udf("array<bigint>")
    def shortest(sig: pd.Series) -> pd.Series:
        return pd.Series(list(prefix_keys(np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), -1), base)))

    @F.pandas_udf("array<int>")
    def asked(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda x: wanted_depths(list(x), threshold, recall, base))

    @F.pandas_udf("binary")
    def cut(ids: pd.Series, sig: pd.Series, tables: pd.Series, depths: pd.Series) -> pd.Series:
        sigs = np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), -1)
        every = np.stack([prefix_keys(sigs, d) for d in range(base, DEPTH + 1)])
        out = np.repeat(ids.to_numpy(np.int64)[:, None], TREES, axis=1)
        for k, (t, d) in enumerate(zip(tables, depths)):
            out[k, t] = every[np.asarray(d) - base, k, t]
        return pd.Series([x.tobytes() for x in out])

    @F.pandas_udf("binary")
    def low_bytes(sig: pd.Series) -> pd.Series:
        return sig.map(lambda x: np.frombuffer(x, np.uint32).astype(np.uint8).tobytes())

    members = materialize(classes.select("id", F.posexplode(shortest("sig")).alias("table", "key")), "members")
    sizes = materialize(members.groupBy("table", "key").agg(F.count("*").alias("n_rows")).where("n_rows > 1"), "sizes")
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    met = lookup(members, sizes, ["table", "key"], "n_rows", total, ["id", "table"], how="inner")
    nodes = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("table", "key", "n_rows"))).alias("nodes"))
    nodes = materialize(nodes.withColumn("asks", asked("nodes.n_rows")), "asks")
    each = nodes.select("id", F.explode(F.arrays_zip("nodes", "asks")).alias("x")).select("id", "x.nodes.table", "x.nodes.key", F.col("x.asks").alias("ask"))
    depths = each.groupBy("table", "key").agg(F.min("ask").alias("depth"), F.count("*").alias("n_rows"))
    deep = lookup(each.select("id", "table", "key"), depths, ["table", "key"], "n_rows", total, ["id", "table"], how="inner")
    deep = deep.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("table", "depth"))).alias("x"))
    made = deep.join(classes, "id").withColumns({"keys": cut("id", "sig", "x.table", "x.depth"), "bytes": low_bytes("sig"), "tables": F.col("x.table")})
    return materialize(made.select("id", "n", "n_sh", "rep", "h1", "h2", "bytes", "keys", "tables"), "forest")


def _links(docs: DataFrame, classes: DataFrame, threshold: float, recall: float, width: int) -> DataFrame:
    """(id, links, label) rows of every block with links."""

    @F.pandas_udf("array<bigint>")
    def unpacked(keys: pd.Series) -> pd.Series:
        return pd.Series(list(np.frombuffer(b"".join(keys), np.int64).reshape(len(keys), -1)))

    made = _forest(classes, threshold, recall)
    members = made.select("id", "n_sh", "tables", unpacked("keys").alias("k")).select("id", "n_sh", F.explode("tables").alias("table"), "k")
    members = members.select("id", "n_sh", "table", F.get("k", F.col("table")).alias("key"))
    rows = materialize(bucket_blocks(members, "buckets", BLOCK, weight="n_sh", heaviest=HEAVIEST).drop("n_sh"), "blocks")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("table", "key", "bi", "bj"), F.lit(shards))
    work = rows.join(made.select("id", "n_sh", "keys", "bytes"), "id").withColumn("shard", shard)
    want = materialize(work.groupBy("shard").applyInPandas(lambda pdf: first_comparison(pdf, threshold), "table int, key long, bi int, bj int, b int, id long, keys binary, n_sh long"), "wanted")
    load = want.agg(F.sum("n_sh")).first()[0] or 0
    shards2 = max(1, -(-load // SHARD_SHINGLES))
    reps = want.select("id").distinct().join(made, "id").select("id", "n", "h1", "h2", F.coalesce("rep", F.lit(0)).alias("r"))
    found = docs.select(F.coalesce("doc_id", F.lit(0)).alias("r"), "text").withColumns(_hashes("text")).join(reps, ["r", "h1", "h2"])
    texts = found.groupBy("id", "n").agg(F.first("text").alias("text"))  # rows may repeat
    work = want.drop("n_sh").join(texts, "id").withColumn("shard", F.pmod(F.xxhash64("table", "key", "bi", "bj"), F.lit(shards2)))
    return materialize(work.groupBy("shard").applyInPandas(lambda pdf: second_comparison(pdf, threshold, width), "id long, links long, label long"), "links")

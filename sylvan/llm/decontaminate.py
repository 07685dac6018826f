"""Benchmark decontamination by an Aho-Corasick automaton.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased: runs of 0-9, a-z
and code points from 0x80. The words of the benchmark are numbered, and a number is
written as two characters, so that no state has many followers to search. The automaton reads
these characters: its patterns are the windows of ``window`` words of every item (an item of
fewer words is one window), and a text becomes the numbers of its words, with a character of
its own for words that no item has. One pass finds all occurrences, overlapping ones too; word numbers
lead to code points of the original text for ``spans``.

An automaton goes to the executors with the task, so it is bounded: items are cut into pieces
of ``PIECE`` windows, and pieces are dealt by hash into as many shards as it takes to have
about ``NODES`` states in each (some 70 bytes a state). One shard is the usual case. With more
there is one pass over the documents for each, shard after shard, and the word ranges are
united by a row number that is written with the documents; the result is the same for any
number of shards, and the driver holds one shard at a time.

Null, empty and word-free texts or items have no words and no hits; items without item_id hit
like others and count as one item together, a null at the end of ``items``; repeated rows are
judged each for itself; an empty benchmark leaves every document clean. Input columns are
carried along, same-named ones replaced.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from itertools import repeat
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

WINDOW = 10
#: States of one automaton; windows of a piece of an item; passes whose hits are stored together.
NODES, PIECE, PASSES = 2_000_000, 2_000, 8
ADDED = ("n_words", "n_hit", "items", "n_items", "items_sha256", "contaminated", "spans")
#: Bytes as they are compared: separators become spaces, A-Z become a-z.
FOLD = bytes(x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else x + 32 if 65 <= x <= 90 else 32 for x in range(256))
_SEPARATOR = np.frombuffer(FOLD, np.uint8) == 32


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def windows_of(words: list[bytes], n: int) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@functools.lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[str | None, str], ...], n: int):
    """(characters of words, automaton) over the windows, each with its length and items; once a worker and shard."""
    import ahocorasick

    owners = defaultdict(set)
    for item, text in items:
        for w in windows_of(words_of(text), n):
            owners[w].add(item)
    words = sorted({x for w in owners for x in w})
    base = isqrt(len(words)) + 1
    code = {w: chr(1 + k // base) + chr(1 + base + k % base) for k, w in enumerate(words)}
    made = ahocorasick.Automaton()
    shared: dict[tuple, tuple] = {}  # windows of one item share one value
    for w, who in owners.items():
        made.add_word("".join([code[x] for x in w]), shared.setdefault((len(w), frozenset(who)), (len(w), tuple(who))))
    if owners:
        made.make_automaton()
    return (code, made) if owners else None


def scan(text: str | None, made) -> tuple[int, list[list[int]], set[str | None]]:
    """Number of words, united hit ranges [first word, last word + 1) and the items hit."""
    words = words_of(text)
    if not words or made is None:
        return len(words), [], set()
    code, automaton = made
    ranges: list[list[int]] = []
    items: set[str | None] = set()
    for end, (n, who) in automaton.iter("".join(map(code.get, words, repeat("\0\0")))):
        items.update(who)
        end //= 2
        a = end - n + 1
        while ranges and a <= ranges[-1][1]:  # ends only grow; a longer window may reach behind several ranges
            a = min(a, ranges.pop()[0])
        ranges.append([a, end + 1])
    return len(words), ranges, items


def united(ranges) -> list[list[int]]:
    """Ranges (first word, last word + 1, and their code points) in any order as those that neither overlap nor touch."""
    if not len(ranges):
        return []
    r = np.stack(ranges)
    r = r[np.argsort(r[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    first = np.flatnonzero(np.append(True, r[1:, 0] > reach[:-1]))
    last = np.append(first[1:], len(r)) - 1
    return np.stack([r[first, 0], reach[last], r[first, 2], np.maximum.accumulate(r[:, 3])[last]], axis=1).tolist()


def char_spans(text: str, ranges: list[list[int]]) -> list[list[int]]:
    """Word ranges as code-point offsets [start, end) of the original text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(np.concatenate(([1], _SEPARATOR[raw].astype(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [[int(points[starts[a]]), int(points[ends[b - 1]])] for a, b in ranges]


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, text, nodes): items cut into pieces that together have the same windows."""

    def cut(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for i in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
                    part = words[i : i + PIECE + window - 1]
                    out.append((item, b" ".join(part).decode("utf-8", "surrogatepass"), 2 * len(part) * window))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], type=t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["item", "text", "nodes"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "item string, text string, nodes long")


def _shards(benchmark: DataFrame, window: int, nodes: int) -> list[DataFrame]:
    """(item, text) of each shard."""
    pieces = materialize(_pieces(benchmark, window), "pieces")
    n = max(1, -(-(pieces.agg(F.sum("nodes")).first()[0] or 0) // nodes))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return [pieces.where(F.col("shard") == k).select("item", "text") for k in range(n)]


#: Number of words, hit ranges (first word, last word + 1, and their code points or zeros), items.
_FOUND = T.StructType([T.StructField("__n", T.LongType()), T.StructField("__r", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("__i", T.ArrayType(T.StringType()))])


def _scanned(docs: DataFrame, keep: list[str], shard: DataFrame, n: int, text: str, spans: bool) -> DataFrame:
    """The columns ``keep`` with what the automaton of one shard finds in ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple((r["item"], r["text"]) for r in shard.collect()))
    kinds = (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()))

    def run(batches):
        made = _automaton(shared.value, n)
        for batch in batches:
            out = []
            for t in batch.column(text):
                n_words, ranges, who = scan(t := t.as_py(), made)
                points = char_spans(t, ranges) if spans and ranges else [[0, 0]] * len(ranges)
                out.append((n_words, [r + c for r, c in zip(ranges, points)], sorted(who, key=lambda i: (i is None, i or ""))))
            new = [pa.array([o[k] for o in out], type=kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *_FOUND.names])

    docs = docs.select(*dict.fromkeys([*keep, text]))
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *_FOUND.fields]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", nodes: int = NODES, spans: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with n_words, n_hit, items (ids), n_items,
    items_sha256, contaminated, and spans: the hit stretches of ``text`` in code points."""
    kept = [c for c in (keep or docs.columns) if c not in ADDED]
    shards = _shards(benchmark, window, nodes)
    if len(shards) == 1:
        found = _scanned(docs, kept, shards[0], window, text, spans)
    else:
        rows = materialize(docs.select(*dict.fromkeys([*kept, text])).withColumn("__row", F.monotonically_increasing_id()), "rows")
        stored, some = [], []
        for k, shard in enumerate(shards):
            part = _scanned(rows, ["__row"], shard, window, text, spans)
            some.append(part if k == 0 else part.where("size(__r) > 0"))  # the first also has the words of clean rows
            if len(some) == PASSES or k == len(shards) - 1:
                stored.append(materialize(functools.reduce(DataFrame.union, some), "hits"))
                some = []
        every = functools.reduce(DataFrame.union, stored)
        union = every.groupBy("__row").agg(F.max("__n").alias("__n"), F.flatten(F.collect_list("__r")).alias("__r"), F.array_distinct(F.flatten(F.collect_list("__i"))).alias("__i"))
        union = union.withColumn("__r", F.pandas_udf(lambda r: r.map(united), "array<array<bigint>>")("__r"))
        found = rows.select("__row", *kept).join(union, "__row")
    hit = F.aggregate("__r", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return found.select(
        *kept,
        F.col("__n").alias("n_words"),
        hit.alias("n_hit"),
        F.array_sort("__i").alias("items"),
        F.size("__i").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("__i")), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        (F.transform("__r", lambda x: F.slice(x, 3, 2)) if spans else F.array().cast("array<array<bigint>>")).alias("spans"),
    )

"""Language-model scores from Elias-Fano n-gram tries.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end token. The model is a
bigram with Dirichlet smoothing over the add-``ADD`` unigram p1:
p(w | v) = (c(v w) + MU * p1(w)) / (c(v) + MU), which sums to one for every context.

The trie is cut into shards by context word, each built and queried in one task and never
gathered anywhere. In a shard (``Trie``) the sorted word ids, the contexts, the pointers from
a context to its followers, and the followers themselves, made monotone by their context's
position, are Elias-Fano sequences over one byte buffer that is read in place; smoothed
log-probabilities and backoff weights are 16-bit codes. A query is a successor search for the
word inside its context's range.

Texts are cut into words once: each batch of documents is stored in the shared folder as its
distinct words and a number for each token, and all later passes read that table.

The ``TOP`` most frequent words (a fixed number, found from exact counts over all training
rows) are broadcast with their counts and travel as 16-bit codes, others as 64-bit hashes.
Tokens of other words first pass through shards by predicted word, which count them, and then
go on to the shards of their context with that count. A context with more than its share of
a shard is spread by its follower; its total is one of the broadcast counts, and every shard
that is asked for it keeps its backoff weight, with or without followers there. Rows are packed
arrays, one for each batch of documents and shard, and per-document sums come back likewise.

A pair of words that alone would fill half a shard does not travel. If it has a share s of all
tokens, at least s / 2 of all tokens are its occurrences in batches where it makes up s / 2 or
more: so adding up what is frequent in its own batch finds every such pair, and at most 2 / s
others with them. Their training counts are then taken exactly, and a trie of these pairs, at
most twice ``PAIRS``, is broadcast and scores them where they stand.

Rows without doc_id are scored but not learned from; null texts are empty (one end token);
rows that repeat are learned from and scored as often as they occur; an empty table gives
an empty table, and a table without training rows scores by the add-``ADD`` prior alone.
Other input columns are not carried along.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ADD, MU = 0.1, 30.0
#: Words with a code; codes of the end and of the start; characters of a shard and of a batch; documents of a batch.
TOP, END, START = 65_000, 65_534, 65_535
SHARD_CHARS, BATCH_CHARS, BATCH_DOCS = 12_000_000, 8_000_000, 16_384
#: A pair of words is hot at one part in twice the shards of all tokens, or at one in PAIRS if that is more.
PAIRS = 1 << 20
#: Up to so many shards have a partition each.
EVEN = 10_000
#: Codes are multiples of 1 / SCALE of log10.
SCALE = 4096
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_TRAIN = np.uint64(1 << 63)
_ROW = "shard int, batch long, kind int, v binary, w binary, n binary, at binary"
_PART = "batch long, kind int, at binary, a binary, b binary, c binary"
_TOKENS = "key long, chars long, tokens long, learned long, docs binary, words binary, at binary"
_DOC = [("null", bool), ("id", np.int64), ("n", np.int64), ("learn", bool)]
#: Row groups of the stored tokens: a task holds one of them, not a whole file.
_ROW_GROUP = {"parquet.block.size": str(16 << 20)}


class EliasFano:
    """A sorted sequence of integers in a byte buffer: the low bits packed, the high bits in unary."""

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = values.astype(np.uint64)
        n = len(v)
        low = max(0, int(np.floor(np.log2((int(v[-1]) + 1) / n)))) if n else 0
        low = min(low, 56)
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.empty((n, 0), np.uint8)
        lows = np.packbits(bits.ravel(), bitorder="little").tobytes() + b"\0" * 8
        top = v >> np.uint64(low)
        high = np.zeros(-(-(n + (int(top[-1]) if n else 0) + 2) // 64) * 64, np.uint8)
        high[top.astype(np.int64) + np.arange(n)] = 1
        lows += b"\0" * (-len(lows) % 8)
        return np.array([n, low, len(lows)], np.uint64).tobytes() + lows + np.packbits(high, bitorder="little").tobytes()

    def __init__(self, buffer):
        n, low, size = (int(x) for x in np.frombuffer(buffer, np.uint64, 3))
        self.n, self.low = n, low
        self.lows = np.frombuffer(buffer, np.uint8, size, 24)
        self.high = np.frombuffer(buffer, np.uint64, offset=24 + size)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = np.concatenate(([0], np.cumsum(64 - ones)))

    def _select(self, before: np.ndarray, words, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit of ``words``, which have ``before`` of them before each word."""
        w = np.searchsorted(before, k, "right") - 1
        left, bits, at = k - before[w], words(w), np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count((bits >> at.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
            skip = left >= part
            left -= np.where(skip, part, 0)
            at += np.where(skip, step, 0)
        return w * 64 + at

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        got = np.zeros(len(i), np.uint64)
        for k in range(8):
            got |= self.lows[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
        return (got >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = self._select(self.ones, lambda w: self.high[w], i) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element >= x, and whether it equals x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        bucket = np.minimum(x >> np.uint64(self.low), np.uint64(self.zeros[-1] - 1)).astype(np.int64)
        flip = lambda w: ~self.high[w]
        start = lambda b: np.where(b > 0, self._select(self.zeros, flip, np.maximum(b - 1, 0)) - b + 1, 0)
        lo, end = start(bucket), np.minimum(start(np.minimum(bucket + 1, self.zeros[-1] - 1)), self.n)
        end = np.maximum(end, lo)
        beyond, hi, want = (x >> np.uint64(self.low)) > bucket.astype(np.uint64), end.copy(), x & np.uint64((1 << self.low) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        found = (lo < end) & ~beyond
        found[found] = self._low(lo[found]) == want[found]
        return lo, found


class Trie:
    """Two levels over one buffer: contexts, and their followers with quantised log-probabilities."""

    @staticmethod
    def build(v: np.ndarray, w: np.ndarray, n: np.ndarray, p1: np.ndarray, total, contexts: np.ndarray) -> bytes:
        """Distinct bigrams (v, w), sorted, with counts and p1(w); ``total(ids, sums)`` gives c(v).
        ``contexts`` are kept even if they have no follower among the bigrams."""
        words = np.unique(np.concatenate((v, w, contexts)))
        heads = np.union1d(v, contexts)
        first = np.searchsorted(v, heads)
        c = total(heads, np.diff(np.append(0, np.cumsum(n))[np.append(first, len(v))]))
        owner = np.repeat(np.arange(len(heads)), np.diff(np.append(first, len(v))))
        prob = (n + MU * p1) / (c[owner] + MU)
        parts = [EliasFano.encode(x) for x in (words, np.searchsorted(words, heads), np.append(first, len(v)), owner.astype(np.uint64) * np.uint64(max(len(words), 1)) + np.searchsorted(words, w).astype(np.uint64))]
        parts += [Trie._code(x).tobytes() for x in (np.log10(MU / (c + MU)), np.log10(prob))]
        parts = [p + b"\0" * (-len(p) % 8) for p in parts]
        return np.cumsum([0] + [len(p) for p in parts]).astype(np.int64).tobytes() + b"".join(parts)

    @staticmethod
    def _code(logs: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(-logs * SCALE), 0, 65_535).astype(np.uint16)

    def __init__(self, buffer):
        view = memoryview(buffer)
        ends = np.frombuffer(view, np.int64, 7) + 56
        part = [view[a:b] for a, b in zip(ends, ends[1:])]
        self.words, self.heads, self.starts, self.follow = map(EliasFano, part[:4])
        self.backoff, self.prob = (np.frombuffer(p, np.uint16) for p in part[4:])

    def score(self, v: np.ndarray, w: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """log10 p(w | v)."""
        out = np.log10(p1)
        iv, known = self.words.successor(v)
        head, is_head = self.heads.successor(iv.astype(np.uint64))
        q = np.flatnonzero(known & is_head)
        out[q] -= self.backoff[head[q]] / SCALE
        iw, known = self.words.successor(w[q])
        q, iw = q[known], iw[known]
        at, found = self.follow.successor(head[q].astype(np.uint64) * np.uint64(max(self.words.n, 1)) + iw.astype(np.uint64))
        at, q = at[found], q[found]
        inside = (at >= self.starts[head[q]].astype(np.int64)) & (at < self.starts[head[q] + 1].astype(np.int64))
        out[q[inside]] = -(self.prob[at[inside]] / SCALE)
        return out


def _pack(ids: np.ndarray) -> bytes:
    """Codes in two bytes, hashes in eight, and a bit each to tell them apart."""
    big = ids > START
    return np.array([len(ids)], np.uint64).tobytes() + np.packbits(big).tobytes() + ids[~big].astype(np.uint16).tobytes() + ids[big].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    big = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), 8), count=n).astype(bool)
    ids, at, small = np.empty(n, np.uint64), 8 + -(-n // 8), int(n - big.sum())
    ids[~big] = np.frombuffer(raw, np.uint16, small, at)
    ids[big] = np.frombuffer(raw[at + 2 * small :], np.uint64)
    return ids


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _tokenised(ids, texts, learn) -> tuple:
    """A row of _TOKENS: documents, their distinct words, and the words' numbers end to end. Number
    0 is the end token, which closes each document. Low bytes of all numbers come first, then the
    next bytes, and words are text rather than hashes, as both compress better so."""
    number = defaultdict(counter(1).__next__)
    at, sizes = [], np.empty(len(ids), np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else ()
        sizes[k] = len(words) + 1
        at += [np.fromiter(map(number.__getitem__, words), np.uint32, len(words)), np.zeros(1, np.uint32)]
    planes = np.ascontiguousarray(np.concatenate(at).view(np.uint8).reshape(-1, 4).T)
    docs = np.array([(i is None, i or 0, n, k) for i, n, k in zip(ids, sizes, learn)], _DOC)
    parts = [docs.tobytes(), b" ".join(number), planes.tobytes()]
    key = xxhash.xxh3_64_intdigest(b"".join(parts)) >> 1  # of the content, so that a retry gives the same
    return key, sum(len(t or "") for t in texts), int(sizes.sum()), int(sum(learn)), *parts


def _tokenise(stream):
    ids, texts, learn, size = [], [], [], 0
    for record in stream:
        for i, t, k in zip(*(record.column(c).to_pylist() for c in ("doc_id", "text", "learn"))):
            ids.append(i)
            texts.append(t)
            learn.append(k)
            size += len(t or "")
            if size >= BATCH_CHARS or len(ids) >= BATCH_DOCS:
                yield _record([_tokenised(ids, texts, learn)], _TOKEN_NAMES, _TOKEN_TYPES)
                ids, texts, learn, size = [], [], [], 0
    if ids:
        yield _record([_tokenised(ids, texts, learn)], _TOKEN_NAMES, _TOKEN_TYPES)


_TOKEN_NAMES = ["key", "chars", "tokens", "learned", "docs", "words", "at"]
_TOKEN_TYPES = [pa.int64()] * 4 + [pa.binary()] * 3


class _Batch:
    """Some documents as stored: ``words`` are hashes of distinct words, none of them small enough to
    be taken for a code, after that of the end; ``at`` numbers them token by token."""

    def __init__(self, key: int, docs, words, at):
        self.key, self.docs = key, np.frombuffer(docs, _DOC)
        split = words.to_pybytes().split()
        self.words = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split)) | np.uint64(1 << 20)
        self.words = np.append(np.uint64(END), self.words)
        self.at = np.ascontiguousarray(np.frombuffer(at, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
        self.doc = np.repeat(np.arange(len(self.docs)), self.docs["n"])
        self.starts = np.cumsum(self.docs["n"]) - self.docs["n"]
        self.learn = self.docs["learn"][self.doc]


def _batches(stream):
    for record in stream:
        for k in range(record.num_rows):
            yield _Batch(record.column("key")[k].as_py(), *(record.column(c)[k].as_buffer() for c in ("docs", "words", "at")))


def _record(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=names)


def _by_shard(rows: DataFrame, shards: int):
    """Rows grouped by shard: a hash would put several of few shards into one task, while of many
    each task gets about as many."""
    return (rows.repartitionById(shards, F.col("shard")) if shards <= EVEN else rows).groupBy("shard")


def vocabulary(stored: DataFrame, shards: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Training tokens, distinct training tokens, and the ids and counts of the TOP words."""

    def count(stream):
        for b in _batches(stream):
            n = np.bincount(b.at, b.learn, len(b.words)).astype(np.int64)
            w, n = b.words[n > 0], n[n > 0]
            if not len(w):
                continue
            shard = (_mixed(w) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(s, w[order[a:z]].tobytes(), n[order[a:z]].tobytes()) for s, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
            yield _record(rows, ["shard", "w", "n"], [pa.int32(), pa.binary(), pa.binary()])

    most = -(-4 * TOP // shards) if shards > 8 else TOP + 1

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        w, n = np.frombuffer(b"".join(pdf["w"]), np.uint64), np.frombuffer(b"".join(pdf["n"]), np.int64)
        w, at = np.unique(w, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        best = np.argsort(-n, kind="stable")[:most]
        return pd.DataFrame({"tokens": [n.sum()], "words": [len(w)], "w": [w[best].tobytes()], "n": [n[best].tobytes()]})

    found = _by_shard(stored.mapInArrow(count, "shard int, w binary, n binary"), shards).applyInPandas(total, "tokens long, words long, w binary, n binary")
    n_tokens = n_words = 0
    top_w, top_n = np.empty(0, np.uint64), np.empty(0, np.int64)
    for r in found.toLocalIterator():  # a few times TOP words at most, kept to TOP as they come
        n_tokens, n_words = n_tokens + r["tokens"], n_words + r["words"]
        top_w, top_n = np.append(top_w, np.frombuffer(r["w"], np.uint64)), np.append(top_n, np.frombuffer(r["n"], np.int64))
        word = top_w > START
        keep = np.argsort(-top_n * word, kind="stable")[: TOP]
        keep = np.union1d(keep[word[keep]], np.flatnonzero(~word))
        top_w, top_n = top_w[keep], top_n[keep]
    order = np.argsort(top_w)
    return n_tokens, n_words, top_w[order], top_n[order]


class _Coder:
    """Codes and exact counts of the frequent words; everything the tasks need to know."""

    def __init__(self, top_w, top_n, n_tokens, n_words, n_docs, shards):
        word = top_w > START
        self.hashes, self.counts = top_w[word], np.zeros(START + 1, np.int64)
        self.counts[: len(self.hashes)] = top_n[word]
        self.counts[END] = self.counts[START] = n_docs
        self.norm, self.shards = n_tokens + ADD * (n_words + 1), shards
        # how many parts a context is spread over: one for each half shard it would fill
        self.spread = np.maximum(1, np.ceil(2.0 * shards * self.counts / max(n_tokens, 1))).astype(np.uint64)
        self.spread[self.counts * shards <= n_tokens] = 1

    def code(self, w: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, w), max(len(self.hashes) - 1, 0))
        return np.where(self.hashes[at] == w, at.astype(np.uint64), w) if len(self.hashes) else w

    def shard(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        parts = np.where(v <= START, self.spread[np.minimum(v, START).astype(np.int64)], np.uint64(1))
        return (_mixed(v + np.uint64(0x1000003) * (_mixed(w) % parts)) % np.uint64(self.shards)).astype(np.int64)

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / self.norm


def _rows_by_shard(coder, batch, v, w, n, at):
    """Packed rows, one a shard, sorted inside so that they compress."""
    shard = coder.shard(v, w)
    order = np.lexsort((w, v, shard))
    cuts = np.searchsorted(shard[order], np.arange(coder.shards + 1))
    for s, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if z > a:
            o = order[a:z]
            yield s, batch, 1, _pack(v[o]), _pack(w[o]), b"" if n is None else n[o].tobytes(), at[o].tobytes()


_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["shard", "batch", "kind", "v", "w", "n", "at"]


def _coded(b: _Batch, coder: _Coder):
    """Codes of the contexts and the words, and the documents with the training bit, token by token."""
    w = coder.code(b.words)[b.at]
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[b.starts] = START
    return v, w, b.doc.astype(np.uint16) | np.where(b.learn, 1 << 15, 0).astype(np.uint16)


def _pairs(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where both words have a code, and the two codes as one number."""
    o = np.flatnonzero((v <= START) & (w <= START))
    return o, ((v[o] << np.uint64(16)) | w[o]).astype(np.int64)


def _find(pairs: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``pairs`` in the sorted ``among``, and which of them are there."""
    if not len(among):
        return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    at = np.minimum(np.searchsorted(among, pairs), len(among) - 1)
    return at, among[at] == pairs


def hot_pairs(stored: DataFrame, shared, tokens: int) -> tuple[np.ndarray, bytes]:
    """All pairs with at least the share of all tokens that makes them hot, sorted, and their trie."""
    parts = min(2 * shared.value.shards, PAIRS)

    def frequent(stream):
        for b in _batches(stream):
            v, w, _ = _coded(b, shared.value)
            pair, n = np.unique(_pairs(v, w)[1], return_counts=True)
            keep = n * 2 * parts >= len(w)
            yield pa.RecordBatch.from_arrays([pa.array(pair[keep]), pa.array(n[keep])], names=["pair", "n"])

    found = stored.mapInArrow(frequent, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.sort(found.where(F.col("n") * 2 * parts >= tokens).select("pair").toArrow()["pair"].to_numpy())
    near = stored.sparkSession.sparkContext.broadcast(pairs)

    def learned(stream):
        n = np.zeros(len(near.value), np.int64)
        for b in _batches(stream):
            v, w, _ = _coded(b, shared.value)
            o, pair = _pairs(v, w)
            at, here = _find(pair, near.value)
            n += np.bincount(at[here], b.learn[o[here]], len(n)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(near.value), pa.array(n)], names=["pair", "n"])

    n = np.zeros(len(pairs), np.int64)
    if len(pairs):
        counts = stored.mapInArrow(learned, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
        n = counts["n"].to_numpy()
    v, w = (pairs >> 16).astype(np.uint64), (pairs & 0xFFFF).astype(np.uint64)
    coder, seen = shared.value, n > 0
    p1 = coder.p1(coder.counts[w.astype(np.int64)])
    contexts = np.unique(v[coder.counts[v.astype(np.int64)] > 0])
    trie = Trie.build(v[seen], w[seen], n[seen], p1[seen], lambda ids, _: coder.counts[ids.astype(np.int64)], contexts)
    return pairs, trie


def score(docs: DataFrame, held_out, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    ``held_out`` is a column; rows where it is false are learned from.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.col(text).alias("text"), (F.coalesce(~held_out, F.lit(False)) & F.col("doc_id").isNotNull()).alias("learn"))
    stored = materialize(own.mapInArrow(_tokenise, _TOKENS), "tokens", **_ROW_GROUP)
    known = stored.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chars", "tokens", "learned"))).first()
    stored = stored.select("key", "docs", "words", "at")
    shards = max(4, -(-known["chars"] // SHARD_CHARS))
    n_tokens, n_words, top_w, top_n = vocabulary(stored, shards)
    shared = spark.sparkContext.broadcast(_Coder(top_w, top_n, n_tokens, n_words, known["learned"], shards))
    hot = spark.sparkContext.broadcast(hot_pairs(stored, shared, known["tokens"]))

    def rare(stream):
        """Tokens whose predicted word has no code, by that word."""
        coder = shared.value
        for b in _batches(stream):
            v, w, at = _coded(b, coder)
            o = np.flatnonzero(w > START)
            shard = (_mixed(w[o]) % np.uint64(shards)).astype(np.int64)
            o = o[np.lexsort((w[o], shard))]
            cuts = np.searchsorted(np.sort(shard), np.arange(shards + 1))
            rows = [(s, b.key, 0, _pack(v[o[a:z]]), _pack(w[o[a:z]]), b"", at[o[a:z]].tobytes()) for s, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
            yield _record(rows, _NAMES, _TYPES)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        """Counts the words of a shard, sums their share of the base score, and sends the tokens on."""
        coder, sizes = shared.value, [len(a) // 2 for a in pdf["at"]]
        v, w = (np.concatenate([_unpack(x) for x in pdf[c]]) for c in ("v", "w"))
        at = np.frombuffer(b"".join(pdf["at"]), np.uint16)
        batch = np.repeat(pdf["batch"].to_numpy(np.uint64), sizes)
        _, which = np.unique(w, return_inverse=True)
        n = np.bincount(which, at >> 15).astype(np.uint32)[which]
        rows, edges = [], np.cumsum([0, *sizes])
        for k, key in enumerate(pdf["batch"]):
            d, c = at[edges[k] : edges[k + 1]] & 0x7FFF, n[edges[k] : edges[k + 1]]
            here, which = np.unique(d, return_inverse=True)
            # of a row: documents, sums of log10(c + ADD), known tokens
            rows.append((xxhash.xxh3_64_intdigest(int(key).to_bytes(8, "little")) % shards, key, 2, here.tobytes(), np.bincount(which, np.log10(c + ADD)).tobytes(), np.bincount(which, c > 0).astype(np.uint32).tobytes(), b""))
        wide = np.empty(len(at), [("k", np.uint64), ("d", np.uint16)])
        wide["k"], wide["d"] = batch, at
        rows += [(s, -1, 1, a, b, c, d) for s, _, _, a, b, c, d in _rows_by_shard(coder, -1, v, w, n, wide)]
        return pd.DataFrame(rows, columns=_NAMES)

    def common(stream):
        """Tokens whose predicted word has a code, by context; and what is known of each document:
        among it the scores of its hot pairs."""
        coder, (pairs, trie) = shared.value, hot.value
        hv, hw = (pairs >> 16).astype(np.uint64), (pairs & 0xFFFF).astype(np.uint64)
        each = Trie(trie).score(hv, hw, coder.p1(coder.counts[hw.astype(np.int64)]))
        for b in _batches(stream):
            v, w, at = _coded(b, coder)
            o, pair = _pairs(v, w)
            which, here = _find(pair, pairs)
            total = np.bincount(b.doc[o[here]], each[which[here]], len(b.docs))
            cold = w <= START
            cold[o[here]] = False
            o = np.flatnonzero(w <= START)
            c = coder.counts[w[o].astype(np.int64)]
            base = np.bincount(b.doc[o], np.log10(c + ADD), len(b.docs))
            hit = np.bincount(b.doc[o], c > 0, len(b.docs)).astype(np.uint32)
            rows = list(_rows_by_shard(coder, b.key, v[cold], w[cold], None, at[cold]))
            rows.append((xxhash.xxh3_64_intdigest(b.key.to_bytes(8, "little")) % shards, b.key, 3, b.docs.tobytes(), base.tobytes(), hit.tobytes(), total.tobytes()))
            yield _record(rows, _NAMES, _TYPES)

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        """Builds the trie of a shard from the training tokens and scores all of them."""
        coder = shared.value
        out = [(r.batch, r.kind, r.v, r.w, r.n, r.at) for r in pdf[pdf["kind"] > 1].itertuples()]
        pdf = pdf[pdf["kind"] == 1]
        if len(pdf):
            v, w = (np.concatenate([_unpack(x) for x in pdf[c]]) for c in ("v", "w"))
            keys, docs_, counts = [], [], []
            for r in pdf.itertuples():
                if r.batch >= 0:
                    d = np.frombuffer(r.at, np.uint16)
                    keys.append(np.full(len(d), r.batch, np.uint64))
                    counts.append(None)
                else:
                    wide = np.frombuffer(r.at, [("k", np.uint64), ("d", np.uint16)])
                    d = wide["d"]
                    keys.append(wide["k"])
                    counts.append(np.frombuffer(r.n, np.uint32))
                docs_.append(d)
            c2 = np.concatenate([np.zeros(len(d), np.int64) if c is None else c.astype(np.int64) for c, d in zip(counts, docs_)])
            key, at = np.concatenate(keys), np.concatenate(docs_)
            code = w <= START
            c2[code] = coder.counts[w[code].astype(np.int64)]
            order = np.lexsort((w, v))
            new = np.append(True, (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1]))
            first = np.flatnonzero(new)
            pair = np.empty(len(v), np.int64)
            pair[order] = np.cumsum(new) - 1
            uv, uw, p1 = v[order[first]], w[order[first]], coder.p1(c2[order[first]])
            n = np.bincount(pair, at >> 15).astype(np.int64)
            seen = n > 0

            def context_totals(ids, sums):
                return np.where(ids <= START, coder.counts[np.minimum(ids, START).astype(np.int64)], sums)

            asked = np.unique(uv[uv <= START])
            asked = asked[coder.counts[asked.astype(np.int64)] > 0]
            trie = Trie(Trie.build(uv[seen], uw[seen], n[seen], p1[seen], context_totals, asked))
            each = trie.score(uv, uw, p1)[pair]
            batch, which = np.unique(key, return_inverse=True)
            slot = which * (1 << 15) + (at & 0x7FFF)
            slots, where = np.unique(slot, return_inverse=True)
            sums, cuts = np.bincount(where, each), np.searchsorted(slots, np.arange(len(batch) + 1) * (1 << 15))
            out += [(int(b), 1, (slots[a:z] & 0x7FFF).astype(np.uint16).tobytes(), sums[a:z].tobytes(), b"", b"") for b, a, z in zip(batch, cuts, cuts[1:])]
        return pd.DataFrame(out, columns=["batch", "kind", "at", "a", "b", "c"])

    norm = float(np.log10(n_tokens + ADD * (n_words + 1)))

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        """Adds up the parts of a batch. Batches of equal content share a key: their sums are
        equal, so they are divided by their number and the documents returned as often."""
        meta = pdf[pdf["kind"] == 3]
        rows = np.frombuffer(meta["at"].iloc[0], _DOC)
        copies, base, hit, total = len(meta), np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
        for r in pdf.itertuples():
            if r.kind == 3:
                base += np.frombuffer(r.a)
                hit += np.frombuffer(r.b, np.uint32)
                total += np.frombuffer(r.c)
            elif r.kind == 2:
                d = np.frombuffer(r.at, np.uint16)
                base[d] += np.frombuffer(r.a)
                hit[d] += np.frombuffer(r.b, np.uint32)
            else:
                total[np.frombuffer(r.at, np.uint16)] += np.frombuffer(r.a)
        ids = pd.Series(rows["id"]).astype("Int64").mask(pd.Series(rows["null"]))
        one = pd.DataFrame({"doc_id": ids, "learn": rows["learn"], "n_tokens": rows["n"], "n_known": np.rint(hit / copies).astype(np.int64), "base_score": base / copies - rows["n"] * norm, "score": total / copies})
        return pd.concat([one] * copies)

    later = _by_shard(stored.mapInArrow(rare, _ROW), shards).applyInPandas(counted, _ROW)
    parts = stored.mapInArrow(common, _ROW).union(later)
    parts = _by_shard(parts, shards).applyInPandas(scored, _PART)
    out = parts.groupBy("batch").applyInPandas(gathered, "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out():
    """Rows that nothing is learned from: crc32(doc_id as text) mod 10 is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0

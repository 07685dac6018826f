"""Periodic runs of words: stretches that repeat themselves, found by counting matches by lag.

A run is a stretch of consecutive words with smallest period q (words q apart are identical),
of at least max(MIN_WORDS, 3 q) words, that no neighbouring word extends. At a lag p its matches
(words p apart that are equal) are an island of max(MIN_WORDS - p, 2 p) consecutive positions or
more, so a lag with fewer matches in the whole text holds no run. Matches of all lags are
counted without looking at any pair of lag and position (heavy and light words):

* a word of more than sqrt(2 n log2 n) occurrences is heavy: the autocorrelation of its
  positions comes from FFTs, whose rounded values are exact counts;
* of a light word the differences of all pairs of positions are counted, which stay fewer.

Lags with enough matches are scanned for islands in ascending order. An island of a multiple of a
known run's period inside that run is that run again (Fine and Wilf, 1965), so its matches are
taken off the count first: a text of one repeated word is scanned once, not for every lag.
A scan looks at aligned blocks half as long as an island must be, one of which lies in every
island, and only where a block matches throughout is the island's extent read.

Texts are worked on whole, some BATCH_BYTES of them together, in Arrow tasks without a shuffle.
A null or empty text has no words and no run. A very long text is one row of one task and takes
about 150 bytes a word. Of equal exponents the run with the smallest start counts, then that
with the smallest period. Repeated rows give their results each; an empty table gives an empty
table; columns named like the added ones are replaced, all others are carried along.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count as counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MIN_WORDS, EXPONENT = 24, 3
#: Bytes of text that are worked on together, and lags that are counted at once.
BATCH_BYTES, CHUNK = 1 << 20, 1 << 22

_LONG = T.LongType()
_RUN = T.StructType([T.StructField(c, _LONG) for c in ("start", "length", "period")])
FIELDS = T.StructType([
    T.StructField("n_runs", _LONG), T.StructField("start", _LONG), T.StructField("length", _LONG), T.StructField("period", _LONG),
    T.StructField("exponent_milli", _LONG), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType()),
])


def needed(lag):
    """Consecutive matches that a run makes at its period at least."""
    return np.maximum(MIN_WORDS - lag, (EXPONENT - 1) * lag)


def lag_counts(doc: np.ndarray, word: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches by document and lag, end to end, and where each document's begin. ``doc`` and ``word`` number
    the words of all documents one after the other; lags go from 0 (no matches) to a third of the
    document's words."""
    most = sizes // EXPONENT
    base = np.concatenate([[0], np.cumsum(most + 1)])
    total = np.zeros(base[-1], np.int64)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = doc * (word.max(initial=0) + 1) + word
    order = np.argsort(key, kind="stable")
    key, place, doc = key[order], place[order], doc[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    n = sizes[doc[first]]
    heavy = times > np.sqrt(2.0 * n * np.log2(np.maximum(n, 2)))

    waiting, held = [], 0
    at = np.flatnonzero(np.repeat(~heavy & (times > 1), times))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        lag = place[at + step] - place[at]
        near = lag <= most[doc[at]]
        at, lag = at[near], lag[near]
        waiting.append(base[doc[at]] + lag)
        held += len(at)
        if held > CHUNK or not len(at):
            total += np.bincount(np.concatenate(waiting), minlength=len(total))
            waiting, held = [], 0

    of = defaultdict(list)
    for k in np.flatnonzero(heavy):
        of[doc[first[k]]].append(k)
    for d, words in of.items():
        length = 1 << int(sizes[d] + most[d]).bit_length()
        power = np.zeros(length // 2 + 1)
        for k in words:
            mark = np.zeros(length)
            mark[place[first[k] : first[k] + times[k]]] = 1.0
            power += np.abs(np.fft.rfft(mark)) ** 2
        total[base[d] + 1 : base[d + 1]] += np.rint(np.fft.irfft(power, length)[1 : most[d] + 1]).astype(np.int64)
    return total, base


def islands(word: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(first position, matches) of each longest stretch of at least ``least`` consecutive matches."""
    size, end = least // 2, len(word) - lag
    blocks = end // size
    one, two = word[: blocks * size].reshape(blocks, size), word[lag : lag + blocks * size].reshape(blocks, size)
    hit = np.flatnonzero((one[:, :8] == two[:, :8]).all(axis=1))
    hit = hit[(one[hit] == two[hit]).all(axis=1)] if size > 8 else hit
    if not len(hit):
        return []
    out, cuts = [], np.flatnonzero(np.diff(hit) > 1)
    for a, b in zip(hit[np.append(0, cuts + 1)], hit[np.append(cuts, len(hit) - 1)]):
        lo, hi = int(a) * size, int(b + 1) * size
        miss = np.flatnonzero(word[max(lo - size, 0) : lo] != word[max(lo - size, 0) + lag : lo + lag])
        left = max(lo - size, 0) + int(miss[-1]) + 1 if len(miss) else max(lo - size, 0)
        miss = np.flatnonzero(word[hi : min(hi + 2 * size, end)] != word[hi + lag : min(hi + 2 * size, end) + lag])
        right = hi + int(miss[0]) if len(miss) else min(hi + 2 * size, end)
        if right - left >= least:
            out.append((left, right - left))
    return out


def runs_of(word: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period, of one document's numbered words. ``counts`` by lag
    is changed."""
    found: dict[tuple[int, int], int] = {}
    lags = np.arange(len(counts))
    for p in np.flatnonzero((counts >= needed(lags)) & (lags > 0)).tolist():
        least = int(needed(p))
        if counts[p] < least:
            continue
        for start, n in islands(word, p, least):
            if (start, n + p) in found:
                continue
            found[start, n + p] = p
            again = lags[2 * p : n + p : p]
            counts[again] -= n + p - again
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _judged(texts: list[bytes | None]) -> list[tuple]:
    """The added columns for some texts."""
    split = [t.split() if t else [] for t in texts]
    long = [k for k, words in enumerate(split) if len(words) >= MIN_WORDS]
    sizes = np.array([len(split[k]) for k in long], np.int64)
    number = defaultdict(counter().__next__)
    word = np.fromiter((number[w] for k in long for w in split[k]), np.int64, int(sizes.sum()))
    counts, base = lag_counts(np.repeat(np.arange(len(long)), sizes), word, sizes)
    lags = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    may = {int(d) for d in np.searchsorted(base, np.flatnonzero((counts >= needed(lags)) & (lags > 0)), "right") - 1}
    ends, runs = np.cumsum(sizes), {}
    for d in may:
        if found := runs_of(word[ends[d] - sizes[d] : ends[d]], counts[base[d] : base[d + 1]]):
            runs[long[d]] = found
    out = []
    for k, words in enumerate(split):
        mine = runs.get(k, [])
        if not mine:
            out.append((0, None, None, None, None, [], b" ".join(words).decode(errors="replace")))
            continue
        best, keep = mine[0], np.ones(len(words), bool)
        for s, n, q in mine:
            keep[s + q : s + n] = False
            if n * best[2] > best[1] * q:
                best = (s, n, q)
        kept = b" ".join(words[i] for i in np.flatnonzero(keep)).decode(errors="replace")
        out.append((len(mine), *best, 1000 * best[1] // best[2], [dict(zip(("start", "length", "period"), r)) for r in mine], kept))
    return out


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_runs; start (word number), length, period and exponent_milli of the run of the
    greatest exponent (null without a run); all ``runs`` by start, then period; and ``collapsed``, the
    words that no run holds after its first period, joined by spaces."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c not in FIELDS.names]
    types = [f.type for f in to_arrow_schema(FIELDS)]

    def judge(batches):
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary())
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(size // BATCH_BYTES)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                made = _judged(texts[a:b].to_pylist())
                new = [pa.array([r[k] for r in made], type=t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in kept), *new], names=[*kept, *FIELDS.names])

    both = docs.select(*kept, docs[text].alias("__text"))
    return both.mapInArrow(judge, T.StructType([*(docs.schema[c] for c in kept), *FIELDS.fields]))

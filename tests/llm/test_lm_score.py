"""Language-model scores against a model written out with dictionaries."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.llm import lm_score


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    uni, pair, ctx = Counter(), Counter(), Counter()
    for t, h in zip(toks, held):
        if not h:
            uni.update(t)
            for v, w in zip([True, *t], t):
                pair[v, w] += 1
                ctx[v] += 1
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    out = {}
    for (i, _), t, h in zip(rows, toks, held):
        s = sum(log10((pair[a, b] + lm_score.MU * p1(b)) / (ctx[a] + lm_score.MU)) for a, b in zip([True, *t], t))
        out[i] = (h, len(t), sum(uni[w] > 0 for w in t), n, sum(log10(p1(w)) for w in t), s)
    return out


@pytest.mark.parametrize("top", [65_000, 20])
def test_scores_equal_brute_force(spark, docs, monkeypatch, top):
    monkeypatch.setattr(lm_score, "TOP", top)
    monkeypatch.setattr(lm_score, "SHARD_CHARS", 50_000)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = lm_score.score(docs, lm_score.held_out()).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score == pytest.approx(w[5], abs=2e-4 * r.n_tokens)


def test_context_spread_over_many_shards_keeps_its_backoff(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_CHARS", 200)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(f"hot unseen{i}x{k}" for k in range(20)) if i in held else "hot one " * 20) for i in range(400)]
    want = brute(rows)
    for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), lm_score.held_out()).collect():
        assert r.score == pytest.approx(want[r.doc_id][5], abs=2e-4 * r.n_tokens)


def test_hot_pairs_are_all_found_and_do_not_travel(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_CHARS", 2_000)
    rows = [(i, "the same " * (60 if i % 3 else 0) + " ".join(f"w{i * k % 997}" for k in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).selectExpr("*", "doc_id % 10 <> 0 as learn")
    stored = docs.mapInArrow(lm_score._tokenise, lm_score._TOKENS)
    n_tokens, n_words, words, counts = lm_score.vocabulary(stored, 8)
    coder = lm_score._Coder(words, counts, n_tokens, n_words, sum(i % 10 != 0 for i, _ in rows), 8)
    pair, learned = Counter(), Counter()
    for i, text in rows:
        t = text.split()
        pair.update(zip(t, t[1:]))
        if i % 10:
            learned.update(zip(t, t[1:]))
    total = sum(len(x.split()) + 1 for _, x in rows)
    code = lambda w: int(coder.code(np.array([lm_score.xxhash.xxh3_64_intdigest(w) | 1 << 20], np.uint64))[0])
    hot = {(v, w): code(v) << 16 | code(w) for (v, w), n in pair.items() if n * 16 >= total}
    assert hot.keys() == {("the", "same"), ("same", "the")}
    found, trie = lm_score.hot_pairs(stored, spark.sparkContext.broadcast(coder), total)
    assert set(hot.values()) <= set(found.tolist())
    for (v, w), at in hot.items():
        a, b = np.array([code(v)], np.uint64), np.array([code(w)], np.uint64)
        p1 = coder.p1(coder.counts[b.astype(int)])
        want = log10((learned[v, w] + lm_score.MU * p1[0]) / (coder.counts[code(v)] + lm_score.MU))
        assert lm_score.Trie(trie).score(a, b, p1)[0] == pytest.approx(want, abs=1e-3)


def test_model_beats_base_on_held_out(spark, docs):
    rows = [r for r in lm_score.score(docs, lm_score.held_out()).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "a b"), (4, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as score")
    out = lm_score.score(df, lm_score.held_out()).collect()
    assert len(out) == 6
    assert sorted(r.n_tokens for r in out) == [1, 1, 3, 4, 4, 30_001]
    twins = [r for r in out if r.doc_id == 3]
    assert twins[0] == twins[1]
    same = spark.createDataFrame([(3, "a b a"), (5, "c")] * 2, "doc_id long, text string").repartition(1)
    twice = lm_score.score(same.union(same), lm_score.held_out()).collect()
    want = brute([(3, "a b a"), (5, "c")] * 4)
    assert len(twice) == 8
    for r in twice:
        assert r.score == pytest.approx(want[r.doc_id][5], abs=1e-2) and r.base_score == pytest.approx(want[r.doc_id][4])
    assert lm_score.score(df.limit(0), lm_score.held_out()).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**62), max_size=300), st.lists(st.integers(0, 2**62), min_size=1, max_size=50))
def test_elias_fano_successor_and_access(values, queries):
    v = np.unique(np.array(values, np.uint64))
    ef = lm_score.EliasFano(lm_score.EliasFano.encode(v))
    q = np.array([*queries, *values[:20]], np.uint64)
    at, found = ef.successor(q)
    assert np.array_equal(at, np.searchsorted(v, q)) and np.array_equal(found, np.isin(q, v))
    if len(v):
        assert np.array_equal(ef[np.arange(len(v))], v)

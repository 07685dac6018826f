"""URL filter, periodic runs and centroid clustering: brute force, held-out accuracy and odd rows."""

import random
import re
import time
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.llm import centroid_clustering, periodic_runs, url_filter
from sylvan.llm.queries import QUERIES, planted_periods

SF = "/root/testdata/sf0.01"


# URL filter


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(n + p), n + p, a) for a, n, p in url_filter.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    best = max(fit, default=(0, None, None))
    return host, path, best[1], best[2]


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "http://COM/x?y#z", "ftp://a.net/es", "http://net/es/", "x://xnet/es/", "http://a.example.com/en/1", "http://www.example.com/en/",
    "http://x.www.EXAMPLE.com/en/q", "http://www.example.com/EN/", "http://notexample.com/en/", "http://example.com?/en/", "http://example.com#/en/", "a://b://com/", "http://É.Net/fr/é?", "http://net\n/fr/", "http://net/fr/\n/x",
]


def test_url_rules_on_odd_rows(spark):
    rows = [(k, u, "kept", "old") for k, u in enumerate(ODD_URLS)] + [(5, ODD_URLS[5], None, None), (None, ODD_URLS[7], None, None), (98, "http://a.net/es/" + "x/é" * 100_000, "long", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, n string, host string")
    out = url_filter.judge(pages)
    assert out.columns == ["page_id", "url", "n", *url_filter.ADDED]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, action = brute_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and r.verdict == (action or r.verdict)
    assert url_filter.judge(pages.where("false")).count() == 0
    unruled = url_filter.judge(pages, rules=[])
    assert {(r.rule, r.verdict, r.score) for r in unruled.collect()} == {(None, "allow", 0.0)}
    only = url_filter.judge(pages, rules=[("block", "net", "/")])
    assert {r.score for r in only.collect()} == {1.0}


def grams(host, path):
    out = {("h", m[i : i + n]) for m in ([f"^{host}$"] if host else []) for n in url_filter.N for i in range(len(m) - n + 1)}
    return out | {("p", path[i : i + n]) for n in url_filter.N for i in range(len(path) - n + 1)}


def test_url_query_equals_brute_force(spark):
    """Rules of every URL one by one; the model against one on the n-grams themselves, trained by plain gradient descent."""
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op11_url_filter"](spark, SF).collect()}
    want = {i: brute_url(u) for i, u in urls.items()}
    assert got.keys() == want.keys()
    for i, (host, path, rule, action) in want.items():
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert action is None or got[i].verdict == action
    shapes = sorted({(h, p, a) for h, p, _, a in want.values() if a})
    number = {g: k for k, g in enumerate(sorted({g for h, p, *_ in want.values() for g in grams(h, p)}))}
    vector = lambda h, p: np.bincount([number[g] for g in grams(h, p)], minlength=len(number)).astype(float)
    x, y = np.array([vector(h, p) for h, p, _ in shapes]), np.array([a == "block" for *_, a in shapes], float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) / len(y)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(4000):
        off = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        w, b = w - 0.1 * (off @ x + url_filter.REGULARISATION * w), b - 0.1 * off.sum()
    open_ = [i for i, (*_, action) in want.items() if action is None]
    same = [("block" if vector(want[i][0], want[i][1]) @ w + b > 0 else "allow") == got[i].verdict for i in open_]
    assert len(open_) > 50 and np.mean(same) >= 0.93


def test_url_model_on_urls_it_has_not_seen(spark):
    """Labels of half of the URLs; the rest is judged without rules."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = url_filter.judge(pages.where("false"))  # the columns alone
    assert ruled.columns == ["page_id", "url", *url_filter.ADDED]
    known = [(u, brute_url(u)[3]) for u in sorted({r.url for r in pages.collect()})]
    known = [(u, a == "block") for u, a in known if a]
    random.Random(1).shuffle(known)
    half = len(known) // 2
    labelled = spark.createDataFrame([*known[:half], ("http://x.org/", None)], "url string, block boolean")
    out = url_filter.judge(spark.createDataFrame(known[half:], "url string, truth boolean"), [], labelled, most=400).collect()
    assert np.mean([(r.verdict == "block") == r.truth for r in out]) >= 0.97


def test_url_sample_takes_both_labels(spark):
    rows = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"), (F.col("id") < 10).alias("label"))
    drawn = url_filter.sample(rows.union(rows), 300).toPandas()
    assert (drawn["label"] == 1).sum() == 10 and 200 < (drawn["label"] == 0).sum() < 400
    assert drawn.groupby("label")["weight"].sum().nunique() == 1


# periodic runs


def brute_runs(words):
    out = {}
    for p in range(1, len(words) // 3 + 1):
        same = [a == b for a, b in zip(words, words[p:])] + [False]
        start = 0
        for i, m in enumerate(same):
            if not m:
                if i > start and i - start + p >= max(24, 3 * p):
                    out.setdefault((start, i - start + p), p)
                start = i + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def found(texts):
    return [[(r["start"], r["length"], r["period"]) for r in x[5]] for x in periodic_runs._judged([t.encode() for t in texts])]


def test_runs_equal_brute_force():
    r, texts = random.Random(3), []
    for k in range(150):
        n, few = r.choice((10, 60, 200, 500)), r.choice((1, 2, 3, 40))
        words = [f"w{r.randrange(few)}" for _ in range(n)]
        for _ in range(r.randrange(5)):  # periodic stretches, some inside each other, some broken by a word
            p, at = r.choice((1, 2, 3, 5, 8, 21)), r.randrange(n)
            stretch = r.randrange(10, 120)
            words[at : at + stretch] = [words[(at + i % p) % n] for i in range(len(words[at : at + stretch]))]
            words[r.randrange(len(words))] = "x"
        texts.append(" ".join(words))
    got = found(texts)
    assert got == [brute_runs(t.split()) for t in texts]
    assert sum(map(len, got)) > 100 and any(len({q for *_, q in g}) > 2 for g in got)


def test_counts_of_heavy_and_light_words_equal_pairs():
    r = random.Random(5)
    docs = [[r.choice("aaaaaaaab") + r.choice(("", "", "", str(r.randrange(50)))) for _ in range(n)] for n in (700, 30, 24, 3000)]
    flat, sizes = [w for d in docs for w in d], np.array([len(d) for d in docs])
    ids = {w: k for k, w in enumerate(sorted(set(flat)))}
    word = np.array([ids[w] for w in flat])
    counts, base = periodic_runs.lag_counts(np.repeat(np.arange(4), sizes), word, sizes)
    heavy = max(docs[3].count(w) for w in ids)
    assert heavy > np.sqrt(2 * 3000 * np.log2(3000))
    for k, d in enumerate(docs):
        w = np.array([ids[x] for x in d])
        assert counts[base[k] : base[k + 1]].tolist() == [0] + [int((w[p:] == w[:-p]).sum()) for p in range(1, len(d) // 3 + 1)]


def test_long_texts_of_few_words_are_not_quadratic():
    r, began = random.Random(7), time.time()
    one, two = "a " * 300_000, " ".join(r.choice("ab") for _ in range(100_000))
    got = found([one])[0]
    assert got == [(0, 300_000, 1)]
    assert found([two + " c" + " x y z" * 30_000])[0][-1] == (100_001, 90_000, 3)
    assert time.time() - began < 60


def test_runs_of_odd_rows(spark):
    long = "one two three four five " * 40_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 12 + "a"), (4, "a b " * 12 + "a"), (None, "x " * 24), (5, "x " * 23), (6, long), (7, "a\u00a0b " * 30), (8, "p q r " * 8 + "p q s " * 8), (9, "a b a c\x0b\x0ca  b\td " + "k " * 30 + "m " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("start", "runs", "n", "word")})
    out = periodic_runs.find_runs(docs)
    assert out.columns == ["doc_id", "text", "n", "word", *periodic_runs.FIELDS.names]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed))
    none = (0, None, None, None, None)
    assert got[1] == got[2] == got[3] == [(*none, "")]
    assert got[4] == [(1, 0, 25, 2, 12500, "a b")] * 2 and got[None] == [(1, 0, 24, 1, 24000, "x")] and got[5] == [(*none, " ".join("x" * 23))]
    assert got[6] == [(1, 0, 200_000, 5, 40_000_000, "one two three four five")] and got[7] == [(1, 0, 30, 1, 30_000, "a\u00a0b")]
    assert got[8] == [(2, 0, 26, 3, 8666, "p q r s")] and got[9] == [(2, 7, 30, 1, 30_000, "a b a c a b d k m")]
    assert periodic_runs.find_runs(docs.where("false")).count() == 0


def test_planted_periods(spark):
    """Word by word as the contract says."""
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, "a b"), (-5, "one"), (12, None), *((k, "u v w x y") for k in range(1000, 1060))], docs.schema))
    space, changed = re.compile(r"[^\x20\x09-\x0D]+"), 0
    for (i, text), (_, new) in zip(((r.doc_id, r.text) for r in docs.collect()), planted_periods(docs).collect()):
        words = space.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, changed = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)], changed + 1
            assert new == " ".join(words)
        else:
            assert new == text
    assert changed > 80


# clustering


def brute_clusters(rows, k=8, rounds=10, dim=64, scale=1024):
    whole = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(whole, key=lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in seeds]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in whole]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(whole, own) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, nearest(v)[1], nearest(v)[0], sha256(",".join(map(str, centroids[nearest(v)[1]])).encode()).hexdigest()) for i, v in whole), key=str)


def test_clusters_equal_brute_force_on_odd_rows(spark):
    r = random.Random(2)
    rows = [(k, [r.choice((-0.5, -0.001, 0.0, 0.3, 2.0)) + (k % 5) for _ in range(6)]) for k in range(60)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (100, None), (101, []), (102, [1.0] * 5), (103, [1.0] * 7), (104, [None] + [1.0] * 5), (105, [float("nan")] + [1.0] * 5), (106, [float("inf")] + [0.0] * 5), (107, [-0.0] * 6)]
    rows += [(200 + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for k in range(300)]  # a vector that a large part of the rows is
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit("x"), "cluster": F.lit(7), "n": F.lit(None).cast("int")})
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_clusters(f32, dim=6, k=8)
    for parts in (1, 7):
        got = centroid_clustering.cluster(vectors.repartition(parts), dim=6).collect()
        assert sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got), key=str) == want
        assert {r.inertia for r in got} == {sum(w[2] for w in want)}
        for c in {r.cluster for r in got}:
            assert {r.cluster_inertia for r in got if r.cluster == c} == {sum(w[2] for w in want if w[1] == c)}
    few = centroid_clustering.cluster(vectors.where("vec_id in (3, 4, 100)"), dim=6).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(3, 0), (4, 0)] and len({r.cluster for r in few}) == 2
    assert centroid_clustering.cluster(vectors.where("false")).count() == 0
    assert centroid_clustering.cluster(vectors.where("vec_id = 105"), dim=6).count() == 0


def test_annulus_gives_the_nearest_and_compares_fewer():
    rng = np.random.default_rng(4)
    for size in (50, 1 << 25):
        c = rng.integers(-size, size, (40, 8)) * rng.integers(1, 6, (40, 1))
        x = np.concatenate([c[rng.integers(0, 40, 2000)] + rng.integers(-size // 20, size // 20, (2000, 8)), c, (c[:-1] + c[1:]) // 2])
        c[7], c[8] = c[6], -c[9]  # equal centroids, equal norms
        best, least, compared = centroid_clustering.assign(x, c)
        d = ((x[:, None, :].astype(object) - c[None]) ** 2).sum(axis=2)
        assert best.tolist() == d.argmin(axis=1).tolist() and least.tolist() == d.min(axis=1).tolist()
        assert compared < 0.6 * d.size


def test_vectors_that_do_not_fit_are_left_out(spark):
    rows = [(1, [3e38, 0.0]), (2, [131072.0, 0.0]), (3, [0.0, 0.0]), (4, [-131072.0, 0.5])]
    got = centroid_clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=1, rounds=0, dim=2).collect()
    assert sorted(r.vec_id for r in got) == [2, 3, 4]
    assert {r.inertia for r in got} <= {None, sum(r.distance for r in got)}


@pytest.mark.parametrize("size", [SF, "/root/testdata/sf0.001"])
def test_clustering_query_equals_brute_force(spark, size):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{size}/embeddings.parquet").collect()]
    got = [(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in QUERIES["op13_centroid_clustering"](spark, size).collect()]
    assert sorted(got, key=str) == brute_clusters(rows)

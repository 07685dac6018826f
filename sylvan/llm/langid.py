"""Language identification by multilingual mixture inference.

A document is a bag of hashed character n-grams drawn from a mixture of languages. Expectation-
maximisation estimates the proportions; languages enter in the order of their proportions in
the full mixture for as long as the likelihood, less ``PENALTY`` * log(n) a language, rises.
The prediction is the language with the largest proportion in the chosen set and the score
is that proportion.

N-gram models come from the labelled rows the caller gives. ``MAX_TRAIN`` bounds them: about as
many whole documents a language, chosen by their content (``sample_by_content``), so that equal
tables give equal models. All models together take ``MODEL_BYTES`` at most: up to 512 languages
have ``BUCKETS`` buckets each, twice as many languages half of them, and so on. Texts that
are null or hold no letter (Unicode category L) are ``und`` with score 0, as is everything if
nothing was learned from. Of equal proportions the language first in code-point order counts
as larger. Rows that repeat are predicted alike; an empty table gives an empty table; very
long texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, sample_by_content

#: Documents learned from for each language; hash buckets of n-grams; bytes of all models together.
MAX_TRAIN, BUCKETS, MODEL_BYTES = 2000, 1 << 16, 128 << 20
PENALTY, ROUNDS, SETTLED = 8.0, 40, 1e-4
ORDERS = (2, 3)
UND = "und"
_LATIN = re.compile("[A-Za-z]")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str) -> bool:
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def grams(text: str, buckets: int) -> np.ndarray:
    """Bucket of every n-gram of the lower-cased text; runs of code points below 170 other than a-z are one space."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c < 97) | ((c > 122) & (c < 170)), np.uint32(32), c)
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))].astype(np.uint64)
    out, key = [], c
    for n in range(2, max(ORDERS) + 1):
        key = (key[:-1] * _MUL) ^ c[n - 1 :]
        if n in ORDERS:
            out.append(((key * _MUL) >> np.uint64(40)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64)


def em(counts: np.ndarray, like: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of a mixture; ``like`` is n-grams by languages."""
    share, n = np.full(like.shape[1], 1 / like.shape[1]), counts.sum()
    for _ in range(rounds if like.shape[1] > 1 else 0):
        joint = like * share
        new = (counts / joint.sum(axis=1)) @ joint / n
        done = np.abs(new - share).max() < SETTLED
        share = new
        if done:
            break
    return share, float(counts @ np.log(like @ share))


def infer(text: str, logs: np.ndarray) -> tuple[list[int], list[float]]:
    """The chosen languages and their proportions, largest first."""
    ids = grams(text, logs.shape[1])
    if len(ids) > 20_000:
        full = np.bincount(ids, minlength=logs.shape[1])
        buckets = np.flatnonzero(full)
        counts = full[buckets].astype(float)
    else:
        buckets, counts = np.unique(ids, return_counts=True)
        counts = counts.astype(float)
    part = logs[:, buckets].T.astype(float)
    like = np.exp(part - part.max(axis=1, keepdims=True))
    share, _ = em(counts, like)
    order = np.argsort(-share, kind="stable")
    best, chosen = None, None
    for k in range(1, len(order) + 1):
        sub, ll = em(counts, like[:, order[:k]])
        worth = ll - PENALTY * k * np.log(counts.sum())
        if best is not None and worth <= best:
            break
        best, chosen = worth, sub
    ranked = np.argsort(-chosen, kind="stable")
    return [int(order[r]) for r in ranked], [float(chosen[r]) for r in ranked]


def learn(labelled: DataFrame, text: str = "text", label: str = "lang", max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket) from rows with a text and a label."""
    labelled = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("lang"))
    langs, buckets = sorted(r["lang"] for r in labelled.select("lang").distinct().collect()), BUCKETS  # languages are a closed set
    while 4 * buckets * len(langs) > MODEL_BYTES and buckets > 1:
        buckets //= 2
    if not langs:
        return [], np.empty((0, 1))
    number = {x: i for i, x in enumerate(langs)}
    picked = sample_by_content(labelled, max_train, ("lang",))

    def count(frames):
        total = np.zeros((len(langs), buckets), np.int64)
        for f in frames:
            for t, lang in zip(f["text"], f["lang"]):
                if has_letter(t):
                    total[number[lang]] += np.bincount(grams(t, buckets), minlength=buckets)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j]})

    # at most languages x buckets rows, which MODEL_BYTES bounds
    got = picked.mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((len(langs), buckets), 0.5)
    total[got["i"], got["j"]] += got["n"]
    return langs, np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32)


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score, and the chosen langs and shares."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        langs, logs = shared.value

        def one(t):
            if not t or not langs or not has_letter(t):
                return UND, 0.0, [], []
            who, shares = infer(t, logs)
            return langs[who[0]], min(1.0, shares[0]), [langs[w] for w in who], shares

        return one

    return map_text(docs, text, [c for c in (keep or docs.columns) if c not in FIELDS.names], FIELDS, start)


def held_out():
    """Rows that nothing is learned from: crc32(doc_id as text) mod 5 is 0, or there is no doc_id (as in ``lm_score``)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))

"""Secret scanning with a random forest that removes false positives.

Candidates are unbroken strings of 16 characters or more of keys, numbers, mail addresses and
paths that hold a digit, values after an assignment to a name that speaks of secrets, and known
key formats of any length. Each gets features: length, digit share, changes of character class, entropy, dictionary coverage (the
share of it in words that are frequent in the whole corpus), its path (a hash of the source and
whether it is a URL, a file or an email part), and its neighbouring words (whether they name
secrets, digests, identifiers or examples). A random forest trained on labelled findings gives
the probability that the candidate is a secret.

Labelled findings are rows of features and a label. Where none are given, ``generated`` writes
them: short texts with one planted string each, secret or not by the way it was made (random
keys and passwords under many kinds of names, against digests, identifiers, placeholders,
versions, mail and paths, at times under a secret's name too). The label is the generator's, not
a function of the features, so the forest weighs them. Training takes about ``MAX_TRAIN``
labelled findings of each label, chosen by hash, and both labels weigh the same in it however
rare one is. ``held_out_quality`` measures the forest on generated findings it has not seen.

Null, empty and clean texts give no rows; repeated rows give their findings as often; an empty
table gives an empty table. Texts and candidates are read whole whatever their length; of two
candidates that overlap the first and longer one counts, and a probability of just 0.5 is no secret.
Columns other than ``doc_id``, ``source`` and the text are neither read nor returned.
"""

from __future__ import annotations

import re
import zlib
from math import log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lm_score
from .common import map_text, materialize

MAX_TRAIN, GENERATED, TREES, DEPTH = 20_000, 12_000, 30, 9
PATHS = 8
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/=.@-])[A-Za-z0-9_+/=.@-]{15,}[A-Za-z0-9_+/=-](?![A-Za-z0-9_+/=@-])")
_DIGIT = re.compile(r"[0-9]")
_ASSIGN = re.compile(r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api_?key|access_?key|private_?key|auth)\w{0,16}[\x20\"']{0,2}[:=][\x20\"']{0,2}([^\s\"',;]{8,})")
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,})")
_SECRET = re.compile(r"(?i)pass|pwd|secret|token|key|auth|cred")
_DIGEST = re.compile(r"(?i)sha\d*|md5|digest|checksum|commit|hash|etag")
_IDENT = re.compile(r"(?i)uuid|guid|\bid\b|version|build|serial|isbn")
_EXAMPLE = re.compile(r"(?i)example|sample|dummy|placeholder|test|xxxx|your[_-]")
_RUNS = re.compile(r"[A-Za-z]{3,}")
FEATURES = ["length", "digits", "changes", "entropy", "dictionary", "secret_word", "digest_word", "id_word", "example_word", "assigned", "known_format", "in_url", "in_path", "in_mail", "path"]


def candidates(text: str | None) -> list[tuple[int, int, bool]]:
    """(start, end, assigned) in order; candidates that overlap are one, assigned if one of them is."""
    if not text:
        return []
    named = {m.span(1) for m in _ASSIGN.finditer(text)}
    known = [m.span() for m in _KNOWN.finditer(text)]
    plain = [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0]) or _KNOWN.search(m[0])]
    out = []
    for s, e in sorted({*named, *known, *plain}, key=lambda x: (x[0], -x[1])):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2] or (s, e) in named)
        else:
            out.append((s, e, (s, e) in named))
    return out


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(text: str, s: int, e: int, assigned: bool, source: str | None, dictionary: np.ndarray) -> list[float]:
    x, left, right = text[s:e], text[max(0, s - 40) : s], text[e : e + 20]
    n = len(x)
    share = np.unique(list(x), return_counts=True)[1] / n
    words = [m[0] for m in _RUNS.finditer(x)]
    hashes = np.array([xxhash.xxh3_64_intdigest(w.lower().encode()) | 1 << 20 for w in words], np.uint64)
    at = np.minimum(np.searchsorted(dictionary, hashes), max(len(dictionary) - 1, 0))
    covered = sum(len(w) for w, h, k in zip(words, hashes, at) if len(dictionary) and dictionary[k] == h)
    return [
        float(n), sum(c.isdigit() for c in x) / n, sum(_class(a) != _class(b) for a, b in zip(x, x[1:])) / n, float(-sum(p * log2(p) for p in share)), covered / n,
        *(float(bool(r.search(left))) for r in (_SECRET, _DIGEST, _IDENT)), float(bool(_EXAMPLE.search(left + x))), float(assigned), float(bool(_KNOWN.search(x))),
        float("://" in left), float(left[-1:] in ("/", "\\", ".")), float("@" in left[-1:] + x + right[:1]), float(zlib.crc32((source or "").encode()) % PATHS),
    ]


_FOUND = T.StructType([T.StructField("found", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("features", T.ArrayType(T.DoubleType()))])))])


def dictionary_of(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Hashes of the words that are frequent in all of ``docs``."""
    words = docs.select("doc_id", F.col(text).alias("text"), F.lit(True).alias("learn"))
    chars = words.agg(F.sum(F.length("text"))).first()[0] or 0
    batches = words.mapInArrow(lm_score._tokenise, lm_score._TOKENS).select("key", "docs", "words", "at")
    _, _, top, _ = lm_score.vocabulary(batches, max(4, -(-chars // lm_score.SHARD_CHARS)))
    return top


def findings(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), dictionary: np.ndarray | None = None) -> DataFrame:
    """One row a candidate: ``keep``, start, end, features."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary_of(docs, text) if dictionary is None else dictionary)

    def start():
        dictionary = shared.value

        def one(row):
            t = row["t"]
            return ([{"start": s, "end": e, "features": features(t, s, e, a, row["s"], dictionary)} for s, e, a in candidates(t)],)

        return one

    source = F.col("source") if "source" in docs.columns else F.lit(None)
    both = docs.withColumn("__in", F.struct(F.col(text).alias("t"), source.cast("string").alias("s")))
    return map_text(both, "__in", list(keep), _FOUND, start).select(*keep, F.explode("found").alias("f")).select(*keep, "f.*")


#: What generated findings are made of.
_NEUTRAL = "the of and to in we set up for with from this that run file value line data when into last note page user team part then".split()
_NAMES = "password passwd pwd secret token api_key apikey access_key private_key auth_token client_secret db_password SECRET_KEY GITHUB_TOKEN AUTH".split()
_PLAIN = "name path file color size node label region host theme cache_key sort_key primary_key max_tokens token_count author keyboard".split()
_CUES = "commit sha1 sha256 md5 checksum digest etag hash uuid id build version serial isbn guid revision".split()
_FAKES = "your_api_key_goes_here1 example-token-123456 xxxxxxxxxxxxxxxx12 test_password_1234 sample-secret-0000 placeholder_value_1 dummy-key-11111111".split()


def generated_finding(number: int) -> tuple[str, int, int, int]:
    """(text, start, end, label) of one planted string; a function of ``number``."""
    from random import Random

    r = Random(number)
    some = lambda chars, lo, hi: "".join(r.choices(chars, k=r.randint(lo, hi)))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa = lambda n: some("0123456789abcdef", n, n)
    words = lambda lo, hi: " ".join(r.choices(_NEUTRAL, k=r.randint(lo, hi)))
    op, quote, label = r.choice((" = ", "=", ": ", ":")), r.choice(('"', "'", "")), r.randint(0, 1)
    if label:
        kind = r.randrange(6)
        if kind < 3:  # a random value under a telling name
            value = r.choice((lambda: hexa(r.choice((32, 40, 64))), lambda: some(lower + upper + digit, 16, 48), lambda: some(lower + upper + digit + "+/", 24, 80) + "==", lambda: some(lower + upper + digit + "!$%&*#", 8, 20), lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}"))()
            left = r.choice(_NAMES) + r.choice(("", "_1", "_prod")) + op + quote
        elif kind == 3:  # a known format anywhere
            value, quote = r.choice((lambda: "AKIA" + some(upper + digit, 16, 16), lambda: "ghp_" + some(lower + upper + digit, 36, 36), lambda: "sk-" + some(lower + upper + digit, 24, 48), lambda: "xoxb-" + some(digit, 10, 12) + "-" + some(lower + digit, 16, 24), lambda: "eyJ" + some(lower + upper + digit, 20, 60) + "." + some(lower + upper + digit, 40, 120) + "." + some(lower + upper + digit + "_-", 30, 43)))(), ""
            left = r.choice(("key ", "see ", "with ", "using ", ""))
        elif kind == 4:  # in a header or an address
            value, quote = some(lower + upper + digit, 20, 60), ""
            left = r.choice(("Authorization: Bearer ", "auth: ", "?access_token=", "&api_key=", "token "))
        else:  # a name that says nothing
            value, left = some(lower + upper + digit + "+/", 32, 64), r.choice(_PLAIN) + op + quote
    else:
        kind = r.randrange(7)
        if kind < 2:  # digests and identifiers named so
            value, left = r.choice((lambda: hexa(r.choice((32, 40, 64))), lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: some(digit, 16, 20)))(), r.choice(_CUES) + r.choice((" ", ": ", " = ", "-")) + quote
        elif kind == 2:  # placeholders under telling names
            value, left = r.choice(_FAKES), r.choice(_NAMES) + op + quote
        elif kind == 3:  # plain settings
            value, left = r.choice((lambda: "_".join(r.choices(_NEUTRAL, k=4)) + some(digit, 1, 3), lambda: f"{r.randint(1, 30)}.{r.randint(0, 20)}.{r.randint(0, 99)}-" + "-".join(r.choices(_NEUTRAL, k=3)), lambda: some(digit, 16, 30)))(), r.choice(_PLAIN) + op + quote
        elif kind == 4:  # mail and paths
            value, quote = r.choice((lambda: f"{some(lower, 4, 9)}.{some(lower, 4, 9)}{some(digit, 1, 3)}@{some(lower, 5, 9)}.example.com", lambda: "/".join(["", *r.choices(_NEUTRAL, k=5)]) + some(digit, 1, 4)))(), ""
            left = r.choice(("mail ", "at ", "see https:/", ""))
        elif kind == 5:  # digests and numbers in running text
            value, quote, left = r.choice((lambda: hexa(40), lambda: some(digit, 16, 24), lambda: "-".join(some(digit, 4, 4) for _ in range(4))))(), "", ""
        else:  # words run together, as in markup and code
            value, left = "".join(w.capitalize() for w in r.choices(_NEUTRAL, k=6)) + some(digit, 1, 2), r.choice(_PLAIN) + op + quote
    before = f"{words(3, 9)} {left}"
    return f"{before}{value}{quote} {words(3, 9)}", len(before), len(before) + len(value), label


def generated(spark, dictionary: np.ndarray, first: int = 0, n: int = GENERATED) -> DataFrame:
    """``n`` labelled findings (features, label) from generated texts; a planted string that is no
    candidate gives none."""

    def make(frames):
        for f in frames:
            out = []
            for k in f["id"]:
                text, start, end, label = generated_finding(k)
                out += [(features(text, s, e, a, f"gen{k % 50}", dictionary), float(label)) for s, e, a in candidates(text) if s < end and start < e]
            yield pd.DataFrame(out, columns=["features", "label"])

    return spark.range(first, first + n, 1, 4).mapInPandas(make, "features array<double>, label double")


def training_sample(given: DataFrame, max_train: int) -> tuple[dict[float, int], DataFrame]:
    """How many rows of each label ``given`` (features, label) has, and about ``max_train`` rows of
    each label. Of n equal rows the label's share of n is taken, rounded up or down by a hash."""
    given = materialize(given.groupBy("features", F.col("label").cast("double").alias("label")).agg(F.count("*").alias("n")), "labelled")
    sizes = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    share, scale = F.lit(1.0), 1 << 30
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, max_train / n)).otherwise(share)
    taken = F.floor(F.col("n") * share + F.pmod(F.xxhash64("features", F.lit(5)), F.lit(scale)) / scale)
    return sizes, given.withColumn("taken", taken).where("taken > 0").select("features", "label", F.explode(F.sequence(F.lit(1).cast("long"), "taken")).alias("copy")).drop("copy")


def train(given: DataFrame, max_train: int = MAX_TRAIN):
    """The forest over labelled findings, or the one label there is (0.0 if none)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    sizes, given = training_sample(given.where(F.col("label").isNotNull()).select("features", "label"), max_train)
    kinds = sorted(sizes)
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    given = materialize(given, "sample")
    drawn = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    if missing := [k for k in kinds if k not in drawn]:
        raise ValueError(f"no finding labelled {missing} was drawn for training; raise max_train")
    weight = F.lit(0.0)
    for label, n in drawn.items():
        weight = F.when(F.col("label") == label, sum(drawn.values()) / (len(drawn) * n)).otherwise(weight)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False, weightCol="weight")
    return forest.fit(given.select(array_to_vector("features").alias("features"), "label", weight.alias("weight")))


def judged(found: DataFrame, model) -> DataFrame:
    """``found`` with probability and is_secret instead of features."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kept = [c for c in found.columns if c != "features"]
    if isinstance(model, float):
        return found.select(*kept, F.lit(model).alias("probability"), F.lit(model > 0.5).alias("is_secret"))
    out = model.transform(found.withColumn("features", array_to_vector("features")))
    p = vector_to_array("probability")[1]
    return out.select(*kept, p.alias("probability"), (p > 0.5).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, start, end (code points), probability and is_secret for each candidate.

    ``labelled`` has features and label; without it generated findings are used. With labels
    of one kind only, every candidate gets that label's probability.
    """
    dictionary = dictionary_of(docs, text)
    model = train(generated(docs.sparkSession, dictionary) if labelled is None else labelled, max_train)
    return judged(findings(docs, text, dictionary=dictionary), model)


def held_out_quality(spark, dictionary: np.ndarray, model, first: int = 10_000_000, n: int = 2000) -> tuple[float, float]:
    """(precision, recall) on generated findings that training does not use."""
    row = judged(generated(spark, dictionary, first, n), model).agg(
        F.sum(F.when(F.col("is_secret"), F.col("label"))).alias("hit"), F.sum(F.col("is_secret").cast("int")).alias("said"), F.sum("label").alias("true")
    ).first()
    return (row["hit"] or 0.0) / max(row["said"] or 0, 1), (row["hit"] or 0.0) / max(row["true"] or 0.0, 1.0)

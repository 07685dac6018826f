"""URL filter: lists of rules, and logistic regression on character n-grams for what no rule covers.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, the path
what follows it up to ``?``, ``#`` or the end; both are empty for a null URL or one without ``://``. A rule
(action, host, path) fits its host and all subdomains if the path starts with the rule's. The
longest rule that fits decides; of equally long ones the first by code point, block before allow.

The model sees the character n-grams (N sizes) of the host between two marks and of the path,
both hashed into BUCKETS columns, and nothing else. It is trained on labelled URLs: a table with
url and block (boolean, null: no label) where one is given, and else what the rules say of the
table itself, which carries their judgement over to hosts and paths that resemble those listed.
Each (host, path) with one label counts once, however often it occurs; one with both labels
counts for both. About MAX_LABELLED of each label are drawn by hash, and both labels weigh the
same. With one label only, every URL gets it; without any, all are allowed. A probability of just
0.5 is no block. Loss sums of rounds depend on the order in which tasks end, in their last digits.

Null and empty URLs are judged by the model as texts without n-grams; URLs are read whole
whatever their length; repeated rows give equal results; an empty table gives an empty table;
columns named like the added ones are replaced, all others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: (action, host, path) that op11 is to apply (fixed values).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
N, BUCKETS, MAX_LABELLED, REGULARISATION, ROUNDS = (2, 3, 4, 5), 1 << 16, 10_000, 1e-4, 60
ADDED = ["host", "path", "rule", "verdict", "score"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def deciding(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct (rule, action) of the rule that decides, null if none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0] != "block"))
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, name, start in reversed(order):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def features(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with the vector ``features``."""
    from pyspark.ml.feature import HashingTF, NGram

    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    marked = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.lit("^")), chars(F.col("host")), F.array(F.lit("$"))))
    out = urls.withColumns({"__host": marked, "__path": F.transform(chars(F.col("path")), lambda x: F.concat(F.lit("/"), x))})
    made = []
    for side in ("__host", "__path"):
        for n in N:
            made.append(f"{side}{n}")
            out = NGram(n=n, inputCol=side, outputCol=made[-1]).transform(out)
    out = out.withColumn("__grams", F.concat(*made))
    out = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="features").transform(out)
    return out.drop("__host", "__path", "__grams", *made)


def sample(labelled: DataFrame, most: int) -> DataFrame:
    """(host, path, label, weight): about ``most`` different rows of each label by hash, both labels of the same weight."""
    each = materialize(labelled.where("label is not null").select("host", "path", F.col("label").cast("double").alias("label")).distinct(), "labelled")
    share, scale = F.lit(1.0), 1 << 30
    for r in each.groupBy("label").count().collect():
        share = F.when(F.col("label") == r["label"], min(1.0, most / r["count"])).otherwise(share)
    drawn = materialize(each.where(F.pmod(F.xxhash64("host", "path", F.lit(11)), F.lit(scale)) < F.ceil(share * scale)), "drawn")
    n = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    weight = F.lit(0.0)
    for label, rows in n.items():
        weight = F.when(F.col("label") == label, sum(n.values()) / (len(n) * rows)).otherwise(weight)
    return drawn.withColumn("weight", weight)


def train(labelled: DataFrame, most: int = MAX_LABELLED):
    """The model over (host, path, label 0/1), or the one label there is (0.0 if none)."""
    from pyspark.ml.classification import LogisticRegression

    drawn = sample(labelled, most)
    kinds = sorted(r["label"] for r in drawn.select("label").distinct().collect())
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    return LogisticRegression(regParam=REGULARISATION, standardization=False, maxIter=ROUNDS, weightCol="weight").fit(features(drawn))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, url: str = "url", most: int = MAX_LABELLED) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits), verdict (allow or block: the rule's, else the
    model's) and score, the model's probability of block."""
    from pyspark.ml.functions import vector_to_array

    def parted(df: DataFrame, kept: list[str]) -> DataFrame:
        host, path = host_and_path(df[url])
        return df.select(*kept, host.alias("host"), path.alias("path"))

    kept = [c for c in pages.columns if c not in ADDED]
    own = parted(pages, kept).withColumn("__by", deciding(F.col("host"), F.col("path"), rules))
    if labelled is None:
        given = own.select("host", "path", (F.col("__by.action") == "block").alias("label"))
    else:
        given = parted(labelled, ["block"]).withColumnRenamed("block", "label")
    model = train(given, most)
    if isinstance(model, float):
        scored = own.withColumn("score", F.lit(model))
    else:
        scored = model.transform(features(own)).withColumn("score", vector_to_array("probability")[1])
    by_model = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select(*kept, "host", "path", F.col("__by.rule").alias("rule"), F.coalesce("__by.action", by_model).alias("verdict"), "score")

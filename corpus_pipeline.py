"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and
returns a DataFrame that ``run`` writes as Parquet and reads again as the next one's docs.
All but the last return the columns of ``documents``:

* ``language_id`` drops documents without a language (``und``) and those in which no language holds
  MIN_SHARE of the n-grams;
* ``line_dedup`` takes lines found in ten or more documents out of all of them;
* ``ngram_join`` keeps one document of each near-duplicate group (the smallest doc_id);
* ``decontaminate`` drops documents with a passage of a benchmark item;
* ``mix`` returns doc_id, source, size, source_size, target and taken for what is left.

The columns that an operator adds never meet those of ``docs``: a column that has such a name is
put aside before and comes back as it was. Null or empty texts are ``und`` and go in the first stage; rows with a null
doc_id are not learned from, and are near-duplicates like any others; of rows that tie on doc_id those of one class
stay or go together; very long texts are read whole; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import decontaminate as contamination
from sylvan.llm import langid, line_dedup, mixing, ngram_join
from sylvan.llm.common import table
from sylvan.plans.ground import shared_dir

MIN_SHARE = 0.4


def _aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the columns named like ``taken`` renamed, and the expressions that undo it."""
    names = {c: f"__aside_{c}" for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.where(~langid.held_out()))
    docs, back = _aside(docs, *langid.FIELDS.names)
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SHARE)).select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = _aside(docs, *line_dedup.ADDED)
    out = line_dedup.line_dedup(docs).select(*back)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = _aside(docs, *contamination.ADDED)
    found = contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), spans=False)
    return found.where(~F.col("contaminated")).select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("ngram_join", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: Language identification and near-duplicate groups after it are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

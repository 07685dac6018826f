"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering, decontaminate, embed_dedup, langid, line_dedup, lm_score, mixing, ngram_join, periodic_runs, pii_crf, secret_scan, url_filter, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.read_archive(*warc.write_archive(table(spark, sf_dir, "pages")))
    return archive.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(table(spark, sf_dir, "documents"), lm_score.held_out())
    # the last digits depend on the order of the sums
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_crf.find(docs, pii_crf.learn(docs), keep=["doc_id"]).drop("pii")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.identify(docs, model, keep=["doc_id"]).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "first_slot")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which each tenth text, by h = crc32(doc_id), repeats p of its words from word a
    on: g = h / 10, a = g mod n, p = 1 + (n - a) / (3 + g mod 8), in whole numbers. A null doc_id
    has no h, and its text stays."""
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("w")
    own = docs.select("doc_id", "text", h.alias("h"))
    own = own.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    own = own.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    own = own.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times)), F.lit(1), n - F.col("a"))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return own.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(planted_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_secret_scan, op3_lm_scoring, op4_pii, op5_embedding_near_dedup, op6_ngram_jaccard_join, op7_language_id, op8_line_dedup, op9_mixing, op10_decontaminate, op11_url_filter, op12_periodic_runs, op13_centroid_clustering)}

"""The queries against SQL, and the pipeline against its parts on whole tables."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from sylvan.llm import decontaminate, ngram_join
from sylvan.llm.queries import QUERIES
from sylvan.llm.sql import SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    plain = lambda r: tuple(round(float(r[c]), 5) if isinstance(r[c], float) else r[c] for c in sorted(cols))
    assert sorted(map(str, (plain(dict(zip(cols, r))) for r in want.fetchall()))) == sorted(map(str, (plain(r.asDict()) for r in got.collect())))


def test_pipeline(spark, docs, small):
    seen, at = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, small).cache()
        seen.append((name, at, out))
        at = out
    for _, _, out in seen[:-1]:
        assert out.columns == docs.columns
    by = {name: (a.toPandas(), b.toPandas()) for name, a, b in seen}
    before, after = by["language_id"]
    assert len(after) >= 0.99 * len(before)
    before, after = by["line_dedup"]
    lines, frequent = {}, set()
    for i, t in zip(before["doc_id"], before["text"]):
        for key in {x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})) for x in t.split("\n")}:
            lines.setdefault(key, set()).add(i)
    frequent = {k for k, v in lines.items() if k and len(v) >= 10}
    want = {i: "\n".join(x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})) not in frequent) for i, t in zip(before["doc_id"], before["text"])}
    assert dict(zip(after["doc_id"], after["text"])) == want
    before, after = by["ngram_join"]
    from .test_edges import brute_groups

    groups = brute_groups(list(zip(before["doc_id"], before["text"])))
    assert sorted(after["doc_id"]) == sorted(i for i, (_, g) in groups.items() if i == g)
    before, after = by["decontaminate"]
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    grams = set().union(*(decontaminate.windows_of(w, 10) for w in items))
    clean = [i for i, t in zip(before["doc_id"], before["text"]) if not any(b" " + b" ".join(g) + b" " in b" " + b" ".join(decontaminate.words_of(t)) + b" " for g in grams)]
    assert sorted(after["doc_id"]) == sorted(clean)
    before, after = by["mix"]
    assert sorted(after["doc_id"]) == sorted(before["doc_id"]) and (after["taken"] <= 2 * after["size"]).all()
    for _, g in after.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 1
    assert ngram_join.THRESHOLD == 0.8 and ngram_join.WIDTH == 5


def test_run_gives_the_last_stage(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "source", "size", "source_size", "target", "taken", "n_pieces", "first_slot"]


CLASHING = ("lang_pred", "score", "langs", "shares", "n_lines", "n_dropped", "class_id", "n_links", "kept", "n_words", "items", "contaminated", "spans", "size", "taken", "id", "sig", "table", "key", "h1", "n")


def test_pipeline_stages_on_odd_rows(spark, docs, small):
    """Nulls, empty and very long texts, repeated rows and columns with the operators' names go through every stage; values of such columns stay."""
    rows = [r.asDict() for r in docs.where("lang = 'en' and length(text) between 400 and 3000").limit(12).collect()]
    rows += [dict(rows[0]), rows[1] | {"doc_id": None}, rows[2] | {"text": None}, rows[3] | {"text": "", "source": None}, rows[4] | {"doc_id": 10**6, "text": "½ 12"}]
    rows += [rows[5] | {"doc_id": 10**6 + 1, "text": " ".join(f"the other word{k} of this" for k in range(60_000))}, rows[6] | {"doc_id": None, "source": None, "lang": None, "text": rows[7]["text"] + " and more of it"}]
    at = spark.createDataFrame(rows, docs.schema).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    columns, empty = at.columns, at.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, small).cache()
        assert stage(spark, empty, small).count() == 0
        if name == "mix":
            assert out.count() == at.count()
            break
        assert out.columns == columns
        for r in out.collect():
            assert all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for c in CLASHING)
        at = spark.createDataFrame(out.collect(), out.schema)
    assert at.where("text is null or text = '' or doc_id = 1000000").count() == 0 and at.where("doc_id = 1000001").count() == 1

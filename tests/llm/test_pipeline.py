"""The pipeline's stages, each judged on its own input, and the SQL of the operators that have some."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from terrane.llm import decontaminate, near_dedup, pii, queries

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == docs.columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0, name
        if name == "near_dedup":
            assert near_dedup.near_duplicates(after).where("NOT kept").count() == 0
            groups = near_dedup.near_duplicates(before).where("n_shingles > 0").select("component_id").distinct().count()
            assert after.where(F.regexp_count("text", F.lit(r"\S")) > 0).count() == groups
        if name == "decontamination":
            assert decontaminate.judge(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("NOT contaminated").count() == after.count() < before.count()
        if name == "pii":
            assert after.count() == before.count()
            assert pii.scan(after).where("spans <> ''").count() == 0 < pii.scan(before).where("spans <> ''").count()
            assert after.where("n_chars <> char_length(text)").count() == 0
        before = after
    packed = C.STAGES[-1][1](spark, before, SMALL).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_stage_cases(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, None, 3), (1, text, None, 3), (None, text, "b", None), (None, None, "c", None), (2, "", "d", 0), (4, text + " x", "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("kept", F.lit(1)).withColumn("count", F.lit(2)).withColumn("a.b", F.lit(3))
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    distinct = C.keep_distinct(spark, docs, SMALL)
    assert sorted(str(r["doc_id"]) for r in distinct.collect()) == ["1", "2", "None"]
    assert C.pack_sequences(spark, docs, SMALL).count() == len(rows)


def test_run(spark):
    assert C.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert list(map(repr, sorted(got.astype(str).itertuples(index=False, name=None)))) == list(map(repr, sorted(want.astype(str).itertuples(index=False, name=None)))), key


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_near_dedup", "op3_html_extraction", "op5_pii", "op6_decontamination"])
def test_queries_give_a_row_for_each_row(spark, name):
    table = "pages" if name.startswith("op3") else "documents"
    assert queries.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_texts_of_pages_hold_no_markup(spark):
    rows = queries.op3_html_extraction(spark, SMALL).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any(re.search(r"</?(div|p|span|script)\b", r["text"]) for r in rows)

"""Quality classifier and language identification: their algebra, their cases, and held-out accuracy."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import langid, quality
from terrane.llm.queries import op8_quality_classifier, op9_language_id

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    d = quality.BUCKETS + quality.STATISTICS
    machine = quality.FactorisationMachine(0, 1, 0.3, rng.normal(size=d), rng.normal(size=(d, 3)))
    x = np.zeros((4, d))
    x[:, rng.integers(0, d, 12)] = rng.normal(size=(4, 12))
    for row, margin in zip(x, machine.margin(x)):
        at = np.flatnonzero(row)
        pairs = sum(machine.v[i] @ machine.v[j] * row[i] * row[j] for n, i in enumerate(at) for j in at[:n])
        assert margin == pytest.approx(0.3 + row @ machine.w + pairs)


def auc(y, score):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(y))
    ranks[order] = np.arange(1, len(y) + 1)
    for value in np.unique(score):
        ranks[score == value] = ranks[score == value].mean()
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@needs_tables
def test_quality_on_held_out_documents(spark):
    scored = op8_quality_classifier(spark, SF).toPandas()
    assert (scored["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in scored["doc_id"]]).all()
    assert scored["score"].between(0, 1).all() and (scored["predicted"] == (scored["score"] >= 0.3)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").toPandas()
    met = scored[scored["held_out"]].merge(labels, on="doc_id")
    assert len(met) > 30 and auc(met["quality"].to_numpy(), met["score"].to_numpy()) > 0.85


@needs_tables
def test_languages_of_held_out_documents(spark):
    got = op9_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").toPandas()
    met = got[got["held_out"]].merge(docs.dropna(), on="doc_id")
    met = met[met["text"].map(lambda t: any(c.isalpha() for c in t))]
    assert len(met) > 100 and (met["lang"] == met["lang_pred"]).mean() > 0.95


def test_quality_cases(spark):
    rows = [(k, f"good plain words number {k} and more of them" if k % 2 else "$$$ BUY!!! ### " * (1 + k % 5)) for k in range(80)] + [(200, None), (201, ""), (1, "good plain words"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(3, None), (3, 1), (None, 1), (999, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    fine = got[got["doc_id"] < 80]
    assert ((fine["score"] > 0.5) == (fine["doc_id"] % 2 == 1)).mean() > 0.95
    assert quality.classify(docs, labels.limit(0)).first()["score"] == pytest.approx(0.5)
    assert quality.classify(docs.limit(0), labels).count() == 0
    one, other = quality.train(docs, labels), quality.train(docs.repartition(7).orderBy(F.desc("doc_id")), labels.repartition(3))
    assert np.array_equal(one.w, other.w) and np.array_equal(one.v, other.v) and one.w0 == other.w0
    again = quality.classify(docs.repartition(7), labels).toPandas()
    assert np.allclose(np.sort(got["score"]), np.sort(again["score"]))


def test_very_long_texts_have_the_same_features_in_pieces():
    text = b"word other Third " * 200_000
    bags, stats = quality.features([text])
    short = quality.features([b"word other Third "])[0]
    assert bags.sum() > 0 and np.allclose(bags[0], short[0], atol=1e-6) and stats[0][len(quality._GROUPS) + 1] == pytest.approx(np.log1p(600_000))


def test_language_cases(spark):
    rows = [(k, ("der hund und die katze " if k % 2 else "the dog and the cat ") * (1 + k % 3) + str(k), "de" if k % 2 else "en") for k in range(60)]
    rows += [(100, None, "de"), (101, "", "en"), (102, "123 --- 456", "en"), (104, "½ ² 34", "en"), (105, "Ⅳ ① ٣", "de"), (103, "the dog", None), (103, "the dog", None), (None, "die katze", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(0))
    got = langid.identify(docs).select("doc_id", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    lang = {r["doc_id"]: r["lang_pred"] for r in got}
    assert lang[100] == lang[101] == lang[102] == lang[104] == lang[105] == "und" and lang[103] == "en" and lang[None] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(lang[k] == ("de" if k % 2 else "en") for k in range(60))
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_kernel_of_presences():
    a, b = langid.ngrams("abab"), langid.ngrams("ABAB" * 3)
    assert len(a) == 2 + 2 + 2 + 1 and set(a) <= set(b) and len(langid.ngrams("")) == 0


def test_many_languages_share_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 12)
    monkeypatch.setattr(langid, "LANDMARKS_IN_ALL", 3)
    rows = [(10 * k + i, f"{w} " * 9 + str(i), f"l{k}") for k, w in enumerate(("abc", "def", "ghi", "jkl")) for i in range(10 + (k < 3))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["l0", "l1", "l2", "l3"]


def test_very_long_texts_of_a_language(spark):
    rows = [(k, ("der hund und die katze " if k % 2 else "the dog and the cat ") * 3, "de" if k % 2 else "en") for k in range(40)] + [(99, "der hund und die katze " * 100_000, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id = 99").first()
    assert got["lang_pred"] == "de"

"""Benchmark decontamination against windows looked up one by one."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from terrane.llm import decontaminate as D


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute(docs, items, window, share):
    windows = []
    for item_id, text in items:
        own = words(text)
        width = min(window, len(own))
        windows += [(item_id, tuple(own[i : i + width])) for i in range(len(own) - width + 1) if width]
    out = []
    for doc_id, text in docs:
        own = words(text)
        hit, found = set(), set()
        for item_id, w in windows:
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(found), digest, bool(hit) and share * len(hit) >= len(own)))
    return out


def tables(seed):
    rng = random.Random(seed)
    letters = ["a", "B", "c1", "dé", "E"]
    some = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(k, some(rng.choice([0, 1, 3, 4, 5, 9]))) for k in range(12)] + [(90, None), (91, "..."), (10, "a a a a a a"), (2, "B-B!c1 dé")]
    docs = [(k, some(rng.randrange(60))) for k in range(60)] + [(100, ""), (101, None), (102, "a" * 3000), (103, "B, b; C1 -- DÉ"), (103, "B, b; C1 -- DÉ")]
    return docs, items


@pytest.mark.parametrize("seed, block", [(1, 1 << 24), (2, 1 << 24), (3, 40)])
def test_matches_brute_force(spark, seed, block):
    docs, items = tables(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.judge(frame, bench, window=4, share=2, max_block_bytes=block)
    rows = sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert rows == sorted(brute(docs, items, 4, 2))
    kept = sorted(r["doc_id"] for r in D.remove(frame, bench, window=4, share=2, max_block_bytes=block).collect())
    assert kept == sorted(r[0] for r in rows if not r[5])


def test_matches_are_located(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"one two {item} three"), (2, "q1 q2 q3")], "doc_id long, text string").withColumn("matches", F.lit(0))
    bench = spark.createDataFrame([("7", item)], "item_id string, text string")
    got = {r["doc_id"]: r for r in D.judge(docs, bench).collect()}
    assert [(m["item_id"], m["doc_word"], m["n_words"]) for m in got[1]["matches"]] == [("7", 2, 20)]
    assert got[2]["matches"] == [] and not got[2]["contaminated"]


def test_repeated_words_cost_no_pairs(spark):
    item = "a " * 3000 + "b c d e f g h i j k l m n o p"
    rows = [(1, "a " * 60_000), (2, "a " * 12), (3, "x " * 40 + "a " * 13 + "b y"), (4, "m n o p " * 9)]
    items = [("1", item), ("2", "a " * 500), (None, "a " * 20), ("3", "n o p m")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = D.judge(docs, bench).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "contaminated")) for r in got] == [(1, 60_000, 60_000, 2, True), (2, 12, 0, 0, False), (3, 55, 14, 2, True), (4, 36, 32, 1, True)]
    assert [(m["doc_word"], m["n_words"]) for m in got[0]["matches"]] == [(0, 60_000)] and got[2]["items"] == ["1", "2"]


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(tables(1), ("doc_id long, text string", "item_id long, text string")))
    assert D.judge(docs, items.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    assert D.judge(docs.limit(0), items).count() == 0
    assert D.remove(docs, items.limit(0)).count() == docs.count()

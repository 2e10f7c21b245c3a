"""Shared passages against sets of word windows."""

import random
import re
from collections import defaultdict

import pytest

import __spark_entry__
from terrane.llm import passages as P


def brute(texts, n):
    """Words of each text in windows of n words that another text of the list holds."""
    own = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")) for t in texts]
    held = defaultdict(set)
    for d, w in enumerate(own):
        for i in range(len(w) - n + 1):
            held[tuple(w[i : i + n])].add(d)
    return [len({j for i in range(len(w) - n + 1) if len(held[tuple(w[i : i + n])]) > 1 for j in range(i, i + n)}) for w in own]


def shared(spark, texts, *sizes):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = docs.select("doc_id", P.text_key("text").alias("key")).join(P.shared_words(docs, *sizes), "key", "left")
    return [r["n"] for r in found.selectExpr("doc_id", "coalesce(n_shared_words, 0) n").orderBy("doc_id").collect()]


@pytest.mark.parametrize("seed, words, gram", [(1, 6, 3), (2, 6, 6), (3, 5, 1), (4, 9, 4)])
def test_matches_brute_force(spark, seed, words, gram):
    rng = random.Random(seed)
    some = lambda n, of="a b é c D".split(): [rng.choice(of) for _ in range(n)]
    known = [some(n, [f"w{i}" for i in range(30)]) for n in (words - 1, words, words + 1, 3 * words)]
    own = [rng.choice([" ", "\n", " \t "]).join(sum((rng.choice([some(rng.randrange(8)), rng.choice(known)]) for _ in range(rng.randrange(5))), [])) for _ in range(80)]
    own += ["", None, "a", "a " * 40, "q " * 40, "q " * 30, "z " * 40, own[3], own[3], "  " + own[4], " ".join(known[3] * 2), " ".join(known[1])]
    assert shared(spark, own, words, gram) == brute(own, words)


def test_passage_of_over_50_words_and_less_than_400_bytes(spark, tmp_path):
    rng = random.Random(5)
    some = lambda n: [f"{rng.randrange(10**5):05}" for _ in range(n)]
    over, under = some(51), some(50)
    own = [some(90) + over + some(90), some(40) + over, some(90) + under + some(90), under + some(40), some(300)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(own)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = __spark_entry__.queries()["op1_suffix_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["n_shared_words"] for r in rows] == [51, 51, 0, 0, 0]
    assert [r["n_removed"] for r in rows] == [0] * 5  # the contract's 400 bytes


def test_no_texts(spark):
    assert shared(spark, [None, ""]) == [0, 0]
    assert P.shared_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_shares_with_a_short_one(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr("terrane.llm.text.CHUNK", 256)
    long, other = ([f"{c}{rng.randrange(10**6)}" for _ in range(n)] for c, n in (("l", 4000), ("o", 100)))
    own = [" ".join(long), " ".join(other + long[2000:2060])]
    assert shared(spark, own) == brute(own, P.WORDS) == [60, 60]

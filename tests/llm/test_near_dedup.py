"""Near-duplicates against the comparison of all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import near_dedup as N
from terrane.llm.components import components


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    width = min(n, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()


def brute(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = [top(i) for i in range(len(rows))]
    least = {g: min(rows[i][0] for i in range(len(rows)) if groups[i] == g) for g in groups}
    return sorted((d, len(s), least[g], d == least[g]) for (d, _), s, g in zip(rows, sets, groups))


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "straße", "X Y"]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 40, 90]))]
        out.append(" ".join(base))
        for _ in range(4):  # drifts away: links of links
            base = list(base)
            for _ in range(max(1, len(base) // 40)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append("\n ".join(base) if rng.random() < 0.3 else " ".join(base).upper() if rng.random() < 0.3 else " ".join(base))
    out += ["", None, " \t ", out[3], out[3], "only", "ONLY"]
    ids = rng.sample(range(1000), len(out))
    return list(zip(ids, out))


@pytest.mark.parametrize("seed, n, block", [(1, 2, 250), (2, 5, 3), (3, 2, 2)])
def test_matches_brute_force(spark, seed, n, block):
    rows = rows_of(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = N.near_duplicates(docs, n, block=block).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, n)


def test_clusters_of_several_components_are_joined(spark):
    # Ten texts, each a little off the last: a bucket's smallest class is far from its largest.
    words = [f"v{i}" for i in range(300)]
    rows = [(k, " ".join(words[9 * k : 9 * k + 150])) for k in (4, 9, 0, 7, 2, 5, 1, 8, 3, 6)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, block=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute(rows, 2)
    assert {r["component_id"] for r in got} == {0}


def test_cases(spark):
    text = " ".join(f"u{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text), (1, None)], "doc_id long, text string")
    got = N.near_duplicates(docs.withColumn("kept", F.lit("x")).withColumn("bands", F.lit(1))).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("1", 1, True), ("3", 3, True), ("3", 3, True), ("None", 3, False)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_texts_without_id_bridge_others(spark):
    words = [f"v{i}" for i in range(300)]
    rows = [(7, " ".join(words[:150])), (None, " ".join(words[9:159])), (4, " ".join(words[18:168])), (None, " ".join(words[200:260]))]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("7", "4"), ("None", "4"), ("None", "None")]


def test_distinct_keeps_one_text_of_each_group(spark):
    base = [f"w{i}" for i in range(60)]
    a, b, near_a = " ".join(base), " ".join(f"x{i}" for i in range(60)), " ".join([*base[:59], "end"])
    rows = [(1, a, "p"), (1, a, "p"), (2, a, "q"), (2, b, "r"), (3, near_a, "s"), (4, a + " other", "t"), (4, b, "u"), (None, near_a, "v"), (None, None, "w"), (None, None, "w"), (5, "", "x"), (6, " ".join(f"y{i}" for i in range(9)), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("keeper", F.lit(1)).withColumn("a.b", F.lit(2))
    out = N.distinct(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["kept"]) for r in out.collect()) == [("1", "p"), ("2", "r"), ("5", "x"), ("6", "y"), ("None", "w")]
    assert N.distinct(docs.limit(0)).count() == 0


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
    distance = lambda a, b: int(np.bitwise_count(N.odd_sketch(N.minhashes(a)).view(np.uint64) ^ N.odd_sketch(N.minhashes(b)).view(np.uint64)).sum())
    assert distance(pool, pool) == 0
    assert distance(pool[:1900], pool[100:]) <= N.most_flips(0.8)
    assert distance(pool[:1000], pool[1000:]) > N.most_flips(0.5)


def test_components_of_long_chains_and_stars(spark):
    chain = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1100).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = components(chain.unionByName(star).repartition(6)).groupBy("root").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 301), (1000, 100)]


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long.replace("w7 ", "x7 ")), (3, "word " * 400_000), (4, "word " * 3)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 299_999, 1), (2, 299_999, 1), (3, 1, 3), (4, 1, 3)]

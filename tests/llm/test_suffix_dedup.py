"""Substring deduplication against counting every window."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import suffix_dedup as S

LENGTH, GRAM = 12, 5


def brute(texts, length):
    """(bytes, removed, spans, digest of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    starts = defaultdict(list)
    for d, text in enumerate(raw):
        for i in range(len(text) - length + 1):
            starts[text[i : i + length]].append((d, i))
    gone = [np.zeros(len(t) + 1, bool) for t in raw]
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = []
    for text, g in zip(raw, gone):
        g[len(text)] = False
        rest = bytes(np.frombuffer(text, np.uint8)[~g[: len(text)]])
        spans = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        out.append((len(text), int(g.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    some = lambda n, letters="abcdé ": "".join(rng.choice(letters) for _ in range(n))
    shared = [some(n) for n in (11, 12, 13, 30, 60)]
    out = ["".join(rng.choice([some(rng.randrange(25)), rng.choice(shared), rng.choice(shared)[: rng.randrange(8, 40)]]) for _ in range(rng.randrange(6))) for _ in range(60)]
    out += ["", None, "short", out[5], out[5], "ab" * 40, "z" * 50, "z" * 13, some(12), shared[3] + shared[3], shared[4] * 3]
    out += ["\0" * 70, "x" + "\0" * 30 + "y", "\0" * 12, "q" + "ab" * 7, "abcd" * 20 + "e" + "abcd" * 12, "zz" + "abc" * 30 + some(9), some(9) + "abc" * 30, "abc" * 4]
    return out


@pytest.mark.parametrize("seed, hot", [(1, 1000), (2, 1000), (3, 2), (4, 1), (5, 3)])
def test_matches_brute_force(spark, seed, hot):
    own = texts(seed)
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(5)
    rows = S.strip_repeats(docs, LENGTH, GRAM, hot).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute(own, LENGTH)


def test_cases(spark):
    docs = spark.createDataFrame([(None, "x" * 30, "a"), (1, "y" * 12, "b"), (1, "y" * 12, "b"), (2, None, None)], "doc_id long, text string, kept string")
    rows = S.strip_repeats(docs.withColumn("key", F.lit(1)), LENGTH, GRAM).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 12, 12, 30]
    assert S.strip_repeats(docs.limit(0), LENGTH, GRAM).count() == 0


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    text = bytes(np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8))
    whole = S.anchors(text, 40, 10)
    monkeypatch.setattr(S, "PIECE", 64)
    parts = S.anchors(text, 40, 10)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(4)
    for n in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(20))) for _ in range(n)]
        decoded = [S.front_decoded(*S.front_coded(r)) for r in runs]
        assert [d[0] for d in decoded] == runs
        out = [(runs[r][i], k) for r, i, k in S.LoserTree(decoded)]
        assert [x for x, _ in out] == sorted(x for r in runs for x in r)
        assert all(k == S.shared_prefix(a, b) for (a, _), (b, k) in zip(out, out[1:]))


@pytest.mark.parametrize("text, removed", [(b"a" * 2_000_000, 2_000_000), (b"\0" * 1000, 1000), (b"abcdefg" * 300_000, 2_100_000)])
def test_repeating_texts_keep_few_anchors(text, removed):
    at, codes, runs = S.anchors(text)
    assert len(at) < 10_000
    spans = S._distinct(text, at, codes, S.LENGTH, S.GRAM)[1]
    assert removed - S.LENGTH < sum(b - a for a, b in S._joined(sorted({*runs, *spans}))) <= removed  # the merge finds the ends


def test_repeating_texts_with_production_parameters(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    unit, passage = some(7), some(900)
    own = ["a" * 9000, "\0" * 1000, "\0" * 16 + "q" * 390, unit * 1300, some(300) + unit * 1000 + some(300), "a" * 400, unit * 60, passage + some(50) + passage[100:], some(1000), some(5) + passage[:450], "\0" * 399, "\1" * 401]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    for hot in (S.HOT, 2):
        rows = S.strip_repeats(docs, hot=hot).orderBy("doc_id").collect()
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute(own, S.LENGTH)


def test_windows_inside_and_across_the_ends_of_a_repeating_stretch(spark):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    unit, head, tail = some(5), some(60), some(60)
    stretch = unit * 40
    own = [head + stretch + tail, some(30) + (unit * 4)[2:16] + some(30), head[30:] + stretch[:25] + some(40), some(40) + stretch[-25:] + tail[:30], some(200)]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    rows = S.strip_repeats(docs, LENGTH, GRAM).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute(own, LENGTH)

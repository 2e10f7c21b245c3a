"""Merkle manifests against a tree built with hashlib, row by row."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from terrane.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes):
    """The root, and each node's siblings by level as (before, after)."""
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, at in zip(proofs, own):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            proof.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        own = [at // 8 for at in own]
    return nodes[0], proofs


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(((row[0] is not None, row[0] or 0), leaf_of(row)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: climbed([leaf for _, leaf in sorted(trees[lang])]) for lang in langs}
    root, outer = climbed([built[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, outer):
        for at, ((known, doc_id), leaf) in enumerate(sorted(trees[lang])):
            out.append((doc_id if known else None, at, leaf, built[lang][0], root, tuple(built[lang][1][at] + above)))
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r["doc_id"], r["position"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in frame.collect()), key=repr)


def rows_of(seed, n):
    rng = random.Random(seed)
    langs = ["en"] * 12 + ["de", "fr", "", None, "ß", "z"]
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, rng.choice([None, "", "web"]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", f"Text {i} Äß", "same"])) for i in range(n)]


@pytest.mark.parametrize("seed, n, levels", [(1, 700, 1), (2, 700, 2), (3, 300, 4), (4, 9, 1), (5, 8, 1), (6, 1, 4), (7, 65, 2), (8, 64, 1)])
def test_matches_brute_force(spark, seed, n, levels):
    rows = rows_of(seed, n)
    rows += rows[: n // 3]  # repeated rows
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), levels=levels)) == brute(rows)


def test_many_languages_and_single_leaves(spark):
    rows = [(i, "s", f"l{i % 150}", i, "x") for i in range(160)]
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA), levels=1)) == brute(rows)


def test_folding_finds_what_was_changed(spark):
    rows = rows_of(9, 400)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("leaf", "_tree", "position", "proof", "bucket", "root")})
    shown = merkle.leaf_digest([F.upper("text") if c == "text" else F.col(c) for c in merkle.COLUMNS])
    out = merkle.manifest(frame, F.when(F.col("doc_id") % 5 == 0, shown), levels=2)
    judged = out.select("doc_id", "leaf", "presented", "root", "proof", merkle.folded(F.col("presented"), F.col("proof")).alias("folded"), merkle.proof_digest(F.col("proof")).alias("digest")).collect()
    assert len(judged) == len(rows)
    for r in judged:
        assert (r["folded"] == r["root"]) == (r["presented"] == r["leaf"])
        assert r["digest"] == sha("".join(a + b for a, b in r["proof"]))
    assert any(r["folded"] != r["root"] for r in judged)
    assert merkle.manifest(frame.limit(0)).count() == 0


def test_very_long_text(spark):
    rows = [(1, "s", "en", 1, "Äx" * 2_000_000), (2, None, None, None, None)]
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)

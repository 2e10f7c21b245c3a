"""Packing: tokens equal to the tokenizer's own, and sequences that hold every id once."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [P.END_ID]


def test_tokens_equal_the_tokenizers(plain):
    rng = random.Random(5)
    pools = ["abc DEF'sàÉß 019 .,!?\n\t-", "abß中ï  ́e​… x\r\n", "aÄöŒ'LLs'RE 5½²ª_", "<|endoftext|>startab x"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(120))) for pool in pools for _ in range(150)]
    texts += ["", " ", "I'VE it's ''ll", "<|endoftext|>", "x" * 500, "İstanbul ﬁ Å", "á"]
    got = P.Tokens(PATH).encode(texts)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(plain, text)[:-1], repr(text)


def test_histogram_patterns():
    rng = random.Random(6)
    for _ in range(30):
        counts = Counter(rng.randrange(1, 65) for _ in range(rng.randrange(1, 400)))
        patterns = P.pack_histogram(counts, 64)
        used = Counter()
        for pattern, n in patterns:
            assert n > 0 and sum(pattern) <= 64 and list(pattern) == sorted(pattern, reverse=True)
            for length in pattern:
                used[length] += n
        assert used == counts
        sequences = sum(n for _, n in patterns)
        assert sequences <= 1.3 * -(-sum(k * n for k, n in counts.items()) // 64) + 2
    assert P.pack_histogram({}, 64) == []


def check(rows, docs, plain, most):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = np.array(ids_of(plain, text), "<u4")
        want[doc_id] += [(s, len(ids[s : s + most]), zlib.crc32(ids[s : s + most].tobytes()), len(ids)) for s in range(0, len(ids), most)]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= most
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_pieces_and_sequences(spark, plain):
    rng = random.Random(7)
    docs = [(k, " ".join(rng.choice(["alpha", "beta", "Gamma9", "éa", "δ"]) for _ in range(rng.randrange(200)))) for k in range(300)]
    docs += [(900, ""), (901, None), (902, "one two"), (902, "one two"), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash"))
    rows = P.pack(frame.repartition(5), PATH, max_tokens=64, rank_group=7).collect()
    sequences = check(rows, docs, plain, 64)
    total = sum(len(ids_of(plain, t)) for _, t in docs)
    assert sequences <= 1.05 * total / 64 + 1
    assert P.pack(frame.limit(0), PATH).count() == 0


def test_little_padding():
    rng = np.random.default_rng(4)
    lengths = np.clip(rng.lognormal(6, 1.2, 20_000).astype(int), 1, 40_000)
    counts = Counter()
    for n in lengths.tolist():
        counts[P.MAX_TOKENS] += n // P.MAX_TOKENS
        counts[n % P.MAX_TOKENS] += 1
    counts = Counter({k: n for k, n in counts.items() if k and n})
    sequences = sum(n for _, n in P.pack_histogram(counts, P.MAX_TOKENS))
    assert sequences <= 1.002 * sum(k * n for k, n in counts.items()) / P.MAX_TOKENS + 1

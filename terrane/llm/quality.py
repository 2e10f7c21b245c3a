"""Quality classifier: a factorisation machine on hashed words, structure statistics and the text's size.

score = sigmoid(w0 + w.x + 1/2 sum_f ((V_f.x)^2 - V_f^2.x^2)): the sum-of-squares identity gives all pairwise interactions in
time linear in the features. Features come from the whole text only: relative counts of words in ``BUCKETS`` hash buckets,
and statistics of characters, words and lines; labels, languages, sources and identifiers are no inputs.

The machine is trained on a bounded sample, at most ``TRAIN_PER_LABEL`` labelled documents of either label (those of the smallest
hashes of doc_id), with features made by the executors, in the order of those hashes: equal tables give equal scores. Scoring covers every
row by batched matrix products.

Cases: null and empty texts have all-zero features and get a score. Null labels teach nothing; of several labels of a
document the highest counts. Without both labels the score is the share of label 1 (1/2 without any). Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import as_bytes, byte_set, grouped, words

BUCKETS = 1 << 11
TRAIN_PER_LABEL = 2500
FACTORS = 8
#: Documents whose dense features are held at a time.
BLOCK = 256

_WORD = byte_set(lambda b: b not in b" \t\n\v\f\r")
_GROUPS = np.stack(
    [
        byte_set(lambda b: 65 <= b <= 90),
        byte_set(lambda b: 97 <= b <= 122),
        byte_set(lambda b: 48 <= b <= 57),
        byte_set(lambda b: b >= 128),
        byte_set(lambda b: b in b" \t"),
        byte_set(lambda b: b == 10),
        byte_set(lambda b: b in b".,;:'\"()-"),
        byte_set(lambda b: b in b"!?"),
        byte_set(lambda b: b in b"|<>[]{}\\/_=~^`"),
        byte_set(lambda b: b in b"#$%&*+@"),
    ]
).astype(np.float64)
STATISTICS = len(_GROUPS) + 8


def _statistics(text: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(STATISTICS)
    n, n_words = len(text), len(hashes)
    if n:
        out[: len(_GROUPS)] = _GROUPS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    k = len(_GROUPS)
    out[k] = np.log1p(n)
    out[k + 1] = np.log1p(n_words)
    if n_words:
        counts = np.unique(hashes, return_counts=True)[1]
        lengths = ends - starts
        out[k + 2] = len(counts) / n_words
        out[k + 3] = counts.max() / n_words
        out[k + 4] = lengths.mean()
        out[k + 5] = lengths.std()
        out[k + 6] = (hashes[1:] == hashes[:-1]).mean() if n_words > 1 else 0
        pairs = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1]
        out[k + 7] = len(np.unique(pairs)) / (n_words - 1) if n_words > 1 else 1
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Relative counts of hashed words (square roots), and raw statistics, of each text."""
    bags, stats = np.zeros((len(texts), BUCKETS), np.float32), np.zeros((len(texts), STATISTICS))
    for begin, end in grouped(texts):
        hashes, starts, ends, counts = words(texts[begin:end], _WORD)
        at = 0
        for i, n in zip(range(begin, end), counts):
            own = slice(at, at + n)
            if n:
                bags[i] = np.sqrt(np.bincount((hashes[own] >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS) / n)
            stats[i] = _statistics(texts[i], hashes[own], starts[own], ends[own])
            at += n
    return bags, stats


class FactorisationMachine:
    """Weights of the machine and the scaling of its statistics."""

    def __init__(self, mean, scale, w0, w, v) -> None:
        self.mean, self.scale, self.w0, self.w, self.v = mean, scale, w0, w, v

    def inputs(self, bags: np.ndarray, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.scale, -4, 4)
        return np.concatenate([4 * bags, scaled], axis=1).astype(np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.v) ** 2).sum(1) - ((x * x) @ (self.v * self.v)).sum(1)
        return self.w0 + x @ self.w + 0.5 * pairs

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i in range(0, len(texts), BLOCK):
            m = self.margin(self.inputs(*features(texts[i : i + BLOCK])))
            out[i : i + BLOCK] = 1 / (1 + np.exp(-np.clip(m.astype(np.float64), -40, 40)))
        return out

    @classmethod
    def constant(cls, share: float) -> FactorisationMachine:
        d = BUCKETS + STATISTICS
        share = min(max(share, 1e-6), 1 - 1e-6)
        return cls(np.zeros(STATISTICS), np.ones(STATISTICS), np.float32(np.log(share / (1 - share))), np.zeros(d, np.float32), np.zeros((d, FACTORS), np.float32))

    @classmethod
    def train(cls, bags, stats, labels, weights, epochs: int = 40, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """Adam on the weighted logistic loss."""
        rng = np.random.default_rng(seed)
        d = BUCKETS + STATISTICS
        mean, scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        machine = cls(mean, scale, np.float32(0), np.zeros(d, np.float32), rng.normal(0, 0.01, (d, FACTORS)).astype(np.float32))
        x, y = machine.inputs(bags, stats), labels.astype(np.float32)
        weights = (weights / weights.mean()).astype(np.float32)
        first, second = [np.zeros(d + 1, np.float32), np.zeros((d, FACTORS), np.float32)], [np.zeros(d + 1, np.float32), np.zeros((d, FACTORS), np.float32)]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            speed = rate * (1 - epoch / epochs) + 1e-3
            for i in range(0, len(y), batch):
                own = order[i : i + batch]
                xb = x[own]
                p = 1 / (1 + np.exp(-np.clip(machine.margin(xb), -30, 30)))
                g = ((p - y[own]) * weights[own] / len(own)).astype(np.float32)
                gw = np.append(xb.T @ g + decay * machine.w, g.sum()).astype(np.float32)
                gv = xb.T @ (g[:, None] * (xb @ machine.v)) - ((xb * xb).T @ g)[:, None] * machine.v + decay * machine.v
                step += 1
                moves = []
                for k, grad in enumerate((gw, gv)):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    moves.append(speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
                machine.w = machine.w - moves[0][:-1]
                machine.w0 = machine.w0 - moves[0][-1]
                machine.v = machine.v - moves[1]
        return machine


def _features_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        bags, stats = features(as_bytes(batch))
        yield pa.StructArray.from_arrays([pa.array([x.tobytes() for x in bags], pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary())], ["bag", "stats"])


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = TRAIN_PER_LABEL) -> FactorisationMachine:
    """Fit on at most ``per_label`` rows of either label that aren't held out."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    marks = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return FactorisationMachine.constant(float(next(iter(sizes), 0.5)))
    chosen = [marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    rows = docs.select("doc_id", F.col("text")).join(F.broadcast(sample), "doc_id")  # 2 * per_label rows at most
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", F.xxhash64("doc_id").alias("h"), "y", F.arrow_udf(_features_batches, "bag binary, stats binary")("text").alias("f"))
    got = rows.select("doc_id", "h", "y", "f.*").toPandas().sort_values(["y", "h", "doc_id"])  # one order for one set of rows
    bags = np.stack([np.frombuffer(x, np.float32) for x in got["bag"]])
    stats = np.stack([np.frombuffer(x, np.float64) for x in got["stats"]])
    y = got["y"].to_numpy()
    share = np.array([sizes[0], sizes[1]]) / np.bincount(y, minlength=2)  # the sample's rows stand for all rows of their label
    return FactorisationMachine.train(bags, stats, y, share[y])


def score_column(machine: FactorisationMachine, spark):
    """A column function: the score of a text."""
    shared = spark.sparkContext.broadcast(machine)  # d * (FACTORS + 1) floats

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(shared.value.score(as_bytes(batch)), pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Add held_out, score and predicted to every row of ``docs`` (columns of these names are replaced)."""
    machine = train(docs, labels)
    score = score_column(machine, docs.sparkSession)
    return docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": score(F.col("text"))}).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))

"""Language identification: string-kernel ridge regression with Nystroem landmarks.

Two texts x and l have the kernel |G(x) & G(l)| / sqrt(|G(x)| |G(l)|), where G is the set of n-grams of 1 to ``MAX_N`` characters of
the lower-cased text (a blended spectrum of presences; n-grams are hashed to ``SLOTS`` slots). ``LANDMARKS`` landmark texts a
language span the feature space: phi(x) = W^(-1/2) k(x). One ridge regression a language is fitted on phi; a batch of texts is
scored by matrix products of its presence matrix, the landmarks' presence matrix and the weights.

Training takes a bounded sample: at most ``TRAIN_PER_LANG`` documents a language, those of the smallest hashes of doc_id, and ``TRAIN_ROWS`` in all,
which many languages share evenly; every language has one at least, and so have landmarks, of which there are ``LANDMARKS_IN_ALL``.

Cases: null texts and texts without a letter (number signs are none) are ``und`` with score 0. Null languages teach nothing. Without any language to
learn, everything is ``und``. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.quality import held_out

SLOTS = 1 << 18
MAX_N = 4
#: Rows that are learnt from, and landmarks: of a language, and in all (but one a language at least).
TRAIN_PER_LANG, TRAIN_ROWS = 250, 10_000
LANDMARKS, LANDMARKS_IN_ALL = 40, 4000
RIDGE = 1e-3
#: Characters taken at a time, and texts whose presences are held at a time.
PIECE, BLOCK = 1 << 20, 64


def ngrams(text: str) -> np.ndarray:
    """The set G: sorted slots of the n-grams that occur in the text."""
    flags = np.zeros(SLOTS, bool)
    lowered = text.lower()
    for begin in range(0, len(lowered), PIECE):
        points = np.frombuffer(lowered[begin : begin + PIECE + MAX_N - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code = np.zeros(len(points), np.uint64)
        for n in range(1, min(MAX_N, len(points)) + 1):
            code = code[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            flags[((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)] = True
    return np.flatnonzero(flags).astype(np.int32)


class KernelRidge:
    """Languages, the slots that landmarks use, and the weights: landmarks' presences times one column a language."""

    def __init__(self, langs: list[str], slot: np.ndarray, weights: np.ndarray) -> None:
        self.langs, self.slot, self.weights = langs, slot, weights

    @classmethod
    def train(cls, sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelRidge:
        names = sorted(set(langs))
        landmarks = max(1, min(landmarks, LANDMARKS_IN_ALL // len(names)))
        rows = {name: [] for name in names}
        for i, name in enumerate(langs):
            rows[name].append(i)
        picked = [i for name in names for i in rows[name][:landmarks]]
        used = np.unique(np.concatenate([sets[i] for i in picked]))
        slot = np.full(SLOTS, -1, np.int32)
        slot[used] = np.arange(len(used))
        marks = np.zeros((len(used), len(picked)), np.float32)
        for column, i in enumerate(picked):
            marks[slot[sets[i]], column] = 1 / np.sqrt(max(len(sets[i]), 1))
        kernel = np.stack([marks[(s := slot[x])[s >= 0]].sum(0) / np.sqrt(max(len(x), 1)) for x in sets]).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[picked] / 2 + kernel[picked].T / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        phi = kernel @ root
        target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
        size = np.array([len(rows[x]) for x in langs], float)
        phi_w = phi / size[:, None]
        beta = np.linalg.solve(phi.T @ phi_w + ridge * np.eye(len(picked)), phi_w.T @ target)
        return cls(names, slot, (marks @ (root @ beta)).astype(np.float32))

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(self.langs)), np.float32)
        for begin in range(0, len(sets), BLOCK):
            block = sets[begin : begin + BLOCK]
            presence = np.zeros((len(block), len(self.weights)), np.float32)
            for row, x in enumerate(block):
                s = self.slot[x]
                presence[row, s[s >= 0]] = 1 / np.sqrt(max(len(x), 1))
            out[begin : begin + BLOCK] = presence @ self.weights
        return out


def _ngram_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([ngrams(x or "").tobytes() for x in batch.to_pylist()], pa.binary())


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> KernelRidge | None:
    """Fit on at most ``per_lang`` rows a language that aren't held out."""
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    per_lang = max(1, min(per_lang, TRAIN_ROWS // max(1, known.select("lang").distinct().count())))
    chosen = known.select("doc_id", "lang").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_lang)
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("r").alias("r"))
    texts = known.select("doc_id", "lang", "text").where("text IS NOT NULL").join(F.broadcast(chosen), ["doc_id", "lang"])  # per_lang rows a language
    got = texts.groupBy("lang", "r", "doc_id").agg(F.min("text").alias("text")).select("lang", "r", F.arrow_udf(_ngram_batches, "binary")("text").alias("g")).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "r"])
    return KernelRidge.train([np.frombuffer(x, np.int32) for x in got["g"]], list(got["lang"]))


def predict_column(model: KernelRidge | None, spark):
    """A column function: the language and score of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            lang, score = ["und"] * len(batch), np.zeros(len(batch))
            texts = batch.to_pylist()
            rows = [i for i, x in enumerate(texts) if model and x and any(map(str.isalpha, x))]
            for begin in range(0, len(rows), BLOCK):
                own = rows[begin : begin + BLOCK]
                got = model.scores([ngrams(texts[i]) for i in own])
                best = got.argmax(1)
                for i, b, s in zip(own, best, got[np.arange(len(own)), best]):
                    lang[i], score[i] = model.langs[b], min(max((float(s) + 1) / 2, 0.0), 1.0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """Add held_out, lang_pred and score to every row of ``docs`` (columns of these names are replaced)."""
    predict = predict_column(train(docs), docs.sparkSession)
    out = docs.withColumn("_p", predict(F.col("text")))
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score")}).drop("_p")

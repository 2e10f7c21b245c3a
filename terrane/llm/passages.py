"""Passages of more than 50 words that other documents hold as well, counted in words.

Words are maximal runs of bytes other than white space with A-Z lower-cased; a passage is a window of ``words`` consecutive ones, so that
line breaks and runs of spaces don't matter. Nothing is thinned from the result, only from what is sent:

1. Of the grams of ``gram`` words in a window, the one of the smallest hash stands for it. Equal windows have equal smallest grams.
   Smallest grams that only one text has go (a count by hash).
2. Texts with grams left give a 128-bit digest of each window whose smallest gram is one of these: some windows of a hundred.
3. Windows that two different texts hold are joined back, and their words counted, each once. Copies of a text share all of it.

Cases: a window that repeats within one text alone doesn't count; null texts and those of fewer words share nothing; repeated rows are
copies of each other; a text of any length is worked off in pieces until its words are known. Words and windows are known by hashes of
64 and twice 64 bits, not compared by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.store import materialise, scratch
from terrane.llm.suffix_dedup import SENT, _slide
from terrane.llm.text import as_bytes, byte_set, grouped, list_array, mix
from terrane.llm.text import words as words_of

#: Words of a passage, and of the grams that stand for it.
WORDS, GRAM = 51, 16
_WORD = byte_set(lambda b: b not in b" \t\n\v\f\r")
_BASES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def text_key(text: str) -> Column:
    """The MD5 of a text's bytes; null for null."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _rolled(values: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``width`` values: a polynomial in ``base``, put together from runs of powers of two."""
    n = len(values) - width + 1
    out, at, span, code, power = np.zeros(n, np.uint64), 0, 1, values, np.array([base])
    while True:
        if width & span:
            out = out * power + code[at : at + n]
            at += span
        if 2 * span > width:
            return mix(out)
        code = code[:-span] * power + code[span:]
        power = power * power
        span *= 2


def _smallest(hashes: np.ndarray, words: int, gram: int) -> np.ndarray:
    """The smallest gram's hash of each window."""
    return _slide(_rolled(hashes, gram, _BASES[0]), words - gram + 1, np.minimum)


def _places(keys: list[bytes]) -> np.ndarray:
    """A number for each text."""
    return np.array([int.from_bytes(k[:8], "little") for k in keys], np.uint64).view(np.int64)


def _scan(words: int, gram: int):
    """key, place (a number for the text), n_words and the smallest grams' hashes of texts that hold a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for begin, end in grouped(texts):
                hashes, _, _, counts = words_of(texts[begin:end], _WORD)
                some = np.flatnonzero(counts >= words)
                if not len(some):
                    continue
                owner = np.repeat(np.arange(end - begin), counts)
                low, first, last = _smallest(hashes, words, gram), owner[: len(owner) - words + 1], owner[words - 1 :]
                fresh = first == last
                fresh[1:] &= (low[1:] != low[:-1]) | (first[1:] != first[:-1]) | (first[:-1] != last[:-1])
                n = np.bincount(first[fresh], minlength=end - begin)[some]
                codes = list_array(low[fresh].view(np.int64), n, pa.int64())
                own = [keys[begin + i] for i in some.tolist()]
                columns = [pa.array(own, pa.binary()), pa.array(_places(own)), pa.array(counts[some], pa.int64()), codes]
                yield pa.RecordBatch.from_arrays(columns, ["key", "place", "n_words", "codes"])

    return run


def _windows(words: int, gram: int):
    """key, place, at (in words) and digest of each window whose smallest gram is asked for."""

    def sent(keys: list[bytes], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        n = [len(r[0]) for r in rows]
        flat = [np.concatenate(c) for c in zip(*rows)]
        columns = [pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), n))), pa.array(np.repeat(_places(keys), n)), *map(pa.array, flat)]
        batch = pa.RecordBatch.from_arrays(columns, ["key", "place", "at", "a", "b"])
        for begin in range(0, batch.num_rows, SENT):
            yield batch.slice(begin, SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, held = [], [], 0
            for key, text, codes in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2)):
                hashes = words_of([text], _WORD)[0]
                asked = np.asarray(codes.values).view(np.uint64)
                at = np.flatnonzero(np.isin(_smallest(hashes, words, gram), asked))
                keys.append(key)
                rows.append((at, *(_rolled(hashes, words, base)[at].view(np.int64) for base in _BASES[1:])))
                held += len(at)
                if held > SENT:
                    yield from sent(keys, rows)
                    keys, rows, held = [], [], 0
            if held:
                yield from sent(keys, rows)

    return run


def _covered(words: int):
    """Words in windows that begin at the given places."""

    def covered(places: pa.Array) -> pa.Array:
        return pa.array([int(np.minimum(np.diff(np.sort(np.asarray(p.values))), words).sum()) + words for p in places], pa.int64())

    return covered


def shared_words(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """key (MD5 of a text) and n_shared_words: its words in windows that another row of ``docs`` (doc_id, text) holds; only texts with some."""
    with scratch(docs.sparkSession):
        keyed = docs.select("doc_id", text_key("text").alias("key"), "text").where(F.octet_length("text") >= 2 * words - 1)
        scanned = materialise(keyed.select("key", "text").mapInArrow(_scan(words, gram), "key binary, place long, n_words long, codes array<long>"), "grams")
        flat = scanned.select("key", "place", F.explode("codes").alias("code"))
        common = flat.groupBy("code").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b").select("code")
        common = materialise(common, "common")  # so that the join below has a plain shuffle on either side
        asked = flat.join(common, "code", "left_semi").groupBy("key").agg(F.collect_set("code").alias("codes"))
        speakers = keyed.groupBy("key").agg(F.min("doc_id").alias("speaker"))
        asked = asked.join(speakers, "key").hint("shuffle_hash")
        texts = keyed.join(asked, "key").where(F.col("doc_id").eqNullSafe(F.col("speaker"))).select("key", "text", "codes")
        windows = materialise(texts.mapInArrow(_windows(words, gram), "key binary, place long, at long, a long, b long"), "windows")
        twice = windows.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("a", "b")
        twice = materialise(twice, "twice")
        places = windows.join(twice, ["a", "b"], "left_semi").groupBy("key").agg(F.collect_set("at").alias("places"))
        parts = places.select("key", F.arrow_udf(_covered(words), "long")("places").alias("n_shared_words"))
        copies = scanned.groupBy("key").agg(F.count("*").alias("n"), F.max("n_words").alias("n_shared_words")).where("n > 1").select("key", "n_shared_words")
        return materialise(parts.unionByName(copies).groupBy("key").agg(F.max("n_shared_words").alias("n_shared_words")), "shared_words", keep=True)

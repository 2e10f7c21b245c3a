"""Packing: shortest-pack-first over the histogram of piece lengths.

Documents are tokenised by the executors (one id ends each document), and cut into pieces of ``max_tokens`` ids and a rest. Only the
histogram of piece lengths, ``max_tokens`` counts at most, reaches the driver. There, lengths are placed longest first, each into the
shortest packs that have room (packing patterns with counts, not single sequences). A pattern's place for a length stands
for a range of ranks among all pieces of that length; pieces find sequence and offset by their rank. Ranks come from
counts by length and hash bucket, so that no task meets all pieces of one length.

Cases: null and empty texts are one piece with the end id alone. Repeated rows are packed each for itself (equal pieces are
interchangeable). Texts of any length are tokenised whole, in pieces cut at white space. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.store import materialise

MAX_TOKENS = 2048
END_ID = 1
#: Words whose ids a worker keeps (some 120 MB), and the longest such word.
CACHE_WORDS, CACHE_CHARS = 600_000, 40
#: Pieces of one length that are ranked in one group, about.
RANK_GROUP = 20_000

_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: Fixed value: the tokenizer's splitting pattern, for such texts in lower case.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-zà-öø-ÿß0-9]+")

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


class Tokens:
    """Ids of texts as little-endian 32-bit bytes, by a public tokenizer that drops white space.

    Texts are parted into the tokenizer's own words, which repeat, and new words are encoded together. In texts of ASCII and
    Latin-1 letters, lower-casing and the splitting pattern do what the tokenizer's normaliser and splitter do, and its model
    alone is asked. Other texts are parted at spaces and line feeds, which no token crosses, and go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.model = path, Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(text) is not None and "<|" not in text for text in texts]
        out: list[bytes] = [b""] * len(texts)
        for kind, known, part, ask in ((True, self.words, lambda t: _WORD.findall(t.lower()), self._model), (False, self.chunks, lambda t: t.replace("\n", " ").split(" "), self._whole)):
            rows = [i for i, p in enumerate(plain) if p == kind]
            parts = [part(texts[i]) for i in rows]
            new = set().union(*parts).difference(known)
            known.update(ask(list(new)))
            for i, words in zip(rows, parts):
                out[i] = b"".join(map(known.__getitem__, words))
            for word in new:
                if len(word) > CACHE_CHARS:
                    del known[word]
            if len(known) > CACHE_WORDS:  # the words met first are mostly frequent ones
                for word in list(islice(known, CACHE_WORDS // 2, None)):
                    del known[word]
        return out

    def _model(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for begin in range(0, len(words), 20_000):
            part = words[begin : begin + 20_000]
            code = self.model.encode(" ".join(part), add_special_tokens=False)
            raw, ends = np.array(code.ids, "<u4").tobytes(), (4 * np.flatnonzero(np.diff(code.word_ids, append=-1)) + 4).tolist()
            out.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        return out

    def _whole(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for begin in range(0, len(words), 10_000):
            part = words[begin : begin + 10_000]
            out.update((w, np.array(code.ids, "<u4").tobytes()) for w, code in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False)))
        return out


@functools.cache
def _tokens(path: str) -> Tokens:
    """One a worker: its vocabulary is loaded, and its words are learned, once."""
    return Tokens(path)


def cut(ids: bytes, max_tokens: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of one document's ids."""
    total = len(ids) // 4
    return [(s, min(max_tokens, total - s), zlib.crc32(ids[4 * s : 4 * (s + max_tokens)])) for s in range(0, total, max_tokens)]


def _tokenise(path: str, max_tokens: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _tokens(path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for begin in range(0, len(names), 200):
                rows: list[tuple] = []
                own = [x or "" for x in texts.slice(begin, 200).to_pylist()]
                for doc, ids in zip(names[begin : begin + 200], tokens.encode(own)):
                    ids += end
                    rows += [(doc, s, n, crc, len(ids) // 4) for s, n, crc in cut(ids, max_tokens)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack_histogram(counts: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many sequences have each.

    Lengths are placed longest first. Each goes to the shortest packs, that is to those with most room, while it fits them; a
    new pack is opened otherwise. Of a pattern that more sequences have than pieces are left, only so many are extended.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []  # ascending, those with packs
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            room = rooms[-1] if rooms else -1
            if room < length:
                share = -(-left // (max_tokens // length))
                pattern, n, room = (), share, max_tokens
            else:
                pattern, n = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop()
            used = min(n, left)
            if pattern and n > used:
                _put(by_room, rooms, room, pattern, n - used)
            _put(by_room, rooms, room - length, (*pattern, length), used)
            left -= used
    return [entry for room in sorted(by_room) for entry in by_room[room]]


def _put(by_room, rooms: list[int], room: int, pattern: tuple[int, ...], n: int) -> None:
    if not by_room[room]:
        rooms.insert(bisect_right(rooms, room), room)
    by_room[room].append((pattern, n))


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks (ascending), and the sequence of the first rank and the offset that go with each."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out[length].append((rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows)) for length, rows in out.items()}


def tokenise(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenise(tokenizer_path, max_tokens, end_id), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, rank_group: int = RANK_GROUP) -> DataFrame:
    """Pieces of all documents with the sequence and the offset in it that each has."""
    pieces = materialise(tokenise(docs, tokenizer_path, max_tokens, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(8, max(histogram.values(), default=0) // rank_group)
    shared = docs.sparkSession.sparkContext.broadcast(places(pack_histogram(histogram, max_tokens)))  # max_tokens lengths

    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.join(firsts.drop("n"), ["length", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)

    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for value in np.unique(length):
            own = np.flatnonzero(length == value)
            starts, first, at = shared.value[int(value)]
            slot = np.searchsorted(starts, rank[own], "right") - 1
            sequence[own], offset[own] = first[slot] + rank[own] - starts[slot], at[slot]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return ranked.withColumn("_p", place("length", "rank")).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset")
    )

"""Benchmark decontamination: suffix arrays of the training texts, searched by every suffix of the test items.

Words are numbered by the test items' vocabulary. In each shard (the texts that a task holds, up to ``SHARD`` bytes) the suffixes that could
match are sorted: those that begin with as many words, and pairs of words, of the test items as the shortest window has. Every different test
suffix is looked up by binary search in every shard, its first ``WINDOW`` words deciding, and the words found are compared with the item's
by their bytes. Places where one window follows another as in an item are joined to the longest verbatim matches. Documents with too many
words in windows are contaminated and go.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window. Equal windows are looked up
once, whatever the number of their items and places: a word repeated in item and document costs no more than its places.

Test items are broadcast only in blocks of at most ``MAX_BLOCK_BYTES`` of text (their arrays take some fifteen times that); larger benchmarks take
one pass a block, of which only the findings are kept. Cases: null and empty texts have no words and no hits; items without words match nothing; items
with the same item_id count once; repeated rows are judged alike; null item_ids aren't listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.store import materialise
from terrane.llm.text import as_bytes, byte_set, grouped, list_array, words

WINDOW = 13
MAX_BLOCK_BYTES, SHARD = 8 << 20, 8 << 20

_WORD = byte_set(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


class TestItems:
    """Vocabulary and different windows of a block of test items, with the items of each window."""

    __test__ = False  # not for pytest

    def __init__(self, ids: list[str | None], texts: list[bytes], window: int = WINDOW) -> None:
        hashes, starts, ends, counts = words(texts, _WORD) if texts else (np.zeros(0, np.uint64), [], [], np.zeros(0, int))
        owner = np.repeat(np.arange(len(texts)), counts)
        self.ids, self.window = ids, window
        self.vocabulary, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
        self.spelled = [texts[owner[i]][starts[i] : ends[i]].lower() for i in first]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.vocabulary >> np.uint64(44)] = True
        numbers = (numbers + 1).astype(np.uint32)
        self.pairs = np.zeros(1 << 20, bool)
        self.pairs[_pair(numbers[:-1], numbers[1:])[owner[1:] == owner[:-1]]] = True
        places = np.maximum(counts - window + 1, counts > 0)
        item = np.repeat(np.arange(len(texts)), places)
        at = np.arange(len(item)) - np.repeat(np.cumsum(places) - places, places) + np.repeat(np.cumsum(counts) - counts, places)
        length = np.minimum(window, counts[item])
        padded = np.append(numbers, np.zeros(window, np.uint32))
        heads = padded[at[:, None] + np.arange(window)].astype(">u4")
        heads[np.arange(window)[None, :] >= length[:, None]] = 0
        keys, one, number = np.unique(_keys(heads), return_index=True, return_inverse=True)
        #: Different windows in ascending order: their words, padded with zeros, and their lengths.
        self.low, self.length = keys, length[one]
        self.short = np.flatnonzero(self.length < window)
        last = heads[one[self.short]]
        last[np.arange(window)[None, :] >= self.length[self.short][:, None]] = 0xFFFFFFFF
        self.high = _keys(last)
        self.shortest = int(self.length.min()) if len(keys) else 0
        owned = np.unique(number * np.int64(len(texts) or 1) + item)
        self.items = owned % (len(texts) or 1)
        self.first_item = np.searchsorted(owned, np.arange(len(keys) + 1) * np.int64(len(texts) or 1))
        self.follow = np.unique((number[:-1] * np.int64(len(keys)) + number[1:])[item[1:] == item[:-1]])

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary, 0 if it isn't there."""
        out = np.zeros(len(hashes), np.uint32)
        if len(self.vocabulary):
            hit = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[hit]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == hashes[hit]
            out[hit[same]] = at[same] + 1
        return out

    def search(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the places in ``numbers`` where they occur (a zero stands for any other word)."""
        none = np.zeros(0, np.int64)
        if not self.shortest or not len(numbers):
            return none, none
        ahead = _ahead(numbers > 0)
        fine = ahead >= self.shortest
        if self.shortest > 1:
            fine[:-1] &= _ahead(self.pairs[_pair(numbers[:-1], numbers[1:])]) >= self.shortest - 1
            fine[-1] = False
        suffixes = np.flatnonzero(fine)
        if not len(suffixes):
            return none, none
        padded = np.append(numbers, np.zeros(self.window, np.uint32))
        heads = padded[suffixes[:, None] + np.arange(self.window)].astype(">u4")
        heads[np.arange(self.window)[None, :] >= ahead[suffixes][:, None]] = 0
        keys = _keys(heads)
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.low, "right")
        high[self.short] = np.searchsorted(keys, self.high, "right")
        n = np.maximum(high - low, 0)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(n)), n), suffixes[np.repeat(low, n) + within]

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether window b comes next to window a in an item."""
        if not len(self.follow):
            return np.zeros(len(a), bool)
        code = a * np.int64(len(self.low)) + b
        return self.follow[np.minimum(np.searchsorted(self.follow, code), len(self.follow) - 1)] == code


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)


def _ahead(fine: np.ndarray) -> np.ndarray:
    """How many in a row are fine from each place on."""
    stops = np.append(np.flatnonzero(~fine), len(fine))
    return np.repeat(stops, np.diff(stops, prepend=-1))[: len(fine)] - np.arange(len(fine))


def _keys(heads: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as strings that sort like them."""
    return np.ascontiguousarray(heads).view(f"S{4 * heads.shape[1]}").ravel()


def _shard(items: TestItems, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], list[set[int]]]:
    """Words of each text, its longest verbatim matches (item, word in the text, words) and all its items."""
    parts = []
    for begin, end in grouped(texts):
        hashes, starts, ends, counts = words(texts[begin:end], _WORD)
        parts.append((items.number(hashes), starts, ends, counts))
    numbers, starts, ends, counts = (np.concatenate(x) for x in zip(*parts))
    matches: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    firsts = np.cumsum(counts) - counts
    window, place = items.search(np.insert(numbers, firsts, 0))  # a stop before each text
    if not len(window):
        return counts, matches, [set() for _ in texts]
    doc = np.searchsorted(firsts + np.arange(len(firsts)), place, "right") - 1
    word = place - doc - 1  # in the joined texts
    n = items.length[window]
    edges = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edges, word, 1)
    np.add.at(edges, word + n, -1)
    hit = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    of = np.searchsorted(firsts, hit, "right") - 1
    wrong = np.zeros(len(numbers) + 1, np.int64)
    for w, d in zip(hit.tolist(), of.tolist()):  # hashes gave the numbers: the bytes decide
        wrong[w + 1] = texts[d][starts[w] : ends[w]].lower() != items.spelled[numbers[w] - 1]
    wrong = np.cumsum(wrong)
    fine = wrong[word + n] == wrong[word]
    order = np.lexsort((word[fine], n[fine] < items.window))
    window, doc, word, n = (x[fine][order] for x in (window, doc, word, n))
    joined = (word[1:] == word[:-1] + 1) & (doc[1:] == doc[:-1]) & (n[1:] == items.window) & (n[:-1] == items.window)
    joined[joined] = items.follows(window[:-1][joined], window[1:][joined])
    begin = np.flatnonzero(np.concatenate([[True], ~joined])[: len(window)])
    end = np.append(begin[1:], len(window)) - 1
    for a, b in zip(begin.tolist(), end.tolist()):
        d = int(doc[a])
        matches[d].append((int(items.items[items.first_item[window[a]]]), int(word[a] - firsts[d]), int(word[b] - word[a] + n[b])))
    found: dict[int, set[int]] = {}
    for code in np.unique(doc * np.int64(len(items.low)) + window).tolist():
        d, w = divmod(code, len(items.low))
        found.setdefault(d, set()).update(items.items[items.first_item[w] : items.first_item[w + 1]].tolist())
    return counts, matches, [found.get(d, set()) for d in range(len(texts))]


_MATCH = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
_FINDINGS = "n_words long, matches array<struct<item_id: string, doc_word: long, n_words: long>>, items array<string>"


def match_column(spark: SparkSession, items: TestItems):
    """A column function: a text's number of words, its longest verbatim matches with the items, and the ids of all items with a window in it."""
    shared = spark.sparkContext.broadcast(items)  # of at most MAX_BLOCK_BYTES of text

    @F.arrow_udf(_FINDINGS)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = shared.value
        for batch in batches:
            texts, out = as_bytes(batch), []
            for begin, end in grouped(texts, SHARD):
                n_words, found, owned = _shard(items, texts[begin:end])
                named = [[{"item_id": items.ids[m[0]], "doc_word": m[1], "n_words": m[2]} for m in own] for own in found]
                lists = list_array(pa.array([m for own in named for m in own], _MATCH), np.array([len(own) for own in named]), _MATCH)
                names = [sorted({items.ids[i] for i in own} - {None}) for own in owned]
                out.append(pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), lists, pa.array(names, pa.list_(pa.string()))], ["n_words", "matches", "items"]))
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_words", pa.int64()), ("matches", pa.list_(_MATCH)), ("items", pa.list_(pa.string()))]))

    return match


_DIGEST = "n_hit long, n_items long, items_sha256 string"


def _digests(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Words in matches, number of items, and their digest."""
    for matches, items in batches:
        hit, n_items, sha = [], [], []
        for own, names in zip(matches.to_pylist(), items.to_pylist()):
            total = reach = 0
            for a, b in sorted((m["doc_word"], m["doc_word"] + m["n_words"]) for m in own):
                total += max(0, b - max(a, reach))
                reach = max(reach, b)
            hit.append(total)
            n_items.append(len(names))
            sha.append(hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
        yield pa.StructArray.from_arrays([pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string())], ["n_hit", "n_items", "items_sha256"])


def blocks(benchmark: DataFrame, window: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> Iterator[Callable[[], TestItems]]:
    """Test items in blocks of bounded size, by hash of the item; each is fetched when it is called for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // max_block_bytes)) if size > max_block_bytes else 1
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text") if n > 1 else items.orderBy("item_id", "text")

        def fetched(own: DataFrame = own) -> TestItems:
            rows = own.collect()
            return TestItems([r["item_id"] for r in rows], [r["text"].encode() for r in rows], window)

        yield fetched


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Add n_words, matches, items, n_hit, n_items, items_sha256 and contaminated to every row (columns of these names are replaced).

    Contaminated: some word is hit, and ``share`` times the hit words are at least all words.
    """
    every = list(blocks(benchmark, window, max_block_bytes))
    if len(every) == 1:
        out = docs.withColumn("_m", match_column(docs.sparkSession, every[0]())(F.col("text")))
    else:
        # One block of items at a time in the workers; only documents with findings are kept of a pass, by the digest of their text.
        key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        passes = []
        for k, items in enumerate(every):
            found = docs.select(key.alias("key"), match_column(docs.sparkSession, items())(F.col("text")).alias("m")).select("key", "m.matches", "m.items").where("size(matches) > 0")
            passes.append(materialise(found.dropDuplicates(["key"]), f"block{k}"))
        met = passes[0]
        for other in passes[1:]:
            met = met.unionByName(other)
        met = met.groupBy("key").agg(F.flatten(F.collect_list("matches")).alias("matches"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        met = materialise(met, "findings").select(F.col("key").alias("_key"), F.struct("matches", "items").alias("_f"))
        none = TestItems([], [], window)
        out = docs.withColumn("_key", key).join(met, "_key", "left").withColumn("_m", match_column(docs.sparkSession, none)(F.col("text"))).drop("_key")
        out = out.withColumn("_m", F.struct("_m.n_words", F.coalesce("_f.matches", "_m.matches").alias("matches"), F.coalesce("_f.items", "_m.items").alias("items"))).drop("_f")
    out = out.withColumn("_d", F.arrow_udf(_digests, _DIGEST)("_m.matches", "_m.items"))
    facts = {c: F.col(f"_m.{c}") for c in ("n_words", "matches", "items")} | {c: F.col(f"_d.{c}") for c in ("n_hit", "n_items", "items_sha256")}
    out = out.withColumns(facts).drop("_m", "_d")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    judged = judge(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_row", "text"), benchmark, **options)
    return judged.where(~F.col("contaminated")).select("_row.*")

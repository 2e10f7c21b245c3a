"""MinHash near-duplicate detection with odd sketches.

Each document's set of word shingles is hashed to 64 bits a shingle. Documents with equal sets form one class, which goes on
alone. A class has ``BANDS`` * ``ROWS`` MinHash values: bands of ``ROWS`` values are the buckets in which classes meet, and all
values are folded into an odd sketch, a bitmap in which each value flips one bit. The population count of two sketches' XOR
estimates their similarity, precisely so where it is high; pairs with an estimate under the threshold less ``MARGIN`` go
before the full sets are compared. A pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^24 = 3e-6, and falls out
of the sketch test with about the same.

No bucket is expanded into all its pairs. First each class of a bucket is compared with the bucket's smallest class only, and
confirmed links are joined to components. Classes that buckets connect form a cluster; where one holds several components,
the classes outside its largest component are compared with all others of the cluster, in blocks of ``BLOCK`` classes that
tasks share. Within a block pair, classes that links have joined aren't compared again, and only joining links leave the
task. No bucket is cut or sampled.

Links need |A & B| >= similarity * |A | B| on full sets. Cases: null and empty texts, and those without words, have no shingles
and are linked with nothing; with fewer words than a shingle has, all words are one shingle; repeated rows are in one class;
a null doc_id is linked by its text, but is no component's name; different texts under one doc_id are judged each for itself; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.components import components
from terrane.llm.store import materialise, scratch
from terrane.llm.text import as_bytes, byte_set, grouped, mix, words

WORDS = 5
SIMILARITY_PERCENT = 80
BANDS, ROWS = 24, 4
SKETCH_BITS = 512
MARGIN = 0.28
BLOCK = 250

_WORD = byte_set(lambda b: b not in b" \t\n\v\f\r")
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_TURNS = mix(_SEEDS) | np.uint64(1)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text."""
    out: list[np.ndarray] = []
    for begin, end in grouped(texts):
        hashes, _, _, counts = words(texts[begin:end], _WORD)
        at = 0
        for count in counts:
            own = hashes[at : at + count]
            at += count
            width = min(n, count)
            if not width:
                out.append(own)
                continue
            code = np.full(count - width + 1, width, np.uint64)
            for k in range(width):
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + own[k : count - width + 1 + k])
            out.append(np.unique(code))
    return out


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    best = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(shingles), 1024):
        part = (shingles[None, begin : begin + 1024] ^ _SEEDS[:, None]) * _TURNS[:, None]
        np.minimum(best, part.min(1), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each flips one bit."""
    bits = np.bincount((mix(samples + _SEEDS) >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def most_flips(similarity: float) -> int:
    """The largest XOR population count whose estimate is at least ``similarity``."""
    samples = BANDS * ROWS
    return int(SKETCH_BITS * (1 - np.exp(-4 * samples * (1 - similarity) / SKETCH_BITS)) / 2)


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column(1)), n)
            first = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            second = np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            bands, sketches = [], []
            for s in sets:
                low = minhashes(s) if len(s) else None
                if low is None:
                    bands.append(None)
                    sketches.append(None)
                    continue
                code = np.arange(1, BANDS + 1, dtype=np.uint64)
                for column in low.reshape(BANDS, ROWS).T:
                    code = mix(code * np.uint64(0x9E3779B97F4A7C15) + column)
                bands.append(code.view(np.int64))
                sketches.append(odd_sketch(low))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(first), pa.array(second), pa.array(bands, lists), pa.array(sketches, lists)],
                ["doc_id", "key", "n_shingles", "c1", "c2", "bands", "sketch"],
            )

    return run


def _flips(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        total = total + F.bit_count(a[k].bitwiseXOR(b[k]))
    return total


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class _Verifier:
    """Full shingle sets of the classes that some pair asks for, and the comparison of pairs."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> None:
        self.docs, self.classes, self.n, self.percent = docs, classes, n, percent

    def sets(self, pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        wanted = self.classes.select("cid", "rep").join(asked, "cid", "left_semi").hint("shuffle_hash")
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = shingle_sets(as_bytes(batch.column(1)), n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "shingles"])

        same = self.docs["doc_id"].eqNullSafe(wanted["rep.doc_id"]) & (self.docs["key"] == wanted["rep.key"])
        texts = self.docs.join(wanted, same).select("cid", "text")
        return materialise(texts.mapInArrow(run, "cid long, shingles binary").dropDuplicates(["cid"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        sets, percent = self.sets(pairs), self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                met = zip(batch.column(2), batch.column(3))
                keep = pa.array([_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in met], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

        side = lambda c: sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s{c}"))
        met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
        return materialise(met.mapInArrow(run, "a long, b long"), "confirmed")


def _close(pairs: DataFrame, classes: DataFrame, flips: int) -> DataFrame:
    """The pairs whose odd sketches are close."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("sketch").alias(f"k{c}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    return materialise(met.where(_flips(F.col("ka"), F.col("kb")) <= flips).select("a", "b"), "close")


def _joining(flips: int, percent: int):
    """The links of one pair of blocks that join components."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["side", "cid", "root", "sketch", "shingles"]).to_pydict()
        sketches = np.array(rows["sketch"], np.int64).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        side = np.array(rows["side"])
        right = np.flatnonzero(side == 1)
        out = []
        for x in np.flatnonzero(side == 0):
            apart = np.bitwise_count(sketches[right] ^ sketches[x]).sum(1)
            for k in np.argsort(apart, kind="stable"):
                if apart[k] > flips:
                    break
                y = right[k]
                a, b = top(rows["root"][x]), top(rows["root"][y])
                if a != b and _linked(sets[x], sets[y], percent):
                    parent[max(a, b)] = min(a, b)
                    out.append((rows["cid"][x], rows["cid"][y]))
        return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _across(verifier: _Verifier, stars: DataFrame, roots: DataFrame, flips: int, block: int) -> DataFrame:
    """Links between the components of a cluster."""
    clusters = components(stars).select(F.col("id").alias("cid"), F.col("root").alias("cluster"))
    members = clusters.join(roots.withColumnRenamed("id", "cid"), "cid", "left").select("cid", "cluster", F.coalesce("root", "cid").alias("root"))
    members = materialise(members, "members")
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("parts"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    # Of two classes the star has tested the only pair.
    mixed = mixed.where("parts > 1 AND all > 2").select("cluster", "main", blocks(F.col("all") - F.col("most")).alias("few"), blocks(F.col("most")).alias("many"))
    own = members.join(mixed, "cluster").withColumn("minor", F.col("root") != F.col("main"))
    own = own.withColumn("at", F.pmod(F.xxhash64("cid"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many"))).cast("int"))
    own = materialise(own.join(verifier.classes.select("cid", "sketch"), "cid"), "mixed")
    if not own.limit(1).count():
        return stars.limit(0)
    sets = verifier.sets(own.select(F.col("cid").alias("a"), F.col("cid").alias("b")))
    own = own.join(sets, "cid")
    # Blocks of the largest component are numbered 0.., those of the others follow.
    minor = own.where("minor").withColumn("number", F.col("many") + F.col("at"))
    fields = ["cid", "root", "sketch", "shingles"]
    left = minor.select("cluster", F.col("at").alias("i"), F.explode(F.concat(F.sequence(F.lit(0), F.col("many") - 1), F.sequence("number", F.col("many") + F.col("few") - 1))).alias("j"), F.lit(0).alias("side"), *fields)
    met = minor.select("cluster", F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("number").alias("j"), F.lit(1).alias("side"), *fields)
    right = own.where("NOT minor").select("cluster", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"), *fields)
    pairs = left.unionByName(met).unionByName(right)
    return materialise(pairs.groupBy("cluster", "i", "j").applyInArrow(_joining(flips, verifier.percent), "a long, b long"), "joining")


def text_key() -> Column:
    """What identifies a text: the MD5 of its bytes (null: as empty)."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def judged(docs: DataFrame, shingle_words: int = WORDS, percent: int = SIMILARITY_PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, key (of the text), n_shingles, component_id and keeper (doc_id and key of the group's one text to keep) of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("key"))
    kinds = "doc_id long, key binary, n_shingles long, c1 long, c2 long, bands array<long>, sketch array<long>"
    signed = materialise(docs.mapInArrow(_signatures(shingle_words), kinds), "signatures")
    with scratch(docs.sparkSession):
        # Rows without doc_id speak only where no other does.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
        classes = signed.where("n_shingles > 0").groupBy("c1", "c2").agg(first.alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        flips = most_flips(percent / 100 - MARGIN)

        keyed = classes.select("cid", F.explode("bands").alias("band"))
        buckets = materialise(keyed.groupBy("band").agg(F.min("cid").alias("pivot"), F.max("cid").alias("last")).where("pivot < last").select("band", "pivot"), "buckets")
        stars = keyed.join(buckets, "band").where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
        stars = materialise(stars, "stars")
        verifier = _Verifier(docs, classes, shingle_words, percent)
        links = verifier.links(_close(stars, classes, flips))
        roots = components(links)
        joining = _across(verifier, stars, roots, flips, block)
        if joining.limit(1).count():
            roots = components(links.unionByName(joining))

        placed = classes.select("cid", "c1", "c2", "rep").join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        placed = materialise(placed, "placed")
        # Written, so that the join below has a plain shuffle on either side, which adaptive execution splits where a root is frequent.
        names = materialise(placed.groupBy("root").agg(F.min("rep").alias("keeper")), "names")
        named = materialise(placed.join(names, "root").select("c1", "c2", "keeper"), "components", keep=True)
    out = signed.select("doc_id", "key", "n_shingles", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("keeper.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.struct("keeper.doc_id", "keeper.key").alias("keeper"))


def near_duplicates(docs: DataFrame, shingle_words: int = WORDS, percent: int = SIMILARITY_PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    out = judged(docs, shingle_words, percent, block).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct(docs: DataFrame, shingle_words: int = WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs``, with their own columns, without near-duplicates: of each group the text of the smallest doc_id stays.

    Of different texts under one doc_id only those go that another text stands for, and of repeated rows (same doc_id and text) one
    stays. Rows without doc_id go where their text is a near copy; texts without words stay.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"))
    facts = judged(docs, shingle_words, percent).withColumn("stays", (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("key") == F.col("keeper.key"))))
    facts = materialise(facts.groupBy("doc_id", "key").agg(F.first("stays").alias("stays"), F.count("*").alias("n")), "verdicts")
    same = lambda t: F.col("_id").eqNullSafe(t["doc_id"]) & (F.col("_key") == t["key"])
    gone, twice = facts.where("NOT stays").hint("shuffle_hash"), facts.where("stays AND n > 1")
    kept = rows.join(gone, same(gone), "left_anti")
    if not twice.limit(1).count():
        return kept.select("_row.*")
    repeated = kept.join(twice, same(twice), "left_semi").groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
    return kept.join(twice, same(twice), "left_anti").select("_row.*").unionByName(repeated.select("_row.*"))

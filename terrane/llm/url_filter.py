"""URL filter: a memory-mapped sorted array of 64-bit digests, probed by vectorised binary search.

Rules are pairs of host and path prefix. Their keys, ``host + path``, are hashed with xxhash64, sorted,
and stored as one flat file: digests, rule numbers, key offsets, key bytes. Executors get the file through Spark's own file
distribution, map it into memory, and probe the digests of every host suffix and path prefix of a URL; the stored string
of each hit is compared with the candidate, so that a digest collision can't decide.

Host and path are column functions. Rule sets beyond
``MAX_INDEX_BYTES`` are cut into shards by the digests' leading bits; distinct candidates are then dealt by those bits too,
and each shard is searched in its own task (cogrouped), so that no executor holds the whole rule set.

Cases: a null URL, or one without ``://``, has an empty host and an empty path and fits no rule. Repeated rules count once
(of contradicting ones the blocking one). Repeated rows are judged each for itself. An empty rule set allows everything.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an index file that each executor may map whole.
MAX_INDEX_BYTES = 256 << 20
#: Keys in one shard of a larger index.
SHARD_KEYS = 1 << 20
SEED = 42  # the one of Spark's xxhash64()


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _keys(rules: DataFrame) -> DataFrame:
    key = F.concat(F.lower("host"), F.col("path"))
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
        .groupBy(key.alias("key"))
        .agg(F.max("verdict").alias("verdict"), F.min(F.length("path")).alias("path_chars"))
        .withColumn("digest", F.xxhash64("key"))
    )


class DigestIndex:
    """Sorted digests, verdicts and keys, in memory or mapped from a file."""

    def __init__(self, digests: np.ndarray, block: np.ndarray, offsets: np.ndarray, blob) -> None:
        self.digests, self.block, self.offsets, self.blob = digests, block, offsets, blob

    @classmethod
    def build(cls, digests: np.ndarray, keys: list[str], block: np.ndarray) -> DigestIndex:
        order = np.argsort(digests, kind="stable")
        raw = [keys[i].encode() for i in order]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        return cls(digests[order].astype(np.int64), block[order].astype(np.uint8), offsets, np.frombuffer(b"".join(raw), np.uint8))

    def save(self, path: str) -> None:
        with open(path, "wb") as out:
            np.array([len(self.digests), len(self.blob)], np.int64).tofile(out)
            for part in (self.digests, self.offsets, self.block, self.blob):
                part.tofile(out)

    @classmethod
    def load(cls, path: str) -> DigestIndex:
        n, size = (int(x) for x in np.fromfile(path, np.int64, 2))
        kinds, at, parts = ((np.int64, n), (np.int64, n + 1), (np.uint8, n), (np.uint8, size)), 16, []
        for kind, count in kinds:
            parts.append(np.memmap(path, kind, "r", at, (count,)) if count else np.zeros(0, kind))
            at += count * np.dtype(kind).itemsize
        return cls(parts[0], parts[2], parts[1], parts[3])

    def find(self, digests: np.ndarray, keys: list[str]) -> np.ndarray:
        """Row of each candidate in the index, or -1; every hit is confirmed against the stored key."""
        found = np.full(len(digests), -1, np.int64)
        if not len(self.digests) or not len(digests):
            return found
        low = np.searchsorted(self.digests, digests, "left")
        for i in np.flatnonzero(self.digests[np.minimum(low, len(self.digests) - 1)] == digests):
            raw, at = keys[i].encode(), int(low[i])
            while at < len(self.digests) and self.digests[at] == digests[i]:
                if bytes(self.blob[self.offsets[at] : self.offsets[at + 1]]) == raw:
                    found[i] = at
                    break
                at += 1
        return found


def _candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of each host suffix (at label borders) with each path prefix of a length that rules have."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.transform(pairs, lambda k: F.struct(k.alias("key"), F.xxhash64(k).alias("digest")))


def apply_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages`` (columns of these names are replaced).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest key wins.
    """
    keys = _keys(rules).persist()
    facts = keys.agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes"), F.collect_set("path_chars").alias("lengths")).first()
    lengths = sorted(facts["lengths"])
    if facts["n"] == 0:
        keys.unpersist()
        return _parts(pages, url_col).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    out = _parts(pages, url_col)
    if 25 * facts["n"] + facts["bytes"] <= max_index_bytes:
        hit = _mapped_probe(pages.sparkSession, keys, lengths)(F.col("host"), F.col("path"))
        keys.unpersist()
    else:
        return _sharded(out, _candidates(F.col("host"), F.col("path"), lengths), keys, facts["n"], default)
    return (
        out.withColumn("_hit", hit)
        .withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce("_hit.verdict", F.lit(default))})
        .drop("_hit")
    )


def _parts(pages: DataFrame, url_col: str) -> DataFrame:
    url = F.col(url_col)
    return pages.withColumns({"host": F.coalesce(host_of(url), F.lit("")), "path": F.coalesce(path_of(url), F.lit(""))})


def _keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    labels = host.split(".")
    prefixes = [path[:n] for n in lengths if n <= len(path)]
    return [".".join(labels[i:]) + prefix for i in range(len(labels)) for prefix in prefixes]


def _mapped_probe(spark: SparkSession, keys: DataFrame, lengths: list[int]):
    """A column function of host and path that probes an index file which every executor maps."""
    rows = keys.select("key", "digest", "verdict").toPandas()  # at most max_index_bytes
    index = DigestIndex.build(rows["digest"].to_numpy(np.int64), list(rows["key"]), (rows["verdict"] == "block").to_numpy())
    folder = tempfile.mkdtemp(prefix="terrane-index-")
    name = os.path.basename(folder) + ".bin"
    index.save(os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))

    @F.arrow_udf("rule string, verdict string")
    def probe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        mapped = DigestIndex.load(SparkFiles.get(name))
        for hosts, paths in batches:
            asked = [_keys_of(h, p, lengths) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            texts = [key for own in asked for key in own]
            digests = np.array([xxhash.xxh64_intdigest(key.encode(), SEED) for key in texts], np.uint64).view(np.int64)
            at = mapped.find(digests, texts)
            owner = np.repeat(np.arange(len(asked)), [len(own) for own in asked])
            rule: list = [None] * len(asked)
            verdict: list = [None] * len(asked)
            for i in np.flatnonzero(at >= 0):
                row = owner[i]
                if rule[row] is None or len(texts[i]) > len(rule[row]):
                    rule[row], verdict[row] = texts[i], "block" if mapped.block[at[i]] else "allow"
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["rule", "verdict"])

    return probe


def _sharded(out: DataFrame, wanted: Column, keys: DataFrame, n: int, default: str) -> DataFrame:
    """The same search with the index in shards: distinct candidates meet their shard, answers return by host and path."""
    bits = max(1, math.ceil(math.log2(n / SHARD_KEYS + 1)))
    shard = lambda c: F.shiftrightunsigned(c, 64 - bits)
    urls = out.select("host", "path").distinct()
    asked = urls.withColumn("c", F.explode(wanted)).select("host", "path", "c.key", "c.digest")
    distinct = asked.select("key", "digest").distinct().withColumn("shard", shard(F.col("digest")))

    def search(stored: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        index = DigestIndex.build(stored["digest"].to_numpy(np.int64), list(stored["key"]), (stored["verdict"] == "block").to_numpy())
        texts = list(probes["key"])
        at = index.find(probes["digest"].to_numpy(np.int64), texts)
        hit = np.flatnonzero(at >= 0)
        return pd.DataFrame({"key": [texts[i] for i in hit], "verdict": np.where(index.block[at[hit]] == 1, "block", "allow")})

    found = keys.withColumn("shard", shard(F.col("digest"))).groupBy("shard").cogroup(distinct.groupBy("shard")).applyInPandas(search, "key string, verdict string")
    best = asked.join(found, "key").groupBy("host", "path").agg(F.max_by(F.struct(F.col("key").alias("rule"), "verdict"), F.length("key")).alias("_hit"))
    return (
        out.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce("_hit.verdict", F.lit(default))})
        .drop("_hit")
    )

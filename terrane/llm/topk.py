"""Exact top-k by inner product: a three-phase uniform threshold over vertical slices of the vectors.

The score of a candidate is the sum of its scores in ``SLICES`` slices of the dimensions; a slice's list holds all local scores of a query.

1. Gather: each list gives its best k local entries among one in ``GATHER`` candidates (some blocks, dealt by hash); their full scores
   bound the k-th best of all from below.
2. Cutoff: a candidate that reaches that bound has a local score of at least bound / ``SLICES`` in some list. The cutoff goes to
   all lists, which collect every entry at or above it. A candidate's collected scores, plus what is just under the cutoff for each list
   that didn't collect it, bound it from above; those below the lower bound go.
3. Resolve: what remains and lacks a local score gets it by look-up, and the exact best k are chosen.

Candidates and queries are packed in blocks, matrices of the narrowest integers that hold all components. Query blocks stream past each
candidate block in tasks that Spark shuffles: all products are made once, and one in ``GATHER`` a second time. A stated query set against all
rows in blocks is no cross join. Equal vectors are one class, and a class answers with its k + 1 smallest ids, so copies cost nothing.

Components are floor(256 x) as integers; a null vector, or one with a null or non-finite component or one that doesn't fit a long, takes no
part. Scores beyond a long count as its largest or smallest. Vectors of different lengths are compared as if padded with
zeros. Ties go to the smaller id. Repeated rows (same id and vector) count once; rows without id take no part; of an id with several
vectors each is a query and a candidate of its own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.store import materialise

SLICES, GATHER = 2, 16
CANDIDATES_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 512
FACTOR = 256


def quantised(vectors: DataFrame, factor: int = FACTOR) -> DataFrame:
    """vec_id and v, the integer components of the vectors that take part."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(factor)) * c.cast("double")))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(float(factor)) * c.cast("double")) < 2.0**63))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select("vec_id", x.alias("v"))


def _blocks(classes: DataFrame, n: int, dims: int, kind: str, name: str) -> DataFrame:
    """Classes dealt into ``n`` groups by hash, each packed into one row: ids and a matrix."""

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        matrix = np.zeros((len(group), dims), kind)
        for row, v in enumerate(group["v"]):
            matrix[row, : len(v)] = v
        return pd.DataFrame({name: [group[name].iloc[0]], "ids": [group["class"].to_numpy(np.int64)], "matrix": [matrix.tobytes()]})

    dealt = classes.withColumn(name, F.pmod(F.xxhash64("v"), F.lit(n)).cast("int"))
    return dealt.groupBy(name).applyInPandas(packed, f"{name} int, ids array<long>, matrix binary")


def _local(candidates: np.ndarray, queries: np.ndarray, slices: int) -> list[np.ndarray]:
    """Scores of each query (rows) and candidate in each slice; exact, in floats where they hold the integers."""
    top = max(_largest(candidates) * _largest(queries) * max(1, candidates.shape[1]), 1)
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64 if top < 2**63 else object
    parts = np.array_split(np.arange(candidates.shape[1]), slices)
    out = [queries[:, part].astype(kind) @ candidates[:, part].astype(kind).T for part in parts]
    return out if kind is object else [x.astype(np.int64) for x in out]


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def _long(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else np.zeros((len(scores), 0), int)


def search(vectors: DataFrame, is_query, k: int = 5, slices: int = SLICES, factor: int = FACTOR) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the best ``k`` other rows for each row where ``is_query`` holds."""
    rows = materialise(quantised(vectors, factor).distinct(), "quantised")
    ids = rows.groupBy("v").agg(F.max(F.when(is_query, 1).otherwise(0)).alias("asked"))
    classes = materialise(ids.withColumn("class", F.monotonically_increasing_id()), "classes")
    sizes = F.max(F.greatest(-F.array_min("v"), F.array_max("v"))).alias("top")
    facts = classes.agg(F.count("*").alias("n"), F.sum("asked").alias("q"), F.max(F.size("v")).alias("dims"), sizes).first()
    if not facts["n"] or not facts["q"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, want, top = max(1, facts["dims"]), k + 1, facts["top"] or 0
    kind = "<i2" if 0 <= top < 2**15 else "<i4" if 0 <= top < 2**31 else "<i8"
    n_cand, n_query = -(-facts["n"] // CANDIDATES_PER_BLOCK), -(-facts["q"] // QUERIES_PER_BLOCK)
    candidates = materialise(_blocks(classes, n_cand, dims, kind, "cb"), "candidates")
    queries = materialise(_blocks(classes.where("asked = 1"), n_query, dims, kind, "qb"), "queries")

    def matrix(ids, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, kind).reshape(len(ids), -1)

    def streamed(blocks: DataFrame, met: DataFrame, work, schema: str) -> DataFrame:
        """``work`` on every block of queries and block of candidates that ``met`` (qb, cb) names: the queries stream past the candidates."""
        sent = blocks.join(met, "qb").select("cb", F.lit(1).alias("kind"), "qb", "ids", "matrix", "cut")
        held = candidates.join(met.select("cb").distinct(), "cb", "left_semi").select("cb", F.lit(0).alias("kind"), F.lit(0).alias("qb"), "ids", "matrix", F.lit(None).cast("array<struct<at:int,bound:long>>").alias("cut"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c_ids, c = None, None
            for batch in batches:
                for row in batch.itertuples(index=False):
                    ids = np.asarray(row.ids, np.int64)
                    if row.kind == 0:
                        c_ids, c = ids, matrix(ids, row.matrix)
                    else:
                        yield work(ids, c_ids, _local(c, matrix(ids, row.matrix), slices), row.cut)

        return held.unionByName(sent).repartition("cb").sortWithinPartitions("cb", "kind", "qb").mapInPandas(run, schema)

    def gather(q_ids, c_ids, local, cut) -> pd.DataFrame:
        total, take = sum(local), np.arange(len(q_ids))[:, None]
        found = []
        for scores in local:
            best = _best(scores, want)
            found.append(pd.DataFrame({"q": np.repeat(q_ids, best.shape[1]), "c": c_ids[best].ravel(), "score": _long(total[take, best]).ravel()}))
        return pd.concat(found)

    # Phase 1: the best entries of each list, from some blocks of candidates for each block of queries.
    some = max(1, n_cand // GATHER)
    met = queries.select("qb", F.explode(F.sequence(F.lit(0), F.lit(some - 1))).alias("i")).select("qb", F.pmod(F.col("qb") * some + F.col("i"), F.lit(n_cand)).alias("cb"))
    gathered = streamed(queries.withColumn("cut", F.lit(None).cast("array<struct<at:int,bound:long>>")), met, gather, "q long, c long, score long").distinct()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    bound = materialise(gathered.withColumn("r", F.row_number().over(best)).where(F.col("r") == want).select("q", F.col("score").alias("bound")), "bounds")

    # Phase 2: each block of queries takes its bounds along to all lists.
    member = queries.select("qb", F.posexplode("ids").alias("at", "q")).join(bound, "q")
    packed = member.groupBy("qb").agg(F.array_agg(F.struct("at", "bound")).alias("cut"))  # QUERIES_PER_BLOCK, about
    informed = queries.join(packed, "qb", "left")
    everywhere = queries.select("qb", F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))).alias("cb"))

    def collect(q_ids, c_ids, local, cut) -> pd.DataFrame:
        bound, bounded = np.zeros(len(q_ids), local[0].dtype), np.zeros((len(q_ids), 1), bool)
        for x in cut if cut is not None else ():
            bound[x["at"]], bounded[x["at"]] = x["bound"], True
        cutoff = -(-bound // slices)
        seen = [scores >= cutoff[:, None] for scores in local]
        missing = sum(~s for s in seen)
        high = sum(np.where(s, scores, (cutoff - 1)[:, None]) for s, scores in zip(seen, local))
        q_at, c_at = np.nonzero((missing < slices) & (high >= bound[:, None]) | ~bounded)
        # Phase 3, in place: this pair of blocks holds the lists in which a score is to be looked up.
        score = sum(part[q_at, c_at] for part in local)
        fine = (score >= bound[q_at]) | ~bounded[q_at, 0]
        return pd.DataFrame({"q": q_ids[q_at[fine]], "c": c_ids[c_at[fine]], "score": _long(score[fine])})

    pairs = streamed(informed, everywhere, collect, "q long, c long, score long")
    return _answers(rows, classes, pairs, is_query, k)


def _answers(rows: DataFrame, classes: DataFrame, pairs: DataFrame, is_query, k: int) -> DataFrame:
    """From classes back to rows: a class answers with its smallest ids; a query never with its own row."""
    members = Window.partitionBy("v").orderBy("vec_id")
    tied = Window.partitionBy("q").orderBy(F.desc("score"))
    small = rows.withColumn("m", F.row_number().over(members)).where(F.col("m") <= k + 1)
    named = small.join(classes.select("v", "class"), "v").select(F.col("class").alias("c"), "vec_id", "m")
    asked = rows.where(is_query).join(classes.select("v", "class"), "v").select(F.col("class").alias("q"), F.col("vec_id").alias("query_id"))
    # Of classes with the same score those with the smallest ids count: ranks go by score first, ids second.
    kept = pairs.withColumn("r", F.rank().over(tied)).where(F.col("r") <= k + 1).select("q", "c", "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    offers = kept.join(named, "c").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    final = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(offers, "q")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

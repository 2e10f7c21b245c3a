"""A Merkle manifest of a dataset: a digest for each row, a tree for each language, a tree over the trees, and proofs.

A leaf is the SHA-256 of a row's columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The leaves of a language ascend
by doc_id; every ``RUN`` consecutive nodes of a level (the last run may be shorter) become the SHA-256 of their hex digests, until
one is left, the language's subroot. Subroots, ordered by language (null first, then by bytes), give the root likewise.

Rows get their place in their tree from a range partitioning, whose counts before each range are summed in Spark. Then trees are climbed in
buckets of ``RUN ** LEVELS`` aligned nodes: an executor hands a bucket's Arrow table to DuckDB, whose level queries (ordered ``string_agg``,
``sha256``) leave the bucket's root. Bucket roots are nodes again, for the next round, as long as a tree has several. On the way down each
bucket meets the proof of its own root, and DuckDB puts its rows' siblings before it: no proof is ever shuffled. A bucket's size
is fixed, so a language with most of the rows is more buckets, not a larger one.

Cases: null and empty values differ (``-`` and ``0:``). Rows without doc_id come first in their tree. Of equal doc_ids the smaller
leaf comes first; equal rows are equal leaves, each with its place. Texts are hashed whole where they are read and don't move. An
empty table gives no rows. Other columns than those named are ignored, whatever their names.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.store import materialise

RUN, LEVELS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PROOF = "array<struct<before: string, after: string>>"


def leaf_digest(columns: list[Column]) -> Column:
    """The leaf of a row with these values, in this order."""
    one = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*one), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.concat(run["before"], node, run["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(run["before"], run["after"])), ""), 256)


def manifest(docs: DataFrame, presented: Column | None = None, columns: tuple[str, ...] = COLUMNS, tree: str = "lang", order: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """``order``, position (in the tree, from 0), leaf, presented, subroot, root and proof (a run's siblings before and after the node, level by
    level) of each row. ``presented``: a leaf that someone shows for the row, to be folded; the row's own if none is given. ``levels``: of a bucket.
    """
    leaf = leaf_digest([F.col(c) for c in columns])
    rows = docs.select(F.coalesce(F.concat(F.lit(":"), tree), F.lit("")).alias("_tree"), F.col(order).alias("_order"), leaf.alias("_digest"), (leaf if presented is None else F.coalesce(presented, leaf)).alias("_presented"))
    size = RUN**levels
    nodes = _placed(materialise(rows, "leaves"), ["_order", "_digest"])
    most = nodes.agg(F.max("_total")).first()[0] or 1
    heights = _climbed(nodes, most, size)
    tops = _placed(heights.pop().select(F.lit("").alias("_tree"), F.col("_tree").alias("_order"), "_digest"), ["_order"])
    outer = _climbed(tops, tops.count(), size)
    above = outer.pop().select("_tree", "_position", F.array().cast(_PROOF).alias("_proof"), F.lit("").alias("_subroot"), F.col("_digest").alias("_root"))
    for below in reversed(outer[1:]):
        above = _proved(below, above, size)
    trees = _proved(outer[0], above, size, ["_order"])
    above = trees.select(F.col("_order").alias("_tree"), F.lit(0).cast("long").alias("_position"), "_proof", F.col("_digest").alias("_subroot"), "_root")
    for below in reversed(heights[1:]):
        above = _proved(below, above, size)
    out = _proved(heights[0], above, size, ["_order", "_presented"])
    return out.select(F.col("_order").alias(order), F.col("_position").alias("position"), F.col("_digest").alias("leaf"), F.col("_presented").alias("presented"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_proof").alias("proof"))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with _position in their tree, from 0, and the tree's _total. Equal rows may take each other's place, so they spread over ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(n, "_tree", *order, "_salt").sortWithinPartitions("_tree", *order).drop("_salt")
    numbered = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # the ranges must not be drawn anew
    part = F.shiftright("_at", 33)
    by_part = numbered.groupBy("_tree", part.alias("_part")).agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    tree = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_part.select("_tree", "_part", (before - F.col("_start")).alias("_shift"), F.sum("_n").over(tree).alias("_total"))  # a row a range and tree
    placed = numbered.withColumn("_part", part).join(starts, ["_tree", "_part"])
    return materialise(placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_position"), "_total"), "nodes")


def _bucket(size: int) -> Column:
    return F.floor(F.col("_position") / F.lit(size)).cast("long").alias("_bucket")


def _climbed(nodes: DataFrame, most: int, size: int) -> list[DataFrame]:
    """The nodes, their buckets' roots, the roots of these, and so on: last a node for each tree. ``most``: nodes of the largest tree."""

    def climb(bucket: pa.Table) -> pa.Table:
        return _root_of_bucket(bucket, size)

    heights = [nodes]
    while len(heights) == 1 or most > 1:
        up = heights[-1].select("_tree", "_position", "_total", "_digest").groupBy("_tree", _bucket(size)).applyInArrow(climb, "_tree string, _position long, _total long, _digest string")
        heights.append(materialise(up, "roots"))
        most = -(-most // size)
    return heights


def _proved(nodes: DataFrame, above: DataFrame, size: int, keep: list[str] | None = None) -> DataFrame:
    """Nodes with their proofs: the siblings in their bucket, then the proof of the bucket's root."""
    keep = keep or []
    fields = "_tree string, _position long, _digest string, " + "".join(f"{c} {nodes.schema[c].dataType.simpleString()}, " for c in keep)
    buckets = nodes.select("_tree", "_position", "_total", "_digest", *keep).groupBy("_tree", _bucket(size))
    met = above.select("_tree", "_position", "_proof", "_subroot", "_root").groupBy("_tree", F.col("_position").alias("_bucket"))

    def prove(bucket: pa.Table, root: pa.Table) -> pa.Table:
        return _proofs_of_bucket(bucket, root, size, keep)

    return buckets.cogroup(met).applyInArrow(prove, f"{fields}_proof {_PROOF}, _subroot string, _root string")


@functools.cache
def _engine():
    """A worker's DuckDB: one thread, bounded memory, no files."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})


def _steps(bucket: pa.Table, size: int) -> int:
    """Levels to climb in a bucket: until one node is left, or, where the tree has several buckets, as many as a full one has."""
    total = bucket["_total"][0].as_py()
    left, steps = size if total > size else total, 0
    while left > 1:
        left, steps = -(-left // RUN), steps + 1
    return steps


def _level_queries(steps: int) -> str:
    """CTEs of each level's runs (r0, r1, ...) and nodes (l0, l1, ...)."""
    out = ["l0 AS MATERIALIZED (SELECT _position AS pos, _digest AS digest FROM bucket)"]
    for k in range(steps):
        out.append(f"r{k} AS MATERIALIZED (SELECT pos // {RUN} AS pos, string_agg(digest, '' ORDER BY pos) AS run FROM l{k} GROUP BY pos // {RUN})")
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT pos, sha256(run) AS digest FROM r{k})")
    return "WITH " + ", ".join(out)


def _run(sql: str, tables: dict[str, pa.Table]) -> pa.Table:
    con = _engine()
    for name, rows in tables.items():
        con.register(name, rows)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        for name in tables:
            con.unregister(name)


def _root_of_bucket(bucket: pa.Table, size: int) -> pa.Table:
    steps = _steps(bucket, size)
    facts = f"(SELECT any_value(_tree) AS _tree, min(_position) // {size} AS _position, (any_value(_total) + {size - 1}) // {size} AS _total FROM bucket)"
    return _run(f"{_level_queries(steps)} SELECT facts.*, digest AS _digest FROM l{steps} CROSS JOIN {facts} AS facts", {"bucket": bucket})  # a row of each


def _proofs_of_bucket(bucket: pa.Table, root: pa.Table, size: int, keep: list[str]) -> pa.Table:
    joins, own = "", []
    steps = _steps(bucket, size)
    for k in range(steps):
        place = f"64 * (b._position // {RUN**k} % {RUN})"
        own.append(f"{{'before': substr(r{k}.run, 1, {place}), 'after': substr(r{k}.run, {place} + 65)}}")
        joins += f" JOIN r{k} ON r{k}.pos = b._position // {RUN ** (k + 1)}"
    columns = ", ".join(f"b.{c}" for c in ["_tree", "_position", "_digest", *keep])
    proof = f"list_concat([{', '.join(own)}], root._proof)" if own else "root._proof"
    sql = f"{_level_queries(steps)} SELECT {columns}, {proof} AS _proof, root._subroot, root._root FROM bucket b{joins} CROSS JOIN root"  # root has one row
    return _run(sql, {"bucket": bucket, "root": root})

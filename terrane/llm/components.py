"""Connected components of a table of links, in rounds of hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.store import materialise


def _rooted(parents: DataFrame) -> DataFrame:
    """Parents followed to the roots: each step doubles the distance that a pointer spans."""
    while True:
        up = parents.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = parents.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved"))
        jumped = materialise(jumped, "jumped")
        parents = jumped.select("id", "root")
        if not jumped.where("moved").limit(1).count():
            return parents


def components(links: DataFrame) -> DataFrame:
    """id and root, the smallest id reachable, of every end of the links (columns a and b, longs).

    In each round every id hooks to its smallest neighbour, pointers are followed to the roots, and links are carried over
    to the roots; links within a root go. At least half of the ids that still have links go in each round. All tables
    stay distributed; the driver only learns whether links are left.
    """
    found = None
    left = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    while True:
        if found is not None and not left.limit(1).count():
            return found
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("root"))
        roots = _rooted(materialise(hooks, "hooks"))  # written: a frequent root then meets plain shuffles, which adaptive execution splits
        at = lambda name: roots.select(F.col("id").alias(name), F.col("root").alias(f"r{name}"))
        carried = left.join(at("a"), "a").join(at("b"), "b")
        left = materialise(carried.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct(), "links")
        if found is None:
            found = roots
        else:
            found = found.join(roots.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))

"""Places in an order without a task that sees all rows: rows are sorted by ranges, and the counts of ranges add up.

The ranges are written before they are counted: Spark draws their bounds from a sample, anew each time it evaluates them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.sources.tables import cut_lineage


def numbered(rows: DataFrame, order: list[str], groups: list[str] | None = None) -> DataFrame:
    """The rows with _at, their place from 0 by ``order`` (ascending) in their group, and _all, how many rows the group has.

    Equal rows take places in any order, so that a frequent value spreads over several ranges. Null keys are a group like others.
    """
    groups = groups or []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(n, *groups, *order, "_salt")
    ranged = cut_lineage(salted.sortWithinPartitions(*groups, *order).drop("_salt").withColumn("_row", F.monotonically_increasing_id()), "ranged")
    # The number of a row has its partition in the upper bits and its place there in the lower 33.
    part = F.shiftright("_row", 33)
    sizes = ranged.groupBy(*groups, part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(g).alias(f"_of_{i}") for i, g in enumerate(groups)], "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_all"))  # a row a range and group
    own = F.col("_part") == F.shiftright("_row", 33)
    for i, g in enumerate(groups):
        own = own & F.col(g).eqNullSafe(F.col(f"_of_{i}"))
    placed = ranged.join(starts, own)
    return placed.select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("_at"), "_all")


def quantiles(rows: DataFrame, keys: list[str], x: str, wanted: dict[str, float]) -> DataFrame:
    """keys and the quantiles of each group, interpolated between neighbours; nulls don't count, and groups of nulls are left out."""
    placed = numbered(rows.select(*keys, F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL"), ["_x"], keys)
    spots = {name: F.lit(q) * (F.col("_all") - 1) for name, q in wanted.items()}
    asked = F.lit(False)
    for spot in spots.values():
        asked = asked | (F.col("_at") == F.floor(spot)) | (F.col("_at") == F.ceil(spot))
    low = {name: F.max(F.when(F.col("_at") == F.floor(spot), F.col("_x"))) for name, spot in spots.items()}
    high = {name: F.max(F.when(F.col("_at") == F.ceil(spot), F.col("_x"))) for name, spot in spots.items()}
    part = {name: F.max(spot - F.floor(spot)) for name, spot in spots.items()}
    return placed.where(asked).groupBy(*keys).agg(*[((1 - part[name]) * low[name] + part[name] * high[name]).alias(name) for name in wanted])  # two rows a quantile and group

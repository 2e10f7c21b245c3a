"""Look-ups, set operations, ordered assembly and ranking on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ranks import numbered


def assembled(members: DataFrame, keys: list[str], position: str, value: str, name: str, separator: str = " ") -> DataFrame:
    """The values of each key in order of position as one string; missing values are left out."""
    items = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(position, value))))
    return members.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x[value]), separator).alias(name))


def first_source_wins(sources: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Union in which, of rows with the same keys, that of the earliest source stays (within one: the first in order)."""
    ranked = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    union = ranked[0]
    for df in ranked[1:]:
        union = union.unionByName(df)
    first = Window.partitionBy(*keys).orderBy("_source", *order)
    return union.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_source")


def replaced(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` in the place of those with the same keys."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def distinct_in_order(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with how often each occurs and where first; "3× value" as label where it repeats."""
    out = rows.groupBy(value).agg(F.min(position).alias("first_position"), F.count("*").alias("times"))
    return out.withColumn("label", F.when(F.col("times") > 1, F.concat(F.col("times").cast("string"), F.lit("× "), F.col(value))).otherwise(F.col(value)))


def encoded(rows: DataFrame, key: str, name: str = "code") -> DataFrame:
    """Rows with the rank of their key among the sorted distinct keys, from 0. The keys are ranked apart from the rows."""
    return rows.join(numbered(rows.select(key).distinct(), [key]).select(key, F.col("_at").alias(name)), key)


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def sampled(rows: DataFrame, hash_column: Column, order: list[Column], n: int) -> DataFrame:
    """``n`` rows chosen by a hash of their keys: the same ones each time."""
    return rows.withColumn("_h", hash_column).orderBy("_h", *order).limit(n).drop("_h")


def capped_in_proportion(rows: DataFrame, group: str, order: list[Column], budget: int) -> DataFrame:
    """At most ``budget`` rows in all: each group keeps its share, rounded down; everything if there is room."""
    total = rows.count()
    if total <= budget:
        return rows
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_quota", F.floor(F.col("_n") * budget / F.lit(total)))
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).join(sizes, group).where("_r <= _quota").drop("_r", "_n", "_quota")


def weighted_choice(choosers: DataFrame, options: DataFrame, keys: list[str], option: str, weight: str, draw: Column) -> DataFrame:
    """For each chooser, the first option (in order) whose cumulative weight exceeds ``draw`` (0..1) times its group's total."""
    upto = Window.partitionBy(*keys).orderBy(option).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    scale = options.withColumns({"_to": F.sum(weight).over(upto), "_all": F.sum(weight).over(whole)}).withColumn("_from", F.col("_to") - F.col(weight))
    drawn = choosers.withColumn("_draw", draw)
    u = F.col("_draw") * F.col("_all")
    return drawn.join(scale, keys).where((u >= F.col("_from")) & (u < F.col("_to"))).drop("_draw", "_from", "_to", "_all", weight)

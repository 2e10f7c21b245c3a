"""Data-quality rules: findings with severities, the worst of each check, status roll-up, tolerances and comparison of runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Worse is greater. A check that could not run is skipped and weighs nothing.
RANK = {"SKIP": 0, "PASS": 1, "WARN": 2, "FAIL": 3}


@dataclass(frozen=True)
class Rule:
    """One check: ``severity`` is null where the row is fine; ``score`` sorts findings, larger is worse."""

    check: str
    severity: Column
    score: Column
    message: Column


def findings(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """check, severity, key, score, message: one row a rule that a row breaks, in one pass over the rows."""
    judged = [F.struct(F.lit(r.check).alias("check"), r.severity.alias("severity"), r.score.cast("double").alias("score"), r.message.cast("string").alias("message")) for r in rules]
    found = rows.select(F.col(key), F.explode(F.filter(F.array(*judged), lambda f: f["severity"].isNotNull())).alias("f"))
    return found.select("f.check", "f.severity", key, "f.score", "f.message")


def worst(found: DataFrame, key: str, n: int = 50) -> DataFrame:
    """The ``n`` worst findings of each check: failures before warnings, then by score, then by key."""
    weight = F.when(F.col("severity") == "FAIL", 2).otherwise(1)
    order = Window.partitionBy("check").orderBy(F.desc(weight), F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def statuses(found: DataFrame, checks: DataFrame) -> DataFrame:
    """check, status, fails and warns of every check of ``checks`` (check, ran)."""
    counts = found.groupBy("check").agg(F.count(F.when(F.col("severity") == "FAIL", 1)).alias("fails"), F.count(F.when(F.col("severity") == "WARN", 1)).alias("warns"))
    out = checks.join(counts, "check", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fails", "warns")})
    status = F.when(~F.col("ran"), "SKIP").when(F.col("fails") > 0, "FAIL").when(F.col("warns") > 0, "WARN").otherwise("PASS")
    return out.select("check", status.alias("status"), "fails", "warns")


def overall(status: DataFrame) -> DataFrame:
    """The worst status; SKIP only if every check was skipped."""
    rank = F.when(F.lit(False), F.lit(0))
    for name, value in RANK.items():
        rank = rank.when(F.col("status") == name, F.lit(value))
    return status.agg(F.max_by("status", rank).alias("status"), F.sum("fails").alias("fails"), F.sum("warns").alias("warns"))


def out_of_tolerance(values: DataFrame, references: DataFrame, keys: list[str], value: str, slack: float = 0.2) -> DataFrame:
    """Values outside (1 - slack) low .. (1 + slack) high of their reference (low, high)."""
    joined = values.join(references, keys)
    return joined.where((F.col(value) < (1 - slack) * F.col("low")) | (F.col(value) > (1 + slack) * F.col("high")))


def compared(now: DataFrame, before: DataFrame, key: str, rank_of: str = "status") -> DataFrame:
    """key, before, now and trend (better, worse, same, new, gone) of two runs' statuses."""
    rank = lambda c: F.element_at(F.create_map(*[x for name, v in RANK.items() for x in (F.lit(name), F.lit(v))]), F.col(c))
    both = now.select(key, F.col(rank_of).alias("now")).join(before.select(key, F.col(rank_of).alias("before")), key, "full")
    trend = (
        F.when(F.col("before").isNull(), "new")
        .when(F.col("now").isNull(), "gone")
        .when(rank("now") > rank("before"), "worse")
        .when(rank("now") < rank("before"), "better")
        .otherwise("same")
    )
    return both.select(key, "before", "now", trend.alias("trend"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

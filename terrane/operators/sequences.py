"""Operators along ordered rows: distances, lags, running medians, runs, sessions, gap filling, lazy decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from terrane.operators.folds import folded


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970, of timestamps with or without time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def along(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running_length(rows: DataFrame, keys: list[str], order: list[str], x: str, z: str, name: str = "s") -> DataFrame:
    """Length of the polyline up to each point."""
    w = along(keys, order)
    dx, dz = F.col(x) - F.lag(x).over(w), F.col(z) - F.lag(z).over(w)
    step = rows.withColumn("_d", F.coalesce(F.sqrt(dx * dx + dz * dz), F.lit(0.0)))
    return step.withColumn(name, F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def change(rows: DataFrame, keys: list[str], order: list[str], x: str, back: int = 1, name: str = "change") -> DataFrame:
    """x less its value ``back`` rows before."""
    return rows.withColumn(name, F.col(x) - F.lag(x, back).over(along(keys, order)))


def running_median(rows: DataFrame, keys: list[str], order: list[str], x: str, reach: int = 2, name: str = "median") -> DataFrame:
    """Median over ``reach`` rows to either side; at the ends the end value stands for missing rows."""
    w = along(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(x).over(whole), F.last(x).over(whole)
    near = [F.coalesce(F.lag(x, k).over(w), first) for k in range(reach, 0, -1)] + [F.col(x)] + [F.coalesce(F.lead(x, k).over(w), last) for k in range(1, reach + 1)]
    return rows.withColumn(name, F.element_at(F.array_sort(F.array(*near)), reach + 1))


def runs(rows: DataFrame, keys: list[str], order: list[str], keep: Column) -> DataFrame:
    """The rows that are kept, with the number of their contiguous run within the group, from 1."""
    w = along(keys, order)
    marked = rows.withColumn("_k", F.coalesce(keep, F.lit(False)))
    begins = F.col("_k") & ~F.coalesce(F.lag("_k").over(w), F.lit(False))
    return marked.withColumn("run", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_k").drop("_k")


def sessions(rows: DataFrame, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Rows with the number of their session; a gap of more than ``gap_seconds`` opens a new one."""
    w = along(keys, [ts])
    opens = F.coalesce(micros(ts) - F.lag(micros(ts)).over(w) > gap_seconds * 1_000_000, F.lit(True))
    return rows.withColumn("_o", opens.cast("int")).withColumn("session", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def filled_hours(rows: DataFrame, keys: list[str], hour: str, most_hours: int) -> DataFrame:
    """A row for every missed hour before a row (dt = 1), as long as at most ``most_hours`` were missed; else one row with the gap as dt."""
    w = along(keys, [hour])
    gap = (F.unix_timestamp(hour) - F.unix_timestamp(F.lag(hour).over(w))) / 3600
    marked = rows.select(*keys, hour).distinct().withColumn("_gap", F.coalesce(gap.cast("long"), F.lit(1)))
    hours = F.when(F.col("_gap") <= most_hours, F.sequence(F.lit(0), F.col("_gap").cast("int") - 1)).otherwise(F.array(F.lit(0)))
    out = marked.withColumn("_b", F.explode(hours)).withColumn(hour, F.timestamp_seconds(F.unix_timestamp(hour) - F.col("_b") * 3600))
    return out.withColumn("dt", F.when(F.col("_gap") <= most_hours, F.lit(1)).otherwise(F.col("_gap"))).drop("_gap", "_b")


def coarse_steps(rows: DataFrame, keys: list[str], hour: str, hours: int, means: list[str], sums: list[str]) -> DataFrame:
    """Hours taken together to steps of ``hours``: how many there are (dt), the means of what lasts and the sums of what falls."""
    step = F.timestamp_seconds(F.floor(F.unix_timestamp(hour) / (3600 * hours)) * (3600 * hours)).alias("step")
    return rows.groupBy(*keys, step).agg(F.count("*").alias("dt"), *[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums])


def cooled_down(rows: DataFrame, keys: list[str], ts: str, seconds: int, id_col: str) -> DataFrame:
    """Rows at least ``seconds`` after the last row kept of their group. What is kept depends on all rows before, so that each
    group is folded in order: times and ids stream, not the rows themselves."""

    def step(last: int | None, t: int) -> tuple:
        keep = last is None or t - last >= seconds * 1_000_000
        return t if keep else last, (keep,)

    times = rows.select(*keys, id_col, micros(ts).alias("_t"))
    kept = folded(times, keys, ["_t", id_col], ["_t"], lambda: None, step, {"_keep": "boolean"}).where("_keep").select(id_col)
    return rows.join(kept, id_col, "left_semi")


def decayed(last_touch: Column, now: Column, value: Column, tau_days: float, ttl_days: float) -> Column:
    """value * exp(-age / tau), null (expired) beyond ``ttl_days``."""
    age = (micros(now) - micros(last_touch)) / 86_400_000_000.0
    return F.when(age <= ttl_days, value * F.exp(-age / tau_days))

"""Aggregations and statistics with the tie, rounding and emptiness rules of each operator in its name or docstring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.ranks import numbered, quantiles


def mean_or_zero(x: str | Column) -> Column:
    """Sum over count, 0 where nothing is counted."""
    return F.coalesce(F.sum(x), F.lit(0.0)) / F.greatest(F.count(x), F.lit(1))


def mode_lowest(rows: DataFrame, keys: list[str], value: str, name: str, empty=None) -> DataFrame:
    """The most frequent value of each group; the lowest of equally frequent ones; ``empty`` where all are null."""
    counts = rows.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    best = F.min_by(value, F.struct(-F.col("_n"), F.col(value)))
    out = counts.groupBy(*keys).agg(best.alias(name))
    return out if empty is None else out.withColumn(name, F.coalesce(name, F.lit(empty)))


def upper_medians(rows: DataFrame, keys: list[str], x: str, name: str = "upper", least: int = 5) -> DataFrame:
    """Element n/2 (from 0) of each group's sorted values; null with fewer than ``least``. Nulls don't count."""
    placed = numbered(rows.select(*keys, x).where(F.col(x).isNotNull()), [x], keys)
    found = placed.where((F.col("_all") >= least) & (F.col("_at") == F.floor(F.col("_all") / 2))).select(*keys, F.col(x).alias(name))
    return rows.select(*keys).distinct().join(found, keys, "left")


def z_scores(rows: DataFrame, keys: list[str], x: str, name: str = "z", floor: float = 1e-9) -> DataFrame:
    """(x - median) / population standard deviation within each group, the latter ``floor`` at least."""
    facts = quantiles(rows, keys, x, {"_m": 0.5}).join(rows.groupBy(*keys).agg(F.stddev_pop(x).alias("_s")), keys)
    return rows.join(facts, keys).withColumn(name, (F.col(x) - F.col("_m")) / F.greatest("_s", F.lit(floor))).drop("_m", "_s")


def shares(rows: DataFrame, keys: list[str], weight: Column, cell_area: float = 1.0) -> DataFrame:
    """Count, area and percentage of each group in the total; the total is one row, joined by broadcast."""
    groups = rows.groupBy(*keys).agg(F.sum(weight).alias("n"))
    total = groups.agg(F.sum("n").alias("_total"))
    return groups.where("n > 0").crossJoin(F.broadcast(total)).withColumns({"area": F.col("n") * cell_area, "percent": 100.0 * F.col("n") / F.col("_total")}).drop("_total")


def trimmed_regression(rows: DataFrame, keys: list[str], y: str, x: str, sigmas: float = 2.5) -> DataFrame:
    """Least squares in two rounds: residuals beyond ``sigmas`` standard deviations don't count in the second."""
    fit = lambda df: df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))
    residual = F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))
    judged = rows.join(fit(rows), keys).withColumn("_r", residual)
    spread = judged.groupBy(*keys).agg(F.stddev_pop("_r").alias("_s"))
    kept = judged.join(spread, keys).where(F.abs("_r") <= sigmas * F.col("_s")).drop("slope", "intercept", "n")
    return fit(kept)


def affine_fit(rows: DataFrame, x: str, z: str, u: str) -> DataFrame:
    """Coefficients a, b, c of u = a x + b z + c by the normal equations: one pass of sums, solved in place."""
    X, Z, U = F.col(x), F.col(z), F.col(u)
    m = rows.agg(
        F.count("*").cast("double").alias("n"),
        *[F.sum(e).alias(k) for k, e in {"sx": X, "sz": Z, "su": U, "xx": X * X, "zz": Z * Z, "xz": X * Z, "xu": X * U, "zu": Z * U}.items()],
    )
    c = F.col
    xx, zz, xz = c("xx") - c("sx") * c("sx") / c("n"), c("zz") - c("sz") * c("sz") / c("n"), c("xz") - c("sx") * c("sz") / c("n")
    xu, zu = c("xu") - c("sx") * c("su") / c("n"), c("zu") - c("sz") * c("su") / c("n")
    det = xx * zz - xz * xz
    return m.select(((xu * zz - zu * xz) / det).alias("a"), ((zu * xx - xu * xz) / det).alias("b"), "sx", "sz", "su", "n").select(
        "a", "b", ((c("su") - c("a") * c("sx") - c("b") * c("sz")) / c("n")).alias("c")
    )


def affine_residual(rows: DataFrame, fit: DataFrame, x: str, z: str, u: str) -> DataFrame:
    """The largest distance of u from the fit (one row: a, b, c), and how many rows it covers."""
    off = F.abs(F.col(u) - (F.col("a") * F.col(x) + F.col("b") * F.col(z) + F.col("c")))
    return rows.crossJoin(F.broadcast(fit)).agg(F.max(off).alias("residual"), F.count("*").alias("n"))


def weighted_mean(x: Column, weight: Column) -> Column:
    return F.sum(x * weight) / F.sum(weight)


def best_model(rows: DataFrame, keys: list[str], model: str, error: str, complexity: str, penalty: float) -> DataFrame:
    """The model with the least error, to which each unit of complexity adds ``penalty``; the first name of equal ones."""
    scored = rows.withColumn("_e", F.col(error) + penalty * F.col(complexity))
    return scored.groupBy(*keys).agg(F.min_by(model, F.struct("_e", model)).alias(model), F.min("_e").alias("penalised"))


def overlap_ratio(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection over union of two sets of cells."""
    marks = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    return marks.agg((F.sum(F.coalesce(F.col("_a") * F.col("_b"), F.lit(0))) / F.greatest(F.count("*"), F.lit(1))).alias("iou"))


def best_shift(a: DataFrame, b: DataFrame, shifts: list[tuple[int, int]]) -> DataFrame:
    """dx, dz and iou of the shift of cells ``a`` (ix, iz) that covers cells ``b`` best; of equally good ones the first of the list."""
    moves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for k, (dx, dz) in enumerate(shifts)])
    moved = a.select("ix", "iz").distinct().withColumn("_m", F.explode(moves)).select((F.col("ix") + F.col("_m.dx")).alias("ix"), (F.col("iz") + F.col("_m.dz")).alias("iz"), "_m")
    other = b.select("ix", "iz").distinct()
    shared = moved.join(other.withColumn("_in", F.lit(1)), ["ix", "iz"], "left").groupBy("_m").agg(F.count("_in").alias("_both"), F.count("*").alias("_a"))
    scored = shared.crossJoin(F.broadcast(other.agg(F.count("*").alias("_b"))))  # one row
    iou = F.col("_both") / F.greatest(F.col("_a") + F.col("_b") - F.col("_both"), F.lit(1))
    return scored.agg(F.max_by(F.struct("_m.dx", "_m.dz", iou.alias("iou")), F.struct(iou, -F.col("_m.k"))).alias("_r")).select("_r.*")


def snapped_extent(rows: DataFrame, x: str, z: str, origin: float, step: float) -> DataFrame:
    """Bounds, moved outwards to whole steps from an origin."""
    low = lambda c: origin + F.floor((F.min(c) - origin) / step) * step
    high = lambda c: origin + F.ceil((F.max(c) - origin) / step) * step
    return rows.agg(low(x).alias("x0"), high(x).alias("x1"), low(z).alias("z0"), high(z).alias("z1"))


def first_crossing(rows: DataFrame, keys: list[str], order: str, amount: Column, threshold: Column) -> DataFrame:
    """The first position at which each group's running sum reaches the threshold."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_c", F.sum(amount).over(w)).where(F.col("_c") >= threshold).groupBy(*keys).agg(F.min(order).alias("reached"))

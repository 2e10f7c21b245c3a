"""How figures lie on others of the same name: the turn and shift under which their cells cover each other best.

For all figures at once: four quarter turns first, then rounds of small turns and of shifts. A candidate's turned cells meet the other
figure's by equal keys. Shifts are whole cells, so that those of a round are one correlation: each pair of cells that are near enough counts
for the shift between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.sources.tables import cut_lineage

# Degrees of the small turns and how many to either side, rounds, and overlaps (and lead over the second quarter turn) of the confidence classes.
TURN, TURNS, ROUNDS = 0.5, 8, 2
HIGH, LEAD, MEDIUM = 0.8, 0.1, 0.65

_c = F.col


def aligned(own: DataFrame, other: DataFrame, figure: str, base: DataFrame, cell: float, reach: int) -> DataFrame:
    """figure, theta (degrees), dx and dz (cells), iou, second (the next best quarter turn's overlap) and confidence.

    ``own`` are points (figure, x, z), the middles of a figure's cells; ``other`` cells (figure, ix, iz) of size ``cell``; ``base`` (figure, base) the turn to
    start from. Points turn about their mean, which is put on that of the other's cells; shifts of a round are up to ``reach`` cells. Of equal
    overlaps what is there stays, else the first in order. Figures that one side lacks are left out.
    """
    cells = cut_lineage(other.select(figure, "ix", "iz").distinct(), "other")
    centre = cells.groupBy(figure).agg((F.avg(_c("ix") + 0.5) * cell).alias("_bx"), (F.avg(_c("iz") + 0.5) * cell).alias("_bz"), F.count("*").alias("_nb"))
    mean = own.groupBy(figure).agg(F.avg("x").alias("_mx"), F.avg("z").alias("_mz"))
    points = cut_lineage(own.join(mean, figure).join(centre, figure).select(figure, (_c("x") - _c("_mx")).alias("_x"), (_c("z") - _c("_mz")).alias("_z"), "_bx", "_bz", "_nb"), "points")

    def turned(candidates: DataFrame) -> DataFrame:
        c, s = F.cos(F.radians("theta")), F.sin(F.radians("theta"))
        at = lambda v, shift: (F.floor(v / cell).cast("long") + _c(shift))
        placed = points.join(candidates, figure).withColumns({"ix": at(_c("_bx") + _c("_x") * c - _c("_z") * s, "dx"), "iz": at(_c("_bz") + _c("_x") * s + _c("_z") * c, "dz")})
        return placed.select(figure, "k", "theta", "dx", "dz", "_nb", "ix", "iz").distinct()

    def scored(candidates: DataFrame) -> DataFrame:
        met = turned(candidates).join(cells.withColumn("_in", F.lit(1)), [figure, "ix", "iz"], "left")
        counts = met.groupBy(figure, "k", "theta", "dx", "dz", "_nb").agg(F.count("*").alias("_na"), F.count("_in").alias("_n"))
        return counts.withColumn("iou", _c("_n") / (_c("_na") + _c("_nb") - _c("_n"))).drop("_na", "_n", "_nb")

    def best(rows: DataFrame, stays: Column) -> DataFrame:
        return rows.groupBy(figure).agg(F.min_by(F.struct("theta", "dx", "dz", "iou"), F.struct(-_c("iou"), ~stays, "k")).alias("_b")).select(figure, "_b.*")

    def listed(rows: DataFrame, steps: list, name: str) -> DataFrame:
        return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(steps)], name)))  # the round's steps

    quarters = listed(base.select(figure, "base"), [(90.0 * k,) for k in range(4)], "k int, _turn double")
    coarse = scored(quarters.select(figure, "k", (F.pmod(_c("base") + _c("_turn") + 180, F.lit(360.0)) - 180).alias("theta"), F.lit(0).cast("long").alias("dx"), F.lit(0).cast("long").alias("dz")))
    coarse = cut_lineage(coarse, "coarse")
    second = coarse.groupBy(figure).agg(F.get(F.sort_array(F.collect_list("iou"), asc=False), F.lit(1)).alias("second"))  # four of a figure
    state = best(coarse, F.lit(True))
    for _ in range(ROUNDS):
        turns = listed(state.drop("iou"), [(TURN * k,) for k in range(-TURNS, TURNS + 1)], "k int, _turn double")
        state = cut_lineage(best(scored(turns.withColumn("theta", _c("theta") + _c("_turn")).drop("_turn")), _c("k") == TURNS), "turned")
        here = turned(state.drop("iou").withColumn("k", F.lit(0))).withColumnsRenamed({"ix": "_ix", "iz": "_iz"})
        sizes = here.groupBy(figure, "theta", "dx", "dz", "_nb").agg(F.count("*").alias("_na"))
        around = listed(here.select(figure, "_ix", "_iz"), [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)], "k int, _i int, _j int")
        shared = around.withColumns({"ix": _c("_ix") + _c("_i"), "iz": _c("_iz") + _c("_j")}).join(cells, [figure, "ix", "iz"]).groupBy(figure, "k", "_i", "_j").agg(F.count("*").alias("_n"))
        every = listed(sizes, [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)], "k int, _i int, _j int").join(shared, [figure, "k", "_i", "_j"], "left")
        n = F.coalesce("_n", F.lit(0))
        moved = every.select(figure, "k", "theta", (_c("dx") + _c("_i")).alias("dx"), (_c("dz") + _c("_j")).alias("dz"), (n / (_c("_na") + _c("_nb") - n)).alias("iou"))
        state = cut_lineage(best(moved, _c("k") == (2 * reach + 1) ** 2 // 2), "moved")
    confidence = F.when((_c("iou") > HIGH) & (_c("iou") - _c("second") > LEAD), "high").when(_c("iou") > MEDIUM, "medium").otherwise("low")
    return state.join(second, figure).withColumn("confidence", confidence)

"""Ordered folds: models whose next state depends on the one before, a group at a time.

Series are dealt by key and sorted; a fold streams over them and holds one state, however long a series is. State machines of few
rows a key, and geometry of one figure, are pandas functions by key (``applyInPandas``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.scalars import hash01
from terrane.sources.tables import cut_lineage


def folded(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, outputs: dict[str, str]) -> DataFrame:
    """keys, order and the outputs of ``step(state, *inputs) -> (state, outputs)`` along each key's rows, from ``start()`` on.

    Rows of a key stream past one state in one task: a long series takes time, but no memory.
    """
    kinds = dict(rows.dtypes)
    own = list(dict.fromkeys([*keys, *order]))
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in own), *(f"{c} {t}" for c, t in outputs.items())])
    arrow = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for key, values in zip(zip(*columns[: len(keys)]), zip(*columns[len(own) :])):
                if here is None or key != here:
                    here, state = key, start()
                state, result = step(state, *values)
                out.append(result)
            made = [pa.array([o[i] for o in out], arrow[t]) for i, t in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *made], [*own, *outputs])

    slim = rows.select(*own, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    return slim.repartition(*keys).sortWithinPartitions(*own).mapInArrow(run, schema)


def scanned(rows: DataFrame, key: str, order: str, value: str, start: float, step: Callable[[float, float], float], name: str) -> DataFrame:
    """key, order and the running state: state = step(state, value), in order; a null value leaves the state as it is."""

    def fold(state: float, x: float | None) -> tuple[float, tuple[float]]:
        state = state if x is None else step(state, x)
        return state, (state,)

    typed = rows.withColumn(value, F.col(value).cast("double"))
    return folded(typed, [key], [order], [value], lambda: float(start), fold, {name: "double"})


def smoothed(rows: DataFrame, key: str, order: str, value: str, start: float, dt: float, tau: float, name: str = "smooth") -> DataFrame:
    """Relaxation towards each value: x + (value - x) (1 - exp(-dt / tau))."""
    share = 1 - math.exp(-dt / tau)
    return scanned(rows, key, order, value, start, lambda x, v: x + (v - x) * share, name)


def reservoir(rows: DataFrame, key: str, order: str, inflow: str, constant: float, name: str = "outflow") -> DataFrame:
    """Outflow of a linear reservoir: each step adds the inflow and lets the share 1 / constant of the store go."""
    stores = scanned(rows, key, order, inflow, 0.0, lambda s, v: (s + v) * (1 - 1 / constant), "store")
    return stores.withColumn(name, F.col("store") / (1 - 1 / constant) / constant)


def bounded_state(rows: DataFrame, key: str, order: str, change: str, low: float = 0.0, high: float = 1.0, name: str = "state") -> DataFrame:
    """A state that changes add to, within bounds (frost in the ground, wear)."""
    return scanned(rows, key, order, change, low, lambda s, v: min(max(s + v, low), high), name)


def soil_bucket(rows: DataFrame, key: str, order: str, capacity: float = 100.0, curve_number: float = 75.0) -> DataFrame:
    """Daily water of a soil column (rain, pet): runoff by the curve number, the rest fills the store, evaporation falls with the
    store's share of its capacity, and what exceeds the capacity drains. Inflow from elsewhere must come with the rain of the step before."""
    s = 25400.0 / curve_number - 254.0

    def step(store: float, rain: float, pet: float) -> tuple[float, tuple]:
        runoff = 0.0 if rain <= 0.2 * s else (rain - 0.2 * s) ** 2 / (rain + 0.8 * s)
        store += rain - runoff
        evaporated = min(store, pet * min(1.0, store / capacity))
        store -= evaporated
        drained = max(0.0, store - capacity)
        store -= drained
        return store, (runoff, evaporated, drained, store)

    return folded(rows, [key], [order], ["rain", "pet"], lambda: capacity / 2, step, dict.fromkeys(("runoff", "evaporated", "drained", "store"), "double"))


def crop_stages(rows: DataFrame, key: str, order: str, base: float, sums: tuple[float, ...], frost: float, dry_days: int) -> DataFrame:
    """Development of a crop by daily temperature t and relative moisture w: degree-days above ``base`` move it through the stages
    (thresholds ``sums``); frost under ``frost`` or ``dry_days`` dry days in a row (w < 0.2) kill it. The last stage is ripe."""

    def step(state: tuple, t: float, w: float) -> tuple[tuple, tuple]:
        total, dry, alive = state
        if alive:
            total += max(0.0, t - base)
            dry = dry + 1 if w < 0.2 else 0
            alive = t > frost and dry < dry_days
        return (total, dry, alive), (int(np.searchsorted(sums, total, side="right")) if alive else -1,)

    return folded(rows, [key], [order], ["t", "w"], lambda: (0.0, 0, True), step, {"stage": "int"})


def populations(areas: DataFrame, days: int, growth: float, mortality: float, quota_from: float) -> DataFrame:
    """Daily size of each area's population (area, start, capacity): logistic births, a mortality, and a quota taken of what
    exceeds ``quota_from`` of the capacity every 30 days."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for area, n, capacity in zip(group["area"], group["start"], group["capacity"]):
            for day in range(1, days + 1):
                n += growth * n * (1 - n / capacity) - mortality * n
                taken = max(0.0, n - quota_from * capacity) if day % 30 == 0 else 0.0
                n -= taken
                out.append((area, day, n, taken))
        return pd.DataFrame(out, columns=["area", "day", "n", "taken"])

    kind = dict(areas.dtypes)["area"]
    return areas.groupBy("area").applyInPandas(fold, f"area {kind}, day int, n double, taken double")


def weather_chain(stations: DataFrame, hours: int, weights: dict[str, dict[str, float]], start: str, seed: int = 11) -> DataFrame:
    """station, hour and state of a Markov chain with the given transition weights; draws come from a hash, the same each time."""
    names = sorted(weights)
    table = {a: np.cumsum([weights[a].get(b, 0.0) for b in names]) for a in names}

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        state, out = start, []
        for hour, draw in sorted(zip(group["hour"], group["draw"])):
            scale = table[state]
            state = names[int(np.searchsorted(scale, draw * scale[-1], side="right"))]
            out.append((group["station"].iloc[0], hour, state))
        return pd.DataFrame(out, columns=["station", "hour", "state"])

    drawn = stations.select("station").withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))).withColumn("draw", hash01(F.col("station"), F.col("hour"), seed=seed))
    return drawn.groupBy("station").applyInPandas(fold, f"station {dict(stations.dtypes)['station']}, hour int, state string")


HULL_PART = 50_000


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull against the clock, from the leftmost point: lower and upper chains of the sorted points."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(order) -> list:
        kept: list = []
        for p in order:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept

    return np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def hulls(points: DataFrame, key: str) -> DataFrame:
    """key, i, x, z: the vertices of each group's convex hull.

    Groups of any size: first the hulls of parts of about ``HULL_PART`` points, dealt by hash, then the hull of these.
    """
    kind = dict(points.dtypes)[key]

    def part(group: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(group[["x", "z"]].to_numpy(float))
        return pd.DataFrame({key: group[key].iloc[0], "i": range(len(hull)), "x": hull[:, 0], "z": hull[:, 1]})

    schema = f"{key} {kind}, i int, x double, z double"
    parts = points.groupBy(key).agg(F.ceil(F.count("*") / HULL_PART).alias("_parts"))
    dealt = points.select(key, "x", "z").join(parts, key).select(key, "x", "z", F.pmod(F.xxhash64("x", "z"), "_parts").alias("_p"))
    return dealt.groupBy(key, "_p").applyInPandas(part, schema).groupBy(key).applyInPandas(part, schema)


def tightest_boxes(hull_points: DataFrame, key: str) -> DataFrame:
    """The rotated rectangle of least area around each hull: centre, length, width and angle of its longer side (degrees, 0..180)."""

    def box(group: pd.DataFrame) -> pd.DataFrame:
        hull = group.sort_values("i")[["x", "z"]].to_numpy(float)
        sides = np.roll(hull, -1, axis=0) - hull
        best = None
        for angle in np.unique(np.round(np.arctan2(sides[:, 1], sides[:, 0]) % (math.pi / 2), 12)):
            turn = np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
            turned = hull @ turn.T
            low, high = turned.min(0), turned.max(0)
            size = high - low
            if best is None or size[0] * size[1] < best[0] - 1e-15:
                best = (size[0] * size[1], turn.T @ ((low + high) / 2), size, angle)
        _, centre, size, angle = best
        turned_by = angle if size[0] >= size[1] else angle + math.pi / 2
        return pd.DataFrame({key: [group[key].iloc[0]], "cx": [centre[0]], "cz": [centre[1]], "length": [size.max()], "width": [size.min()], "angle": [math.degrees(turned_by) % 180]})

    return hull_points.groupBy(key).applyInPandas(box, f"{key} {dict(hull_points.dtypes)[key]}, cx double, cz double, length double, width double, angle double")


def spread_choice(points: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The ``n`` points of each group that greedy farthest-point selection picks, with their turn; ties go to the smaller key.

    The first is the one nearest to the group's centre. Each turn is an aggregation with partial maxima: no group is collected.
    """
    own = points.select(group, key, "x", "z")
    centre = own.groupBy(group).agg(F.avg("x").alias("_x"), F.avg("z").alias("_z"))
    square = lambda a, b: (F.col("x") - a) * (F.col("x") - a) + (F.col("z") - b) * (F.col("z") - b)
    taken = None
    for turn in range(n):
        far = -square(F.col("_x"), F.col("_z")) if taken is None else F.array_min(F.transform("_taken", lambda p: square(p["x"], p["z"])))
        rest = own.join(centre if taken is None else taken, group)
        if taken is not None:
            rest = rest.where(~F.exists("_taken", lambda p: p["k"] == F.col(key)))
        best = rest.groupBy(group).agg(F.min_by(F.struct(F.col(key).alias("k"), "x", "z"), F.struct((-far).alias("f"), F.col(key).alias("k"))).alias("_p"))
        if taken is None:
            taken = best.select(group, F.array("_p").alias("_taken"))
        else:
            taken = taken.join(best, group, "left").select(group, F.when(F.col("_p").isNull(), F.col("_taken")).otherwise(F.concat("_taken", F.array("_p"))).alias("_taken"))
        taken = cut_lineage(taken, "taken")  # a row a group
    return taken.select(group, F.posexplode("_taken").alias("turn", "_p")).select(group, "turn", F.col("_p.k").alias(key))


def clipped(polygons: DataFrame, key: str, edges: list[tuple[float, float, float, float]]) -> DataFrame:
    """Polygons (key, i, x, z) cut by a convex window given by its edges (x1 z1 x2 z2, inside to the left)."""

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        ring = [tuple(p) for p in group.sort_values("i")[["x", "z"]].to_numpy(float)]
        for x1, z1, x2, z2 in edges:
            side = [(x2 - x1) * (z - z1) - (z2 - z1) * (x - x1) for x, z in ring]
            new = []
            for k, (p, s) in enumerate(zip(ring, side)):
                q, t = ring[(k + 1) % len(ring)], side[(k + 1) % len(ring)]
                if s >= 0:
                    new.append(p)
                if s * t < 0:
                    u = s / (s - t)
                    new.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
            ring = new
            if not ring:
                break
        return pd.DataFrame([(group[key].iloc[0], i, *p) for i, p in enumerate(ring)], columns=[key, "i", "x", "z"])

    return polygons.groupBy(key).applyInPandas(cut, f"{key} {dict(polygons.dtypes)[key]}, i int, x double, z double")

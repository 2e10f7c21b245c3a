"""Faces that lie in one another, doubled objects and floating ones.

Triangles (id, owner, and corners ax ay az, bx by bz, cx cy cz) are hashed by their quantised plane and the cells of space that they touch, so that only
those nearly in one plane and near each other are compared: by separating axes, in the plane.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import spatial as J

_c = F.col


def _planes(triangles: DataFrame) -> DataFrame:
    """Triangles with their unit normal _nx _ny _nz, turned so that its first part that isn't 0 is positive, and the plane's distance _d. Those without
    an area, or with corners that aren't finite, are left out."""
    side = lambda p, k: _c(f"{p}{k}") - _c(f"a{k}")
    cross = {k: side("b", m) * side("c", n) - side("b", n) * side("c", m) for k, m, n in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}
    raw = triangles.withColumns({f"_{k}": v for k, v in cross.items()})
    long = F.sqrt(_c("_x") * _c("_x") + _c("_y") * _c("_y") + _c("_z") * _c("_z"))
    raw = raw.withColumn("_long", long).where("_long > 1e-12 AND _long < double('Infinity')")
    small = 1e-9 * _c("_long")
    turn = F.when(F.abs("_x") > small, F.signum("_x")).when(F.abs("_y") > small, F.signum("_y")).otherwise(F.signum("_z")) / _c("_long")
    unit = raw.withColumns({f"_n{k}": _c(f"_{k}") * turn for k in "xyz"})
    return unit.withColumn("_d", _c("_nx") * _c("ax") + _c("_ny") * _c("ay") + _c("_nz") * _c("az")).drop("_x", "_y", "_z", "_long")


def coplanar_overlaps(triangles: DataFrame, near: float = 0.01, turn: float = 0.01, depth: float = 1e-6, cell: float = 1.0) -> DataFrame:
    """Pairs a < b of triangles of different owners that overlap (by more than ``depth`` along every axis) in planes whose normals' parts differ by ``turn``
    at most, each corner of b lying at most ``near`` from a's plane."""
    own = _planes(triangles)
    box = lambda k, f: f(*[_c(f"{p}{k}") for p in "abc"])
    slack = {"_nx": turn, "_ny": turn, "_nz": turn, "_d": near}
    steps = {k: 4 * v for k, v in slack.items()}
    for k in "xyz":
        own = own.withColumn(f"_c{k}", F.explode(F.sequence(F.floor((box(k, F.least) - near) / cell), F.floor((box(k, F.greatest) + near) / cell))))
    # Normals are hashed alone: the planes' distances differ more, the farther off their turn counts. They are tested at the corners.
    keys = ["_nx", "_ny", "_nz"]
    left = own.withColumns({f"_q{k}": F.floor(_c(k) / steps[k]) for k in keys})
    right = own
    for k in keys:
        right = right.withColumn(f"_q{k}", F.explode(F.sequence(F.floor((_c(k) - slack[k]) / steps[k]), F.floor((_c(k) + slack[k]) / steps[k]))))
    # A plane whose normal begins near 0 may be turned the other way: it is met as both.
    other = right.where(F.abs("_nx") <= turn)
    for k in keys:
        other = other.drop(f"_q{k}")
    other = other.distinct().withColumns({k: -_c(k) for k in (*keys, "_d")})
    for k in keys:
        other = other.withColumn(f"_q{k}", F.explode(F.sequence(F.floor((_c(k) - slack[k]) / steps[k]), F.floor((_c(k) + slack[k]) / steps[k]))))
    right = right.unionByName(other)
    cells = ["_cx", "_cy", "_cz", *[f"_q{k}" for k in keys]]
    names = ["id", "owner", *[f"{p}{k}" for p in "abc" for k in "xyz"], "_nx", "_ny", "_nz", "_d"]
    met = left.select(*cells, *[_c(n).alias(f"p_{n}") for n in names]).join(right.select(*cells, *[_c(n).alias(f"q_{n}") for n in names]), cells)
    met = met.where((_c("p_id") < _c("q_id")) & (_c("p_owner") != _c("q_owner")))
    for k in keys:
        met = met.where(F.abs(_c(f"p_{k}") - _c(f"q_{k}")) <= turn)
    off = lambda p: F.abs(_c("p__nx") * _c(f"q_{p}x") + _c("p__ny") * _c(f"q_{p}y") + _c("p__nz") * _c(f"q_{p}z") - _c("p__d"))
    met = met.where(F.greatest(off("a"), off("b"), off("c")) <= near)
    return met.where(_overlap(depth)).select(_c("p_id").alias("a"), _c("q_id").alias("b")).distinct()


def _overlap(depth: float) -> Column:
    """Whether no axis in p's plane, at a right angle to an edge of either triangle, parts them. Corners are taken from p's first one: far from 0, rounding
    would hide thin overlaps."""
    corner = lambda t, p: [_c(f"{t}_{p}{k}") for k in "xyz"]
    moved = lambda t, p: [_c(f"{t}_{p}{k}") - _c(f"p_a{k}") for k in "xyz"]
    normal = [_c(f"p__n{k}") for k in "xyz"]
    tests = []
    for t in "pq":
        for a, b in (("a", "b"), ("b", "c"), ("c", "a")):
            edge = [y - x for x, y in zip(corner(t, a), corner(t, b))]
            axis = [edge[m] * normal[n] - edge[n] * normal[m] for m, n in ((1, 2), (2, 0), (0, 1))]
            long = F.sqrt(axis[0] * axis[0] + axis[1] * axis[1] + axis[2] * axis[2])
            at = {s: [reduce(Column.__add__, [x * y for x, y in zip(axis, moved(s, p))]) / long for p in "abc"] for s in "pq"}
            tests.append((F.greatest(*at["p"]) > F.least(*at["q"]) + depth) & (F.greatest(*at["q"]) > F.least(*at["p"]) + depth))
    return reduce(Column.__and__, tests)


def doubled(objects: DataFrame, kind: str, near: float) -> DataFrame:
    """Pairs a < b of objects (id, kind, x, y, z) of one kind at most ``near`` apart, and their distance d."""
    a = objects.select(_c("id").alias("a"), _c(kind).alias("_ka"), "x", _c("y").alias("_ya"), "z")
    b = objects.select(_c("id").alias("b"), _c(kind).alias("_kb"), "x", _c("y").alias("_yb"), "z")
    far = F.sqrt(_c("d") * _c("d") + (_c("_ya") - _c("_yb")) * (_c("_ya") - _c("_yb")))
    return J.within_radius(a, b, near).where("a < b AND _ka = _kb").withColumn("d", far).where(_c("d") <= near).select("a", "b", "d")


def floating(objects: DataFrame, supports: DataFrame, ground: DataFrame, gap: float, reach: float) -> DataFrame:
    """id and gap of objects (id, x, z, y: their lowest point) that hang more than ``gap`` over what is under them: the ground (id, h) or the highest
    support (x, z, top) within ``reach`` that isn't above the object."""
    near = J.within_radius(objects.select("id", "x", "z", "y"), supports.select("x", "z", "top"), reach).where(_c("top") <= _c("y") + gap)
    held = near.groupBy("id").agg(F.max("top").alias("_top"))
    met = objects.select("id", "y").join(ground.select("id", "h"), "id").join(held, "id", "left")
    return met.withColumn("gap", _c("y") - F.greatest("h", "_top")).where(_c("gap") > gap).select("id", "gap")

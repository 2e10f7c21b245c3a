"""Plane geometry as column expressions; points are columns x and z, rings are arrays of structs (x, z)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371008.8


def distance(ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (az - bz) * (az - bz))


def along_segment(px: Column, pz: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Where on a segment, from 0 to 1, the point nearest to p lies; 0 on a segment without length."""
    dx, dz = bx - ax, bz - az
    square = dx * dx + dz * dz
    return F.when(square > 0, F.least(F.greatest(((px - ax) * dx + (pz - az) * dz) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def segment_distance(px: Column, pz: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    t = along_segment(px, pz, ax, az, bx, bz)
    return distance(px, pz, ax + t * (bx - ax), az + t * (bz - az))


def turn(ax: Column, az: Column, bx: Column, bz: Column, cx: Column, cz: Column) -> Column:
    """Twice the signed area of a triangle: positive for a left turn."""
    return (bx - ax) * (cz - az) - (bz - az) * (cx - ax)


def crosses_ray(px: Column, pz: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    """Whether an edge crosses the ray from p to greater x; half-open in z, so that an odd count means inside."""
    over = (az > pz) != (bz > pz)
    return over & (px < (bx - ax) * (pz - az) / F.when(over, bz - az) + ax)


def _sides(a: str, b: str) -> tuple[Column, Column]:
    """On which sides of each segment the other's ends lie, as products: negative for opposite sides, 0 where one lies on it."""
    c = lambda p, n: F.col(f"{p}{n}")
    side = lambda p, q, k: turn(c(p, "x1"), c(p, "z1"), c(p, "x2"), c(p, "z2"), c(q, f"x{k}"), c(q, f"z{k}"))
    return side(a, b, 1) * side(a, b, 2), side(b, a, 1) * side(b, a, 2)


def segments_cross(a: str, b: str) -> Column:
    """Whether two segments with columns x1 z1 x2 z2 under the prefixes a and b cross in their inner parts."""
    one, other = _sides(a, b)
    return (one < 0) & (other < 0)


def segments_touch(a: str, b: str) -> Column:
    """The same with ends that lie on the other segment (or, where all four are in line, without a look at their order)."""
    one, other = _sides(a, b)
    return (one <= 0) & (other <= 0)


def ring_area(ring: Column) -> Column:
    """Signed area of a ring, positive against the clock; the last vertex need not repeat the first."""
    n = F.size(ring)
    following = lambda i: F.element_at(ring, (F.pmod(i + 1, n) + 1).cast("int"))
    terms = F.transform(ring, lambda p, i: p["x"] * following(i)["z"] - following(i)["x"] * p["z"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def open_ring(ring: Column) -> Column:
    """A ring without a last vertex that repeats the first."""
    return F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def is_ring(points: Column) -> Column:
    """Whether points (an array) close a ring: four at least, the last one like the first."""
    return F.coalesce((F.size(points) >= 4) & (F.element_at(points, 1) == F.element_at(points, -1)), F.lit(False))


def is_line(points: Column) -> Column:
    return F.coalesce(F.size(points) >= 2, F.lit(False))


def any_within(points: Column, x0: float, x1: float, z0: float, z1: float) -> Column:
    """Whether a vertex lies in the box, its bounds included."""
    return F.exists(points, lambda p: p["x"].between(x0, x1) & p["z"].between(z0, z1))


def vertex_mean(points: Column) -> tuple[Column, Column]:
    """x and z of the mean of the vertices; a last one like the first counts once."""
    ring = open_ring(points)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)
    return mean("x"), mean("z")


def azimuthal(lat: Column, lon: Column, lat0: float, lon0: float, radius: float = EARTH_RADIUS) -> tuple[Column, Column]:
    """East and north metres in the azimuthal equidistant projection around a point of a sphere."""
    p, d, p0 = F.radians(lat), F.radians(lon - lon0), math.radians(lat0)
    cos_c = F.least(F.greatest(math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(d), F.lit(-1.0)), F.lit(1.0))
    c = F.acos(cos_c)
    k = radius * F.when(F.abs(F.sin(c)) < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c))
    return k * F.cos(p) * F.sin(d), k * (math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(d))


def rotated(x: Column, z: Column, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c - z * s, x * s + z * c


def inflated(x: Column, z: Column, cx: Column, cz: Column, pad: float) -> tuple[Column, Column]:
    """A vertex moved away from a centre by ``pad``; one at the centre stays."""
    far = distance(x, z, cx, cz)
    grow = F.when(far > 0, (far + pad) / far).otherwise(1.0)
    return cx + (x - cx) * grow, cz + (z - cz) * grow


def circle(x: Column, z: Column, radius: Column, sides: int) -> Column:
    """The ring of a regular polygon."""
    angle = lambda i: i * (2 * math.pi / sides)
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: F.struct((x + radius * F.cos(angle(i))).alias("x"), (z + radius * F.sin(angle(i))).alias("z")))

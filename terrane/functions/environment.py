"""Sun, water, growth, noise and colour as column expressions.

Nulls give null. Angles are degrees unless named otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
# Fourier coefficients of the sun's declination (radians) and of the equation of time (minutes; Spencer 1971), as
# constant, cos g, sin g, cos 2g, sin 2g, cos 3g, sin 3g.
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
EQUATION_OF_TIME = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
EQUATION_MINUTES = 229.18
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
# Watts per square metre above the air, and the share that one air mass lets through.
SOLAR_CONSTANT, TRANSMISSION = 1361.0, 0.7
# Multipliers of the lattice noise; fields agree with those of maps made elsewhere only with these.
NOISE = {"x": 374761393, "z": 668265263, "seed": 1442695041, "octave": 7919, "stir": 1274126177}
LUMA = (0.2126, 0.7152, 0.0722)


def _fourier(coefficients: Sequence[float], g: float) -> float:
    waves = [1.0, *(f(k * g) for k in (1, 2, 3) for f in (math.cos, math.sin))]
    return sum(c * w for c, w in zip(coefficients, waves))


def sun_vectors(latitude: float, longitude: float, zone_hours: float = 1.0) -> list[tuple[int, float, float, float, int]]:
    """(month, east, north, up, days) towards the sun at each hour of each month's fifteenth at which it is up: 288 rows at most."""
    out, lat = [], math.radians(latitude)
    for month, days in enumerate(MONTH_DAYS):
        day = sum(MONTH_DAYS[:month]) + 15
        for hour in range(24):
            g = TAU / 365 * (day - 1 + (hour - zone_hours - 12) / 24)
            declination = _fourier(DECLINATION, g)
            minutes = 60 * hour + EQUATION_MINUTES * _fourier(EQUATION_OF_TIME, g) + 4 * longitude - 60 * zone_hours
            angle = math.radians(minutes / 4 - 180)
            up = math.sin(declination) * math.sin(lat) + math.cos(declination) * math.cos(angle) * math.cos(lat)
            if up > 0:
                north = math.sin(declination) * math.cos(lat) - math.cos(declination) * math.cos(angle) * math.sin(lat)
                out.append((month + 1, -math.cos(declination) * math.sin(angle), north, up, days))
    return out


def insolation(gx: Column, gz: Column, vectors: Sequence[tuple[int, float, float, float, int]]) -> Column:
    """Megajoules per square metre of clear sky on a slope (x: east, z: south; rise per unit), summed over the sun's hours."""
    norm = F.sqrt(gx * gx + gz * gz + 1)
    beams = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(-n).alias("s"), F.lit(up).alias("up"), F.lit(SOLAR_CONSTANT * TRANSMISSION ** (1 / max(up, 1e-3)) * 0.0036 * days).alias("mj")) for _, e, n, up, days in vectors])
    return F.aggregate(beams, F.lit(0.0), lambda total, b: total + b["mj"] * F.greatest((b["up"] - gx * b["e"] - gz * b["s"]) / norm, F.lit(0.0)))


def wetness(upslope_area: Column, slope: Column) -> Column:
    """Topographic wetness: log of the area that drains through a cell over the tangent of its slope (half a degree at least)."""
    return F.log(upslope_area / F.tan(F.radians(F.greatest(slope, F.lit(0.5)))))


def wind_exposure(relative_height: Column, aspect: Column, wind_from: float = 270.0) -> Column:
    """From 0 to 1, by the height over the surroundings (-1 to 1) and how far the slope faces the wind."""
    facing = F.cos(F.radians(aspect - wind_from)) * 0.5 + 0.5
    return F.least(F.greatest(0.5 + 0.35 * relative_height + 0.15 * (facing - 0.5), F.lit(0.0)), F.lit(1.0))


def cold_pool(relative_height: Column, exposure: Column, above_water: Column) -> Column:
    """From 0 to 1: hollows out of the wind, less than 10 units over the nearest water."""
    low = F.least(F.greatest(1 - above_water / 10, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(-relative_height, F.lit(0.0)) * (1 - exposure) * low, F.lit(1.0))


def suitability(terms: Sequence[tuple[Column, Column, Column]]) -> Column:
    """exp(-1/2 sum of (difference / spread)^2), with a spread below (second) and one above (third) of zero difference (first)."""
    total = F.lit(0.0)
    for difference, below, above in terms:
        scaled = difference / F.when(difference > 0, above).otherwise(below)
        total = total + scaled * scaled
    return F.exp(-0.5 * total)


def age_at_height(height: Column, full_height: Column, k: Column, p: Column, lifetime: Column) -> Column:
    """Years until a tree has the height: the inverse of a Chapman-Richards curve, kept off its ends."""
    share = F.least(F.greatest(height / full_height, F.lit(0.02)), F.lit(0.97))
    return F.least(-F.log(1 - F.pow(share, 1 / p)) / k, lifetime)


def stem_diameter(height: Column, a: Column, b: Column) -> Column:
    """Centimetres at breast height, by the inverse of a Näslund curve."""
    root = F.sqrt(F.greatest(height - 1.3, F.lit(0.05)))
    return a * root / F.greatest(1 - b * root, F.lit(0.08))


def sunlight_above_the_air(day: Column, latitude: float) -> Column:
    """Megajoules per square metre and day outside the atmosphere."""
    phi = math.radians(latitude)
    year = F.lit(TAU) * day / 365
    tilt = 0.409 * F.sin(year - 1.39)
    sunset = F.acos(F.least(F.greatest(-math.tan(phi) * F.tan(tilt), F.lit(-1.0)), F.lit(1.0)))
    return 1440 / math.pi * 0.082 * (1 + 0.033 * F.cos(year)) * (sunset * math.sin(phi) * F.sin(tilt) + math.cos(phi) * F.cos(tilt) * F.sin(sunset))


def evaporation(mean: Column, spread: Column, day: Column, latitude: float, factor: float = 0.0023, offset: float = 17.8) -> Column:
    """Millimetres a day that would evaporate (Hargreaves), by the day's mean temperature and its spread."""
    return F.greatest(factor * 0.408 * sunlight_above_the_air(day, latitude) * (mean + offset) * F.sqrt(F.greatest(spread, F.lit(0.0))), F.lit(0.0))


def runoff(rain: Column, curve_number: float, held: float = 0.2) -> Column:
    """Millimetres that run off (SCS curve number): nothing until ``held`` of the storage is filled."""
    storage = 25400 / curve_number - 254
    over = rain - held * storage
    return F.when(over > 0, over * over / (over + storage)).when(over <= 0, F.lit(0.0))


def _lattice(x: Column, z: Column, seed: int) -> Column:
    mask = F.lit(0xFFFFFFFF)
    v = (x * NOISE["x"] + z * NOISE["z"] + seed * NOISE["seed"]).bitwiseAND(mask)
    v = (v.bitwiseXOR(F.shiftright(v, 13)) * NOISE["stir"]).bitwiseAND(mask)
    return v.bitwiseAND(F.lit(0xFFFF)) / 65535.0 * 2 - 1


def value_noise(x: Column, z: Column, scale: float, seed: int, octaves: int = 2) -> Column:
    """Smooth noise from -1 to 1: hashed lattice values, eased between, each octave at half the scale and strength."""
    total, weight, all_weights = F.lit(0.0), 1.0, 0.0
    for octave in range(octaves):
        at = [c / (scale / 2**octave) for c in (x, z)]
        cell = [F.floor(c).cast("long") for c in at]
        ease = [(t * t * (3 - 2 * t)) for t in (c - i for c, i in zip(at, cell))]
        corner = lambda i, j, s=seed + octave * NOISE["octave"], c=cell: _lattice(c[0] + i, c[1] + j, s)
        row = lambda j, c=corner, t=ease[0]: c(0, j) * (1 - t) + c(1, j) * t
        total = total + weight * (row(0) * (1 - ease[1]) + row(1) * ease[1])
        all_weights += weight
        weight /= 2
    return total / all_weights


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def next_election(date: Column) -> Column:
    """The first Friday of October, in years that leave 2 modulo 4, after a date."""
    friday = lambda year: F.next_day(F.make_date(year.cast("int"), F.lit(9), F.lit(30)), "Fri")
    year = F.year(date) + F.pmod(2 - F.year(date), F.lit(4))
    return F.when(friday(year) > date, friday(year)).otherwise(friday(year + 4))


def soil_kind(hand: Column, water: Column, twi: Column, slope: Column, tpi: Column, noise: Column, wet: Column, dry: Column, sandy: float) -> Column:
    """The kind of soil by the first rule that holds: flood plain (low over and near to water), hollow (wetter than ``wet``), ridge (steep and above its
    surroundings), sand (flat, drier than ``dry``, where noise is under ``sandy``), else brown earth."""
    return (
        F.when((hand < 2) & (water < 60), "fluvisol").when(twi > wet, "gleysol").when((slope > 20) & (tpi > 0), "ranker").when((slope < 8) & (twi < dry) & (noise < sandy), "arenosol").otherwise("luvisol")
    )

"""Scalar column functions: clamping, interpolation, hashing, calendar, text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(low: float, high: float, x: Column) -> Column:
    """0 below ``low``, 1 above ``high``, a cubic between."""
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def first_match(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = F
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def bit_flags(conditions: Sequence[Column]) -> Column:
    """Bit k is set where condition k holds (null: not set)."""
    out = F.lit(0)
    for k, condition in enumerate(conditions):
        out = out.bitwiseOR(F.when(condition, F.lit(1 << k)).otherwise(F.lit(0)))
    return out


def in_wrapping_range(x: Column, begin: int, end: int) -> Column:
    """begin <= x < end, around the end of the scale where begin > end."""
    if begin <= end:
        return (x >= begin) & (x < end)
    return (x >= begin) | (x < end)


def in_season(date: Column, begin: tuple[int, int], end: tuple[int, int]) -> Column:
    """Whether a date's (month, day) lies in a season, both ends in, that may wrap around the year."""
    day = F.month(date) * 100 + F.dayofmonth(date)
    a, b = begin[0] * 100 + begin[1], end[0] * 100 + end[1]
    return (day >= a) & (day <= b) if a <= b else (day >= a) | (day <= b)


def hash31(*keys: Column, seed: int = 17) -> Column:
    """A 31-bit hash of whole numbers by multiplication and remainder; any SQL engine reproduces it."""
    code = F.lit(seed).cast("long")
    for key in keys:
        code = F.pmod(code * 48271 + F.pmod(key.cast("long"), F.lit(1 << 31)) * 69621 + 12345, F.lit((1 << 31) - 1))
    return F.pmod(code * 16807, F.lit((1 << 31) - 1))


def hash01(*keys: Column, seed: int = 17) -> Column:
    """The same in [0, 1)."""
    return hash31(*keys, seed=seed) / F.lit(float((1 << 31) - 1))


def hash01_sql(*keys: str, seed: int = 17) -> str:
    """The SQL of ``hash01``, for engines whose longs have 64 bits; keys aren't negative."""
    code = str(seed)
    for key in keys:
        code = f"(({code}) * 48271::BIGINT + ({key} % 2147483648) * 69621::BIGINT + 12345) % 2147483647"
    return f"((({code}) * 16807::BIGINT) % 2147483647) / 2147483647.0::DOUBLE"


def julian_day(date: Column) -> Column:
    """Julian day number of a date; modulo 7 it is 0 on Mondays."""
    return (F.datediff(date, F.lit("1970-01-01").cast("date")) + 2440588).cast("long")


def easter(year: Column) -> Column:
    """Date of the Gregorian Easter Sunday by the golden number, the century's corrections and the moon's age."""
    y = year.cast("long")
    quotient = lambda a, b: F.floor(a / b).cast("long")
    golden, century = y % 19, quotient(y, 100)
    epact = (century - quotient(century, 4) - quotient(8 * century + 13, 25) + 19 * golden + 15) % 30
    moon = epact - quotient(epact, 28) * (1 - quotient(epact, 28) * quotient(F.lit(29), epact + 1) * quotient(21 - golden, 11))
    weekday = (y + quotient(y, 4) + moon + 2 - century + quotient(century, 4)) % 7
    sunday = moon - weekday
    month = 3 + quotient(sunday + 40, 44)
    return F.make_date(y.cast("int"), month.cast("int"), (sunday + 28 - 31 * quotient(month, 4)).cast("int"))


# Czech public holidays with a fixed date, as month and day; Good Friday and Easter Monday move with Easter.
HOLIDAYS = ("01-01", "05-01", "05-08", "07-05", "07-06", "09-28", "10-28", "11-17", "12-24", "12-25", "12-26")


def is_holiday(date: Column) -> Column:
    """Whether a date is a public holiday."""
    sunday = easter(F.year(date))
    return F.date_format(date, "MM-dd").isin(*HOLIDAYS) | (date == F.date_sub(sunday, 2)) | (date == F.date_add(sunday, 1))


def utc_offset(date: Column) -> Column:
    """Hours ahead of UTC in central Europe: 2 from the last Sunday of March until the day before October's, else 1."""
    last = lambda month: F.date_sub(F.make_date(F.year(date), F.lit(month), F.lit(31)), F.pmod(julian_day(F.make_date(F.year(date), F.lit(month), F.lit(31))) + 1, F.lit(7)).cast("int"))
    return F.when((date >= last(3)) & (date < last(10)), 2).otherwise(1)


def json_number(text: Column, path: str, default: float | None = None, digits: int = 3) -> Column:
    """A number at a path of JSON text, rounded; ``default`` where there is none, or none that is finite."""
    found = F.round(number_or_null(F.get_json_object(text, path)), digits)
    return found if default is None else F.coalesce(found, F.lit(float(default)))


def cyclic_monthly(values: Sequence[float], day_of_year: Column) -> Column:
    """Linear interpolation between monthly values at mid-month (day 15, 30.44 days apart), around the year."""
    table = F.array(*[F.lit(float(v)) for v in values])
    m = (day_of_year - 15) / 30.44
    low = F.floor(m)
    at = lambda k: F.element_at(table, (F.pmod(k, F.lit(12)) + 1).cast("int"))
    return lerp(at(low), at(low + 1), m - low)


def step_curve(points: Sequence[tuple[float, float]], x: Column) -> Column:
    """Value of the last point at or before x; the first point's before all."""
    out = F.lit(float(points[0][1]))
    for at, value in points[1:]:
        out = F.when(x >= at, F.lit(float(value))).otherwise(out)
    return out


def linear_curve(points: Sequence[tuple[float, float]], x: Column) -> Column:
    """Piecewise linear through the points, constant beyond the ends."""
    out = F.lit(float(points[-1][1]))
    for (a, u), (b, v) in reversed(list(zip(points, points[1:]))):
        out = F.when(x < b, u + (x - a) * ((v - u) / (b - a))).otherwise(out)
    return F.when(x <= points[0][0], F.lit(float(points[0][1]))).otherwise(out)


#: Accented letters and their plain forms.
ACCENTED = "áäàâãåčćçďéěèêëíìîïňñóöòôõřšťúůüùûýžßÁÄÀÂÃÅČĆÇĎÉĚÈÊËÍÌÎÏŇÑÓÖÒÔÕŘŠŤÚŮÜÙÛÝŽ"
PLAIN = "aaaaaacccdeeeeeiiiinnooooorstuuuuuyzsAAAAAACCCDEEEEEIIIINNOOOOORSTUUUUUYZ"


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, joined by single hyphens."""
    plain = F.lower(F.translate(text, ACCENTED, PLAIN))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", "")


def replace_longest_first(text: Column, replacements: dict[str, str]) -> Column:
    """Each key replaced by its value, longer keys before shorter ones."""
    for key in sorted(replacements, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(key), F.lit(replacements[key]))
    return text


def mentions_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text contains one of the words, in any case."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(F.lower(text), F.lit(word.lower()))
    return out


def number_or_null(text: Column) -> Column:
    """The text as a number, null where it is none or not finite."""
    x = text.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by the value of that name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def srgb_to_linear(c: Column) -> Column:
    """A channel of 0..255 to linear light."""
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def quantise(x: Column, low: Column, high: Column, levels: int = 255) -> Column:
    """Whole steps of a linear code between two bounds, halves to even."""
    step = (high - low) / levels
    return F.when(step > 0, F.bround((x - low) / step, 0)).otherwise(F.lit(0.0)).cast("int")


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* of sRGB channels of 0..255, for the white point D65."""
    R, G, B = (srgb_to_linear(c) for c in (r, g, b))
    # The sRGB primaries in XYZ, and the white point.
    x = (0.4124 * R + 0.3576 * G + 0.1805 * B) / 0.95047
    y = 0.2126 * R + 0.7152 * G + 0.0722 * B
    z = (0.0193 * R + 0.1192 * G + 0.9505 * B) / 1.08883
    root = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    return 116 * root(y) - 16, 500 * (root(x) - root(y)), 200 * (root(y) - root(z))

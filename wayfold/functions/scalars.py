"""Scalar functions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock12(seconds: Column) -> Column:
    """Seconds of a day as h:mm AM or PM."""
    h, m = F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60
    return F.concat(F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12).cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.when(h < 12, F.lit(" AM")).otherwise(F.lit(" PM")))


def parse_clock(text: Column) -> Column:
    """HH[:MM[:SS]] as seconds; hours from 24 on count into the next day; null where it is not one."""
    p = F.split(F.trim(text), ":")
    part = lambda k: F.coalesce(F.try_to_number(F.get(p, F.lit(k)), F.lit("9999")).cast("long"), F.lit(0))
    return F.when(text.rlike(r"^\s*\d{1,3}(:\d{1,2}){0,2}\s*$"), part(0) * 3600 + part(1) * 60 + part(2))


def norm_line(label: Column) -> Column:
    return F.regexp_replace(F.upper(label), r"[\s\-]+", "")


def label_tokens(label: Column) -> Column:
    """Distinct words between spaces, slashes and hyphens."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(label, "[/-]", " "), r"\s+"), lambda w: w != ""))


def word_tokens(label: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(label), F.lit("[A-Z0-9]+"), F.lit(0)))


def slug(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]", "-"), "^-+|-+$", ""), "-+", "-")


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.least(F.greatest(x, lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b <= 1e-9, F.lit(float("inf"))).otherwise(a / b)


def round_scaled(x: Column, places: int) -> Column:
    """x rounded as DuckDB does it: the double x * 10^places to the next whole number, halves away from zero. Spark's `round` goes
    by decimal digits, which differ from it in the last place of large numbers."""
    scaled = F.round(x * float(10**places)) / float(10**places)
    return F.when(F.abs(scaled) == float("inf"), x).otherwise(scaled)


def ease(u: Column) -> Column:
    """Cubic ease in and out."""
    return F.when(u < 0.5, 4 * F.pow(u, 3)).otherwise(1 - F.pow(-2 * u + 2, 3) / 2)


def decay(velocity: Column, tau: Column | float, dt: Column) -> Column:
    """Way covered in dt by a velocity that dies away with time constant tau."""
    return velocity * tau * (1 - F.exp(-dt / tau))


def log_zoom(a: Column, b: Column, u: Column) -> Column:
    return F.exp(F.log(a) + (F.log(b) - F.log(a)) * u)


def affine(x: Column, y: Column, c: list[float]) -> tuple[Column, Column]:
    return c[0] * x + c[1] * y + c[2], c[3] * x + c[4] * y + c[5]


def poly2(lon: Column, lat: Column, lon0: float, lat0: float, cx: list[float], cy: list[float]) -> tuple[Column, Column]:
    a, b = lon - lon0, lat - lat0
    basis = [F.lit(1.0), a, b, a * a, a * b, b * b]
    dot = lambda c: sum((k * v for k, v in zip(c[1:], basis[1:])), F.lit(c[0]))
    return dot(cx), dot(cy)


#: Fixed value: km of a degree of latitude.
DEGREE_KM = 111.32


def units_per_km(transform: Callable[[Column, Column], tuple[Column, Column]], lon: float, lat: float, step: float = 0.005) -> Column:
    """Map units of a km at one point, from the way that the transform moves by `step` degrees of latitude."""
    (x0, y0), (x1, y1) = transform(F.lit(lon), F.lit(lat)), transform(F.lit(lon), F.lit(lat + step))
    return F.hypot(x1 - x0, y1 - y0) / (step * DEGREE_KM)


def kmh(units_per_s: Column, scale: Column) -> Column:
    return units_per_s / scale * 3600


def getter(doc: Column, path: str, kind: str, default: object) -> Column:
    """A value of a JSON text in the type of SQL named kind; the default where it is missing, null or no such value."""
    return F.coalesce(F.get_json_object(doc, path).try_cast(kind), F.lit(default).cast(kind))


def through_points(v: Column, table: list[tuple[float, float]]) -> Column:
    """Piecewise linear through sorted (coordinate, pixel) points, carried on straight beyond both ends."""
    line = lambda p, q: F.lit(p[1]) + (v - p[0]) * ((q[1] - p[1]) / (q[0] - p[0]))
    pairs = list(zip(table, table[1:]))
    out = line(*pairs[-1])
    for p, q in reversed(pairs[:-1]):
        out = F.when(v < q[0], line(p, q)).otherwise(out)
    return out


def grid_coordinates(lon: Column, lat: Column, lon0: float, lat0: float, k: float, along: tuple[float, float]) -> tuple[Column, Column]:
    gx, gy = (lon - lon0) * k, lat - lat0
    return gx * along[0] + gy * along[1], gy * along[0] - gx * along[1]


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, u: Column) -> Column:
    return F.pow(1 - u, 3) * p0 + 3 * F.pow(1 - u, 2) * u * p1 + 3 * (1 - u) * u * u * p2 + F.pow(u, 3) * p3


def colour_distance2(a: list[Column], b: list[Column]) -> Column:
    return sum((F.pow(x - y, 2) for x, y in zip(a, b)), F.lit(0.0))


def is_grey(r: Column, g: Column, b: Column, dark: int = 130, light: int = 215, spread: int = 22) -> Column:
    mean = (r + g + b) / 3
    return mean.between(dark, light) & ((F.greatest(r, g, b) - F.least(r, g, b)) < spread)


def tile_range(lo: Column, hi: Column, tile: Column, count: Column) -> tuple[Column, Column]:
    """First and last tile of [lo, hi], inside 0 to count - 1."""
    return F.greatest(F.floor(lo / tile), F.lit(0)), F.least(F.ceil(hi / tile) - 1, count - 1)


def next_day(day: Column) -> Column:
    return F.pmod(day + 1, F.lit(7))


def rotate_days(days: Column) -> Column:
    """Weekday bits a day later."""
    return (F.shiftleft(days, 1).bitwiseAND(F.lit(127))).bitwiseOR(F.shiftright(days, 6))


def runs_on(days: Column, day: int) -> Column:
    """Bit 0 is Sunday."""
    return F.getbit(days, F.lit(day)) == 1


def speed_flag(off_map: Column, inset: Column, pile: Column, kmh: Column, detour: Column) -> Column:
    """The first reason that holds, in this order."""
    return F.when(off_map, "off-map").when(inset, "downtown").when(pile, "terminus").when(kmh < 5, "stalled").when(detour > 1.6, "detour").otherwise("direct")

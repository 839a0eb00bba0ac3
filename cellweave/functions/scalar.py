"""Column functions of the domain."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ~((year % 100 == 0) & ~(year % 400 == 0))


def wrapped_day(day: Column, year: Column, calendar: bool = False) -> Column:
    """A negative day of year counts from the year before: 366 (leap year: 367) less the day; with `calendar`, 365 or 366 more it."""
    length = F.when(leap_year(year), F.lit(367)).otherwise(F.lit(366))
    return F.when(day < 0, (length - 1 + day) if calendar else (length - day)).otherwise(day)


def missing(value: Column, *sentinels: float) -> Column:
    """NaN and the sentinels as null."""
    out = F.when(~F.isnan(value), value)
    for s in sentinels:
        out = F.nullif(out, F.lit(float(s)))
    return out


def filled(value: Column, constant: float) -> Column:
    """Null and NaN as a constant."""
    return F.nanvl(F.coalesce(value, F.lit(float(constant))), F.lit(float(constant)))


def member(value: Column, classes: list) -> Column:
    """1.0 for members, else 0.0; null stays null."""
    return F.when(value.isNull(), F.lit(None)).otherwise(value.isin(*classes).cast("double"))


def rounded(value: Column, places: int) -> Column:
    """The nearest multiple of 10 ** -places as SQL engines in C have it, halves away from zero, never -0.0.  Plain double arithmetic: Spark's round goes through decimals, at several times the cost."""
    scaled = F.abs(value) * 10.0**places
    whole = F.floor(scaled)
    nearest = (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / F.lit(10.0**places)
    return F.when(scaled < 2.0**52, F.when(value < 0, -nearest).otherwise(nearest)).otherwise(value) + 0.0


def flat_index(row: Column, col: Column, cols: int) -> Column:
    """Row-major position of a cell."""
    return row * cols + col


def in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over the edges of all rings (holes included)."""
    edges = []
    for ring in rings:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        edges += [(x0, y0, x1, y1) for (x0, y0), (x1, y1) in zip(closed, closed[1:]) if y0 != y1]
    # One literal, however many edges a coastline has.
    table = F.from_json(F.lit(json.dumps([dict(zip("abcd", map(float, e), strict=True)) for e in edges])), "array<struct<a: double, b: double, c: double, d: double>>")
    crossed = lambda e: ((e["b"] > y) != (e["d"] > y)) & (x < (e["c"] - e["a"]) * (y - e["b"]) / (e["d"] - e["b"]) + e["a"])
    return F.size(F.filter(table, crossed)) % 2 == 1


def polygon_rings(geojson: str) -> list[list[tuple[float, float]]]:
    """Rings of a GeoJSON Polygon or MultiPolygon, bare or in a feature."""
    g = json.loads(geojson)
    g = g.get("geometry", g)
    polygons = g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]]
    return [[tuple(p[:2]) for p in ring] for polygon in polygons for ring in polygon]

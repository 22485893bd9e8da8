"""Plane geometry on rings, arrays of ``(e, n)`` structs whose last point is the first. Columns only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The valid box of the metric reference system, and of plausible degrees.
BOX = {"e": (140_000.0, 880_000.0), "n": (100_000.0, 830_000.0)}
DEGREES = {"lat": (48.9, 55.0), "lon": (13.9, 24.5)}
#: Cost of a connection by distance, and what a well or a septic tank costs at most.
UTILITY_COST = {"power": (4_500, 11_500, 25_000), "water": (8_000, 17_500, 50_000), "sewer": (7_500, 17_500, 40_000), "gas": (5_500, 14_000, 35_000)}
UTILITY_CAP = {"water": 21_000, "sewer": 16_500}


def edges(ring: Column) -> Column:
    """The sides of a ring as structs of their two ends."""
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a["e"].alias("e1"), a["n"].alias("n1"), b["e"].alias("e2"), b["n"].alias("n2")))


def _sum(sides: Column, value) -> Column:
    return F.aggregate(sides, F.lit(0.0), lambda acc, s: acc + value(s))


def _cross(s: Column) -> Column:
    return s["e1"] * s["n2"] - s["e2"] * s["n1"]


def area(ring: Column) -> Column:
    return F.abs(_sum(edges(ring), _cross)) / 2


def perimeter(ring: Column) -> Column:
    return _sum(edges(ring), lambda s: F.hypot(s["e2"] - s["e1"], s["n2"] - s["n1"]))


def centroid(ring: Column) -> Column:
    """The centre of area; null for a ring without area."""
    doubled = _sum(edges(ring), _cross)
    e = _sum(edges(ring), lambda s: (s["e1"] + s["e2"]) * _cross(s)) / (3 * F.nullif(doubled, F.lit(0.0)))
    n = _sum(edges(ring), lambda s: (s["n1"] + s["n2"]) * _cross(s)) / (3 * F.nullif(doubled, F.lit(0.0)))
    return F.when(e.isNotNull(), F.struct(e.alias("e"), n.alias("n")))


def compactness(ring: Column) -> Column:
    """1 for a circle, pi / 4 for a square."""
    return F.try_divide(4 * math.pi * area(ring), F.pow(perimeter(ring), 2))


def bounds(ring: Column) -> Column:
    e, n = F.transform(ring, lambda p: p["e"]), F.transform(ring, lambda p: p["n"])
    return F.struct(F.array_min(e).alias("e_min"), F.array_min(n).alias("n_min"), F.array_max(e).alias("e_max"), F.array_max(n).alias("n_max"))


def box_around(e: Column, n: Column, radius: Column | float) -> Column:
    return F.struct((e - radius).alias("e_min"), (n - radius).alias("n_min"), (e + radius).alias("e_max"), (n + radius).alias("n_max"))


def segment_distance(e: Column, n: Column, s: Column) -> Column:
    """The distance of a point from a side."""
    de, dn = s["e2"] - s["e1"], s["n2"] - s["n1"]
    along = F.coalesce(F.try_divide((e - s["e1"]) * de + (n - s["n1"]) * dn, de * de + dn * dn), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(e - s["e1"] - t * de, n - s["n1"] - t * dn)


def line_distance(e: Column, n: Column, line: Column) -> Column:
    return F.array_min(F.transform(edges(line), lambda s: segment_distance(e, n, s)))


def inside(e: Column, n: Column, ring: Column) -> Column:
    """Whether a ray to the east crosses the ring an odd number of times; the boundary may go either way."""
    crosses = F.filter(edges(ring), lambda s: ((s["n1"] > n) != (s["n2"] > n)) & (e < s["e1"] + F.try_divide((n - s["n1"]) * (s["e2"] - s["e1"]), s["n2"] - s["n1"])))
    return F.size(crosses) % 2 == 1


def covers(e: Column, n: Column, ring: Column, tolerance: float = 1e-9) -> Column:
    """Inside or on the boundary."""
    return inside(e, n, ring) | (line_distance(e, n, ring) <= tolerance)


def point_distance(e: Column, n: Column, ring: Column) -> Column:
    """0 inside, else the distance from the boundary."""
    return F.when(covers(e, n, ring), F.lit(0.0)).otherwise(line_distance(e, n, ring))


def slope(centre: Column, ring: Column, step: float) -> tuple[Column, Column]:
    """Slope in per cent and aspect in degrees from a centre and its eight neighbours (N, NE, ... NW); null if one is missing."""
    h = lambda i: F.get(ring, F.lit(i))
    east = ((h(1) + 2 * h(2) + h(3)) - (h(7) + 2 * h(6) + h(5))) / (8 * step)
    north = ((h(7) + 2 * h(0) + h(1)) - (h(5) + 2 * h(4) + h(3))) / (8 * step)
    rise = F.hypot(east, north)
    known = centre.isNotNull() & (F.size(F.array_compact(ring)) == 8)
    aspect = F.when(rise > 0, (F.degrees(F.atan2(-east, -north)) + 360) % 360)
    return F.when(known, rise * 100), F.when(known, aspect)


def utility_cost(distances: Column) -> Column:
    """The cost of all connections from a map of distances; null where no network is visible."""
    total, seen = F.lit(0), F.lit(False)
    for name, (near, middle, far) in UTILITY_COST.items():
        d = F.element_at(distances, F.lit(name))
        cost = F.when(d <= 50, near).when(d <= 200, middle).otherwise(min(far, UTILITY_CAP.get(name, far)))
        total, seen = total + cost, seen | d.isNotNull()
    return F.when(seen, total)


def plausible(e: Column, n: Column) -> Column:
    return e.between(*BOX["e"]) & n.between(*BOX["n"])


def plausible_degrees(lat: Column, lon: Column) -> Column:
    """False for missing degrees too."""
    return F.coalesce(lat.between(*DEGREES["lat"]) & lon.between(*DEGREES["lon"]), F.lit(False))


def distance_bucket(distance: Column) -> Column:
    return F.when(distance <= 50, "<=50m").when(distance <= 200, "50-200m").otherwise(">200m")


def from_wgs84(lat: Column, lon: Column) -> Column:
    """Degrees to the metric system: transverse Mercator on GRS80, central meridian 19, scale 0.9993, by Krueger's series."""
    a, f, scale = 6_378_137.0, 1 / 298.257222101, 0.9993
    m = f / (2 - f)
    radius = a / (1 + m) * (1 + m**2 / 4 + m**4 / 64)
    alpha = (m / 2 - 2 * m**2 / 3 + 5 * m**3 / 16, 13 * m**2 / 48 - 3 * m**3 / 5, 61 * m**3 / 240)
    k = 2 * math.sqrt(m) / (1 + m)
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - k * F.atanh(k * sine))
    dl = F.radians(lon - 19)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, c in enumerate(alpha, 1):
        e = e + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500_000 + scale * radius * e).alias("e"), (scale * radius * n - 5_300_000).alias("n"))


def to_wgs84(e: Column, n: Column) -> Column:
    """The inverse of ``from_wgs84``, by the inverse series."""
    a, f, scale = 6_378_137.0, 1 / 298.257222101, 0.9993
    m = f / (2 - f)
    radius = a / (1 + m) * (1 + m**2 / 4 + m**4 / 64)
    beta = (m / 2 - 2 * m**2 / 3 + 37 * m**3 / 96, m**2 / 48 + m**3 / 15, 17 * m**3 / 480)
    delta = (2 * m - 2 * m**2 / 3 - 2 * m**3, 7 * m**2 / 3 - 8 * m**3 / 5, 56 * m**3 / 15)
    xi0, eta0 = (n + 5_300_000) / (scale * radius), (e - 500_000) / (scale * radius)
    xi, eta = xi0, eta0
    for j, c in enumerate(beta, 1):
        xi = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + 19).alias("lon"))


def strip_srid(wkt: Column, wanted: int | None = None) -> Column:
    """``SRID=2180;POLYGON(...)`` as ``(srid, wkt)``; with ``wanted``, geometries of another system are null."""
    prefixed = F.upper(wkt).startswith("SRID=")
    srid = F.when(prefixed, F.substring(F.substring_index(wkt, ";", 1), 6, 20).try_cast("int"))
    body = F.when(prefixed, F.nullif(F.regexp_replace(wkt, "^[^;]*;", ""), F.lit(""))).otherwise(F.nullif(wkt, F.lit("")))
    if wanted is not None:
        body = F.when(srid.isNull() | (srid == wanted), body)
    return F.struct(srid.alias("srid"), body.alias("wkt"))


def rings_of_wkt(wkt: Column) -> Column:
    """All rings of a ``POLYGON`` or ``MULTIPOLYGON`` as arrays of ``(e, n)``, holes after their outlines."""
    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("e"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("n"))
    return F.transform(texts, lambda t: F.transform(F.split(t, ","), point))


def signed_area(ring: Column) -> Column:
    """Positive for a ring against the clock."""
    return _sum(edges(ring), _cross) / 2


def polygon_area(rings: Column) -> Column:
    """The area of a polygon from its outline and the holes behind it."""
    return 2 * area(rings[0]) - F.aggregate(rings, F.lit(0.0), lambda a, r: a + area(r))


def in_polygon(e: Column, n: Column, rings: Column) -> Column:
    """Covered by a polygon with holes: an odd number of its rings holds the point, or a boundary does."""
    odd = F.size(F.filter(rings, lambda r: inside(e, n, r))) % 2 == 1
    return odd | F.exists(rings, lambda r: line_distance(e, n, r) <= 1e-9)


def polygons_area(polygons: Column) -> Column:
    """The area of several polygons, each an outline and the holes behind it."""
    return F.aggregate(polygons, F.lit(0.0), lambda a, p: a + polygon_area(p))


def polygons_bounds(polygons: Column) -> Column:
    return bounds(F.flatten(F.flatten(polygons)))


def in_polygons(e: Column, n: Column, polygons: Column) -> Column:
    """Covered by one of several polygons with holes."""
    return in_polygon(e, n, F.flatten(polygons))


def polygons_distance(e: Column, n: Column, polygons: Column) -> Column:
    """0 inside, else the distance from the nearest ring."""
    return F.when(in_polygons(e, n, polygons), F.lit(0.0)).otherwise(polygons_line_distance(e, n, polygons))


def polygons_line_distance(e: Column, n: Column, polygons: Column) -> Column:
    return F.array_min(F.transform(F.flatten(polygons), lambda r: line_distance(e, n, r)))

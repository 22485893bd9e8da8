"""The shape of a parcel: sides and axis of its smallest rotated rectangle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from plotlens.functions import geo

#: A frontage, a slenderness and a compactness beyond which a shape is a problem.
NARROW_M, SLENDER, ODD = 18.0, 5.0, 0.45


def _hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, against the clock."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(order):
        out: list[np.ndarray] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def smallest_rectangle(points: np.ndarray) -> tuple[float, float, int, float] | None:
    """Short and long side, azimuth of the long one and area of the smallest rectangle around the points.

    It lies along a side of the hull, so each is tried.
    """
    hull = _hull(points)
    if len(hull) < 3:
        return None
    side = np.roll(hull, -1, axis=0) - hull
    along = side / np.hypot(side[:, 0], side[:, 1])[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], axis=1)
    u, v = np.ptp(hull @ along.T, axis=0), np.ptp(hull @ across.T, axis=0)
    best = int(np.argmin(u * v))
    axis = along[best] if u[best] >= v[best] else across[best]
    azimuth = int(round((math.degrees(math.atan2(axis[0], axis[1])) + 360) % 180)) % 180
    return float(min(u[best], v[best])), float(max(u[best], v[best])), azimuth, float(u[best] * v[best])


_SIDES = StructType([StructField("short", DoubleType()), StructField("long", DoubleType()), StructField("azimuth", IntegerType()), StructField("area", DoubleType())])


@F.pandas_udf(_SIDES)
def rectangle(ring: pd.Series) -> pd.DataFrame:
    """The smallest rotated rectangle of each ring; null for one without area."""
    rows = [smallest_rectangle(np.array([(p["e"], p["n"]) for p in r])) if r is not None and len(r) else None for r in ring]
    return pd.DataFrame([x or (None, None, None, None) for x in rows], columns=["short", "long", "azimuth", "area"]).astype({"azimuth": "Int32"})


def measures(ring: Column, rect: Column, listed_front: Column) -> Column:
    """A struct of all measures from a ring, its ``rectangle`` and the frontage that the offer gives, which comes first."""
    known = geo.area(ring) > 0
    short = F.when(known, rect["short"])
    front = F.coalesce(F.nullif(listed_front, F.lit(0.0)), short)
    slender, compact = F.when(short > 0, rect["long"] / short), F.when(known, geo.compactness(ring))
    flags = F.array_compact(F.array(F.when(front < NARROW_M, F.lit("narrow_front")), F.when(slender > SLENDER, F.lit("slender")), F.when(compact < ODD, F.lit("odd_shape"))))
    return F.struct(
        F.when(known, geo.area(ring)).alias("area_m2"), F.when(known, geo.perimeter(ring)).alias("perimeter_m"), front.alias("front_m"),
        F.when(F.nullif(listed_front, F.lit(0.0)).isNotNull(), "ogloszenie").when(short.isNotNull(), "geometria (proxy)").alias("front_source"), F.when(known, rect["long"]).alias("length_m"),
        slender.alias("slenderness"), compact.alias("compactness"), F.when(known, rect["azimuth"]).alias("azimuth"), F.when(known, F.try_divide(geo.area(ring), rect["area"])).alias("fill"), flags.alias("flags"),
    )

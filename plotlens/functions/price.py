"""Prices per square metre: normalised to a reference plot, indexed in time, compared."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reference plot, the elasticity of price to area, and the yearly drift of prices.
REFERENCE_M2, ELASTICITY, DRIFT = 1000.0, 0.85, 0.08
#: Measured yearly changes are cut to this on either side before prices are indexed by them.
LARGEST_INDEX = 0.25


def curve(log_area: Column, slope: Column | float = ELASTICITY, bends: tuple[tuple[float, float], ...] = ()) -> Column:
    """The log-price curve: a slope, and from each bend's area on a further slope."""
    out = log_area * slope
    for area, delta in bends:
        out = out + F.greatest(F.lit(0.0), log_area - math.log(area)) * delta
    return out


def normalised(price_m2: Column, area: Column, slope: Column | float = ELASTICITY, bends=(), reference: float = REFERENCE_M2) -> Column:
    """A price per m2 as that of the reference plot; null unless price and area are positive."""
    if not bends:
        value = price_m2 * F.pow(area / reference, 1 - (F.lit(slope) if not isinstance(slope, Column) else slope))
    else:
        value = price_m2 * F.exp(curve(F.lit(math.log(reference)), slope, bends) - curve(F.log(area), slope, bends)) * area / reference
    return F.when((price_m2 > 0) & (area > 0), value)


def denormalised(price_norm: Column, area: Column, slope: Column | float = ELASTICITY, bends=(), reference: float = REFERENCE_M2) -> Column:
    """The inverse of ``normalised``."""
    if not bends:
        value = price_norm * F.pow(area / reference, (F.lit(slope) if not isinstance(slope, Column) else slope) - 1)
    else:
        value = price_norm * F.exp(curve(F.log(area), slope, bends) - curve(F.lit(math.log(reference)), slope, bends)) * reference / area
    return F.when((price_norm > 0) & (area > 0), value)


def local_elasticity(area: Column, slope: Column | float = ELASTICITY, bends: tuple[tuple[float, float], ...] = ()) -> Column:
    """The slope of the curve at an area."""
    out = F.lit(0.0) + slope
    for at, delta in bends:
        out = out + F.when(area > at, delta).otherwise(0.0)
    return F.when(area > 0, out)


def years_between(earlier: Column, later: Column) -> Column:
    return F.date_diff(later, earlier) / 365.25


def time_index(date: Column, as_of: Column, drift: float = DRIFT) -> Column:
    """What a log price of ``date`` gains until ``as_of``."""
    return years_between(date, as_of) * math.log1p(drift)


def indexed(price: Column, yearly: Column, years: Column) -> Column:
    """A price brought forward by a measured yearly change, cut to bounds, or by the usual drift without one."""
    rate = F.when(yearly.isNull(), F.lit(DRIFT)).otherwise(F.greatest(F.lit(-LARGEST_INDEX), F.least(F.lit(LARGEST_INDEX), yearly)))
    return F.when((price > 0) & (years >= 0), price * F.pow(1 + rate, years))


def yearly_change(first: Column, last: Column, years: Column) -> Column:
    """The compound yearly change; null unless prices and years are positive."""
    return F.when((first > 0) & (last > 0) & (years > 0), F.pow(last / first, 1 / years) - 1)


def deviation(price: Column, median: Column) -> Column:
    return F.when((median > 0) & (price > 0), price / median - 1)


def half_even(value: Column, places: int) -> Column:
    """``value`` rounded half to even after scaling, so that a tie that arithmetic missed by its last bit is still one."""
    return F.rint(value * float(10**places)) / float(10**places)


def scaled(value: Column, low: float, high: float, inverted: bool = False) -> Column:
    """``value`` on a scale of 0 to 100 between two bounds, rounded half to even at one place."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(value.isNotNull(), half_even((1 - part if inverted else part) * 100, 1))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two amounts differ by the tolerance of the smaller at most; missing or zero ones don't."""
    return F.coalesce((a != 0) & (b != 0) & (F.abs(a - b) <= tolerance * F.least(a, b)), F.lit(False))


def deal_score(price: Column, value: Column, sigma: Column, spread: Column | float = 0.0) -> Column:
    """How many sigmas an asking price lies below the value at asking level; null where that has no sense."""
    level = value * (1 + (F.lit(spread) if not isinstance(spread, Column) else spread))
    return F.when((price > 0) & (level * sigma > 0), (level - price) / (level * sigma))

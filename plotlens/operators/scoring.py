"""Planning status, building capacity, pillar scores, gates and the composite score. Columns only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.functions import text
from plotlens.functions.price import half_even, scaled

#: Value range of each planning status, and points of the planning pillar.
RANGES = {"A": (1.00, 1.00), "B": (0.90, 1.00), "C": (0.85, 0.95), "D": (0.30, 0.50), "E": (0.50, 0.75), "?": (0.50, 1.00)}
UNKNOWN_USE = (0.45, 1.00)
STATUS_POINTS = {"A": 100.0, "B": 88.0, "C": 80.0, "D": 20.0, "E": 55.0, "?": 50.0}
#: Weights of the pillars by profile.
WEIGHTS = {
    "retail": {"planning": 0.35, "location": 0.22, "infrastructure": 0.18, "physical": 0.10, "risk": 0.10, "market": 0.05},
    "developer": {"planning": 0.45, "location": 0.18, "infrastructure": 0.12, "physical": 0.08, "risk": 0.07, "market": 0.05, "capacity": 0.05},
}
#: Gates and their multipliers; of the flood gates the first that applies counts.
NO_ROAD, NO_BUILDING, FOREST = 0.35, 0.40, 0.30
FLOOD_GATES = (("q10", "flood_q10", 0.40), ("q1", "flood_q1", 0.55), ("hWZ", "flood_sea", 0.60))
#: Points of the risk pillar, by the worst flood zone.
FLOOD_POINTS = (("q10", 10.0), ("q1", 30.0), ("hWZ", 45.0), ("q0_2", 75.0))
PROTECTED_POINTS = 60.0
#: Floor height, usable share of floors in general and in low zones, and these zones.
FLOOR_M, USABLE, USABLE_LOW, LOW_ZONES = 3.2, 0.70, 0.80, ("SJ", "SZ")
#: The share of all weights that a score needs.
LEAST_COVERAGE = 0.40


def mean_of(*parts: Column) -> Column:
    """The mean of the known parts, rounded at one place; null if none is known."""
    known = F.array_compact(F.array(*parts))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, half_even(total / F.size(known), 1))


def planning_status(df: DataFrame) -> DataFrame:
    """With ``status``, ``value_low``, ``value_high`` and ``certain`` from the planning layers.

    Reads ``local_symbol, local_plan, general_plan, zone, infill, permit``; null is unknown. The
    order is that of the legal title: local plan, general plan with infill, permit, outside infill.
    """
    symbol = text.local_symbol(F.col("local_symbol"))
    zone, buildable = F.col("zone"), F.col("zone").isin(*text.BUILDING_ZONES)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    cases = [
        (symbol.isin(*text.LOCAL_SYMBOLS), "A", RANGES["A"], True),
        (yes("local_plan") & symbol.isNull(), "?", UNKNOWN_USE, False),
        (yes("general_plan") & yes("infill") & zone.isNotNull() & ~buildable, "D", RANGES["D"], False),
        (yes("general_plan") & yes("infill"), "B", RANGES["B"], True),
        (yes("permit"), "C", RANGES["C"], True),
        (yes("general_plan") & no("infill") & F.coalesce(buildable, F.lit(False)), "D", (sum(RANGES["D"]) / 2, RANGES["D"][1]), True),
        (yes("general_plan") & no("infill"), "D", RANGES["D"], True),
        (no("general_plan"), "E", RANGES["E"], True),
    ]
    result = lambda s, r, c: F.struct(F.lit(s).alias("status"), F.lit(r[0]).alias("low"), F.lit(r[1]).alias("high"), F.lit(c).alias("certain"))
    out = result("?", RANGES["?"], False)
    for condition, status, bounds, certain in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), result(status, bounds, certain)).otherwise(out)
    df = df.withColumn("__p", out)
    return df.select("*", F.col("__p.status").alias("status"), F.col("__p.low").alias("value_low"), F.col("__p.high").alias("value_high"), F.col("__p.certain").alias("certain")).drop("__p")


def capacity(df: DataFrame) -> DataFrame:
    """With ``floors``, ``floor_area_m2``, ``usable_m2``, ``usable_per_m2`` and the ``binding`` limit.

    Reads ``area_m2, intensity, footprint_pct, height_m, green_pct, zone``. A missing indicator sets
    no limit; without any limit the capacity is unknown. Of equal limits the first named binds.
    """
    area = F.when(F.col("area_m2") > 0, F.col("area_m2"))
    floors = F.floor(F.col("height_m") / FLOOR_M).cast("int")
    limits = [
        ("intensity", area * F.col("intensity")),
        ("footprint", area * (F.col("footprint_pct") / 100) * floors),
        ("green", area * (1 - F.col("green_pct") / 100) * floors),
    ]
    structs = [F.when(v.isNotNull(), F.struct(v.alias("m2"), F.lit(i).alias("i"), F.lit(name).alias("name"))) for i, (name, v) in enumerate(limits)]
    df = df.withColumn("__least", F.array_min(F.array(*structs)))
    share = F.when(F.col("zone").isin(*LOW_ZONES), USABLE_LOW).otherwise(USABLE)
    usable = F.col("__least.m2") * share
    return df.select(
        "*", floors.alias("floors"), F.col("__least.m2").alias("floor_area_m2"), usable.alias("usable_m2"), (usable / area).alias("usable_per_m2"), F.col("__least.name").alias("binding")
    ).drop("__least")


def pillars(df: DataFrame) -> DataFrame:
    """With ``pillars``, a map of seven scores of 0 to 100; an unknown pillar is null.

    Reads what ``planning_status`` and ``capacity`` add and ``utility_cost, road, frontage, slope,
    compactness, floods, flood_checked, protected, travel_min, sea_m, price_change, liquidity``;
    columns that are absent are unknown.
    """
    col = lambda c, kind="double": F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    planning = F.lit(None).cast("double")
    for status, points in STATUS_POINTS.items():
        planning = F.when(F.col("status") == status, points).otherwise(planning)
    road = F.when(F.col("road") == 0, 0.0).when(F.col("road") == 1, 60.0).when(F.col("road") == 2, 100.0)
    floods = F.coalesce(F.col("floods"), F.array().cast("array<string>"))
    risk = F.lit(100.0)
    for zone, points in reversed(FLOOD_POINTS):
        risk = F.when(F.array_contains(floods, zone), points).otherwise(risk)
    risk = F.when(F.coalesce(F.col("protected"), F.lit(False)), F.least(risk, F.lit(PROTECTED_POINTS))).otherwise(risk)
    scores = {
        "planning": planning,
        "location": mean_of(scaled(col("travel_min"), 10, 60, True), scaled(col("sea_m"), 500, 20_000, True)),
        "infrastructure": mean_of(scaled(col("utility_cost"), 0, 150_000, True), road),
        "physical": mean_of(scaled(col("frontage"), 10, 30), scaled(col("slope"), 0, 15, True), scaled(col("compactness"), 0.35, 0.78)),
        "risk": F.when(F.coalesce(F.col("flood_checked"), F.lit(True)), risk),
        "market": mean_of(scaled(col("price_change"), -0.05, 0.20), scaled(col("liquidity"), 0, 10)),
        "capacity": scaled(col("usable_per_m2"), 0.2, 1.5),
    }
    return df.withColumn("pillars", F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), v)]))


def gates(df: DataFrame) -> DataFrame:
    """With ``gates``, the active ones as structs, and ``multiplier``, their product; unknown inputs are no gate.

    Reads ``road, status, floods, register_use, deforestable``.
    """
    floods = F.coalesce(F.col("floods"), F.array().cast("array<string>"))
    gate = lambda name, value: F.struct(F.lit(name).alias("name"), F.lit(value).alias("multiplier"))
    flood = F.lit(None)
    for zone, name, value in reversed(FLOOD_GATES):
        flood = F.when(F.array_contains(floods, zone), gate(name, value)).otherwise(flood)
    forest = F.contains(F.lower("register_use"), F.lit("lesn")) & F.coalesce(~F.col("deforestable"), F.lit(False))
    active = F.array_compact(F.array(F.when(F.col("road") == 0, gate("no_road", NO_ROAD)), F.when(F.col("status") == "D", gate("outside_infill", NO_BUILDING)), flood, F.when(forest, gate("forest", FOREST))))
    df = df.withColumn("gates", active)
    return df.withColumn("multiplier", F.aggregate("gates", F.lit(1.0), lambda a, g: a * g["multiplier"]))


def weighted(pillars_: Column, weights: dict[str, float]) -> tuple[Column, Column]:
    """The weighted mean of the known pillars and the share of the weights that they have."""
    return weighted_of({k: F.element_at(pillars_, F.lit(k)) for k in weights}, weights)


def weighted_of(known: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """``weighted`` of pillars that are columns."""
    held = reduce(lambda a, b: a + b, [F.when(known[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()])
    total = reduce(lambda a, b: a + b, [F.coalesce(known[k] * w, F.lit(0.0)) for k, w in weights.items()])
    return F.when(held > 0, total / held), held / sum(weights.values())


def composite(df: DataFrame, profile: str = "retail", rounded: bool = True, name: str = "score", weights: dict[str, float] | None = None) -> DataFrame:
    """With the score, its ``coverage`` and the pillars it lacks; null under the least coverage.

    The first scoring rounds coverage to three places before it is compared; rescoring doesn't.
    """
    weights = weights or WEIGHTS[profile]
    raw, share = weighted(F.col("pillars"), weights)
    coverage = half_even(share, 3) if rounded else share
    score = F.when(coverage >= LEAST_COVERAGE, half_even(F.round(raw * F.col("multiplier"), 9), 1))  # a sum in another order tips no tie
    lacking = F.filter(F.array(*[F.lit(k) for k in sorted(weights)]), lambda k: F.element_at(F.col("pillars"), k).isNull())
    return df.withColumns({name: score, "coverage": coverage, "lacking": lacking})


def red_flags(df: DataFrame) -> DataFrame:
    """With ``red_flags``, the names of what speaks against a plot."""
    rules = [
        ("narrow_front", F.col("frontage") < 18), ("odd_shape", F.col("compactness") < 0.45), ("dear_utilities", F.col("utility_cost") > 60_000),
        ("no_building", F.col("status") == "D"), ("flood", F.size(F.coalesce("floods", F.array().cast("array<string>"))) > 0),
    ]
    return df.withColumn("red_flags", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules])))


def score_plots(df: DataFrame, profile: str = "retail") -> DataFrame:
    """The whole chain from features to score, in one pass over the rows."""
    return composite(red_flags(gates(pillars(capacity(planning_status(df))))), profile)

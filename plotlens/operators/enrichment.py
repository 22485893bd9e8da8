"""Enrichment of offers by public layers: independent sources, coverage by weight, worklists, stored parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlens.functions import codes, geo, shape
from plotlens.operators import changes, layers, scoring
from plotlens.operators.tessellation import with_polygons
from plotlens.session import staged

#: The weight of each source, and the share of the parcel's that a frontage alone has.
WEIGHTS = {"planning": 0.35, "utilities": 0.18, "terrain": 0.10, "flood": 0.10, "parcel": 0.10}
FRONT_ONLY = 0.4
#: Days after which an offer is enriched again.
STALE_DAYS = 30


def coverage(answered: Column, front_only: Column) -> Column:
    """The weight of the sources that answered over all weights, at three places."""
    of = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    share = lambda s: F.element_at(of, s) * F.when((s == "parcel") & front_only, FRONT_ONLY).otherwise(1.0)
    return F.bround(F.round(F.aggregate(answered, F.lit(0.0), lambda a, s: a + share(s)) / sum(WEIGHTS.values()), 9), 3)


def enriched(offers: DataFrame, sources: dict[str, DataFrame | None], failures: dict[str, str] | None = None) -> DataFrame:
    """A row for each offer with a point: what every layer says, which sources answered, and the coverage.

    Reads ``offer_id, e, n, declared_m2, listed_front``. ``sources`` may hold ``parcels``,
    ``local_acts``, ``acts``, ``zones``, ``infill``, ``floods``, ``networks`` and ``heights`` as the
    functions of ``layers`` take them; one that is missing fails by itself, and ``failures`` has its
    message. What holds for the parcel only needs a usable match.
    """
    spots = staged(offers.where("e is not null and n is not null").select("offer_id", "e", "n", "declared_m2", "listed_front"), "enriched-offers")
    out, missing = spots, {}
    have = lambda *names: all(sources.get(n) is not None for n in names)
    failed = lambda name: missing.setdefault(name, f"{name}: {(failures or {}).get(name, 'missing')}")
    if have("parcels"):
        match = layers.match_parcels(spots, sources["parcels"])
        outlines = with_polygons(sources["parcels"]).groupBy("parcel_id").agg(F.min(F.struct(geo.polygons_area(F.col("polygons")).alias("area"), "polygons")).alias("o"))
        outlines = outlines.select("parcel_id", F.get(F.get("o.polygons", F.lit(0)), F.lit(0)).alias("ring"), F.col("o.area").cast("int").alias("parcel_area_m2"))
        match = match.join(outlines, "parcel_id", "left").select("offer_id", "parcel_id", F.col("quality").alias("match"), "usable", "ring", "parcel_area_m2")
        out = out.join(staged(match.withColumn("rect", shape.rectangle(F.when(F.col("usable"), F.col("ring")))), "matches"), "offer_id", "left")
    else:
        failed("parcels")
        none = "array<struct<e:double,n:double>>"
        out = out.selectExpr("*", "cast(null as string) parcel_id", "cast(null as string) match", "false usable", f"cast(null as {none}) ring", "cast(null as int) parcel_area_m2", "cast(null as struct<short:double,long:double,azimuth:int,area:double>) rect")
    usable = F.coalesce("usable", F.lit(False))
    out = out.withColumn("shape", shape.measures(F.when(usable, F.col("ring")), F.col("rect"), F.col("listed_front"))).withColumn("usable", usable)
    if have("local_acts"):
        out = out.join(layers.local_plans(spots, "offer_id", sources["local_acts"]).select("offer_id", "local_plan", F.col("act").alias("local_act")), "offer_id", "left")
    else:
        failed("local_acts")
        out = out.selectExpr("*", "cast(null as boolean) local_plan", "cast(null as string) local_act")
    planned = have("acts", "zones", "infill")
    if planned:
        out = out.join(layers.planning_zones(spots, "offer_id", sources["acts"], sources["zones"], sources["infill"]), "offer_id", "left")
    else:
        failed("acts")
        fields = ",".join(f"{c}:double" for c in layers.INDICATORS)
        out = out.selectExpr("*", "cast(null as boolean) general_plan", "cast(null as string) act", "cast(null as string) zone", "cast(null as boolean) infill", f"cast(null as struct<{fields}>) indicators")
    out = scoring.planning_status(out.withColumn("local_symbol", F.lit(None).cast("string")).withColumn("permit", F.lit(None).cast("boolean")))
    if have("floods"):
        out = out.join(layers.flood_zones(spots, "offer_id", sources["floods"]), "offer_id", "left")
    else:
        failed("floods")
        out = out.selectExpr("*", "cast(null as array<string>) floods", "false flood_checked")
    if have("heights"):
        out = out.join(layers.terrain(spots, "offer_id", sources["heights"]), "offer_id", "left")
    else:
        failed("heights")
        out = out.selectExpr("*", "cast(null as double) height", "cast(null as double) slope")
    if have("networks"):
        out = out.join(layers.utility_buckets(spots, "offer_id", sources["networks"]), "offer_id", "left")
    else:
        failed("networks")
        out = out.selectExpr("*", "false in_service", "cast(null as map<string,string>) buckets", "cast(null as int) utility_cost")
    front_only = ~usable & F.col("shape.front_m").isNotNull()
    named = {
        "parcel": F.col("usable") | front_only, "planning": F.lit(planned), "flood": F.col("flood_checked"), "terrain": F.col("height").isNotNull(), "utilities": F.col("in_service"),
    }
    answered = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in named.items()]))
    out = out.withColumn("sources_ok", answered)
    errors = F.array(*[F.lit(m) for m in list(missing.values())[:5]]).cast("array<string>")
    return out.select(
        "offer_id", "sources_ok", errors.alias("errors"), F.when(F.lit(planned), F.col("status")).alias("status"), "local_plan", "local_act", "general_plan", "act", "zone", "infill", "indicators", "floods", "flood_checked",
        "height", "slope", "shape", "buckets", "utility_cost", "parcel_id", "match", "parcel_area_m2", coverage(F.col("sources_ok"), front_only).alias("coverage"),
    )


def statistics(rows: DataFrame) -> DataFrame:
    """One row of a batch: offers, those with a failed source, and the mean coverage."""
    return rows.agg(F.count("*").alias("processed"), F.count_if(F.size("errors") > 0).alias("failed"), F.round(F.avg("coverage"), 3).alias("mean_coverage"))


def worklist(offers: DataFrame, state: DataFrame, as_of: Column, days: int = STALE_DAYS, limit: int | None = None) -> DataFrame:
    """Active offers with a point that were never enriched or not for ``days``, the newest first; a batch has ``limit`` of them."""
    rows = offers.where("active and e is not null and n is not null").join(state.select("offer_id", "enriched_at"), "offer_id", "left")
    stale = F.coalesce(F.col("enriched_at") < as_of - F.make_dt_interval(F.lit(days)), F.lit(True))
    rows = rows.where(stale).orderBy(F.desc("first_seen"), "offer_id")
    return rows.limit(limit) if limit else rows


def without_point(offers: DataFrame, limit: int | None = None) -> DataFrame:
    """Active offers whose page has never given a point, the newest first."""
    rows = offers.where("active and (e is null or n is null)").orderBy(F.desc("first_seen"), "offer_id")
    return rows.limit(limit) if limit else rows


def without_outline(state: DataFrame, stored: DataFrame) -> DataFrame:
    """Matched offers whose parcel is not stored."""
    return state.where("parcel_id is not null").join(stored.select("parcel_id"), "parcel_id", "left_anti")


def save(state: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """The enrichment state with a batch of ``enriched`` rows, which win over older ones."""
    return changes.upsert(state, new.withColumn("enriched_at", at).select(*state.columns), ["offer_id"])


def store_parcels(stored: DataFrame, matched: DataFrame) -> DataFrame:
    """The parcel table ``(parcel_id, ring, area_m2, municipality, precinct)`` with matched outlines; known values stay where new ones are missing."""
    parcel = F.col("parcel_id")
    new = matched.where("parcel_id is not null and ring is not null").dropDuplicates(["parcel_id"])
    new = new.select("parcel_id", "ring", F.col("parcel_area_m2").cast("int").alias("area_m2"), codes.municipality(parcel).alias("municipality"), codes.precinct(parcel).alias("precinct"))
    return changes.upsert(stored, new, ["parcel_id"], keep_known=True)


def linked(offers: DataFrame, state: DataFrame, stored: DataFrame) -> DataFrame:
    """``(offer_id, parcel_id)``: the stored parcel of each offer's match; offers without one lose their link."""
    held = state.select("offer_id", "parcel_id").join(stored.select("parcel_id"), "parcel_id", "left_semi")
    return offers.select("offer_id").join(held, "offer_id", "left")


def capacity_area(parcel_area: Column, listed_area: Column) -> Column:
    """The area that a building capacity is computed from: the register's before the advertised one; zero is none."""
    return F.coalesce(F.nullif(parcel_area.cast("double"), F.lit(0.0)), F.nullif(listed_area.cast("double"), F.lit(0.0)))

"""The offer list: composable filters, sort orders, pages, facets and cards."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OfferFilter:
    """Optional conditions that all must hold; a null value of the offer passes none of them."""

    price_min: int | None = None
    price_max: int | None = None
    area_min: int | None = None
    area_max: int | None = None
    unit_price_max: float | None = None
    portals: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    areas: tuple[str, ...] = ()
    infill: bool | None = None
    frontage_min: float | None = None
    slope_max: float | None = None
    utility_cost_max: float | None = None
    no_flood: bool = False
    score_min: float | None = None
    deal_min: float | None = None
    coverage_min: float | None = None
    scored_only: bool = False
    deviation_max: float | None = None
    representatives_only: bool = False

    @classmethod
    def of(cls, spec: dict) -> OfferFilter:
        """A filter from stored keys; unknown keys are an error."""
        unknown = set(spec) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown filter keys: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()})

    def condition(self) -> Column:
        """One Column over the offer row; it reaches the scan as far as its columns do."""
        c, parts = F.col, []
        unit = c("price_grosze") / 100 / F.nullif(c("area_m2"), F.lit(0))
        for value, column, least in (
            (self.price_min, c("price_grosze"), True), (self.price_max, c("price_grosze"), False), (self.area_min, c("area_m2"), True), (self.area_max, c("area_m2"), False),
            (self.unit_price_max, unit, False), (self.frontage_min, F.lit(None) if self.frontage_min is None else c("frontage"), True),
            (self.slope_max, F.lit(None) if self.slope_max is None else c("slope"), False),
            (self.utility_cost_max, F.lit(None) if self.utility_cost_max is None else c("utility_cost"), False),
            (self.score_min, F.lit(None) if self.score_min is None else c("score"), True), (self.deal_min, F.lit(None) if self.deal_min is None else c("deal"), True),
            (self.deviation_max, F.lit(None) if self.deviation_max is None else c("deviation"), False),
        ):
            if value is not None:
                parts.append(column >= value if least else column <= value)
        for values, name in ((self.portals, "portal"), (self.kinds, "kind"), (self.statuses, "status")):
            if values:
                parts.append(c(name).isin(*values))
        if self.areas:
            parts.append(F.exists(F.array(*[F.lit(a) for a in self.areas]), lambda a: F.startswith(c("municipality"), a)))
        if self.infill is not None:
            parts.append(c("infill").eqNullSafe(F.lit(self.infill)))
        if self.no_flood:
            parts.append(F.coalesce(F.size(c("floods")), F.lit(0)) <= 0)
        if self.coverage_min is not None:
            parts.append(F.coalesce(c("coverage"), F.lit(0.0)) >= self.coverage_min)
        if self.scored_only:
            parts.append(c("score").isNotNull())
        if self.representatives_only:
            parts.append(c("cluster_id").isNull() | (c("cluster_id") == c("offer_id")))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


#: Sort orders by name; the id settles ties.
ORDERS = {
    "score": (F.desc_nulls_last, "score"), "deal": (F.desc_nulls_last, "deal"), "price": (F.asc_nulls_last, "price_grosze"), "area": (F.asc_nulls_last, "area_m2"),
    "newest": (F.desc_nulls_last, "first_seen"), "deviation": (F.asc_nulls_last, "deviation"), "unit_price": (F.asc_nulls_last, "unit"),
}


def star(offers: DataFrame, scores: DataFrame, market: DataFrame, members: DataFrame) -> DataFrame:
    """Offers with their scores, market comparison and cluster, each by a left join on the offer."""
    unit = F.col("price_grosze") / 100 / F.nullif(F.col("area_m2"), F.lit(0))
    rows = offers.withColumn("unit", unit).join(scores, "offer_id", "left").join(market, "offer_id", "left")
    return rows.join(members, "offer_id", "left")


def page(rows: DataFrame, wanted: OfferFilter, order: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of the filtered offers; the plan keeps ``offset + limit`` rows of a task at most."""
    way, column = ORDERS[order]
    return rows.where(wanted.condition()).orderBy(way(column), "offer_id").offset(offset).limit(limit)


def facets(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """``(value, n)`` of a column: the known values, zero if absent, and null for offers without one."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    listed = rows.sparkSession.createDataFrame([(k,) for k in known] + [(None,)], "value string")
    return listed.join(counts, listed["value"].eqNullSafe(counts["value"]), "left").select(listed["value"], F.coalesce("n", F.lit(0)).alias("n"))


def matches(rows: DataFrame, filters: dict[int, OfferFilter], log: DataFrame, most: int = 10, first_run: tuple[int, ...] = ()) -> DataFrame:
    """``(filter_id, offer_id, place, send)``: offers that a saved filter has not sent yet, the best deals first.

    Every filter is a condition on the same row, so the offers are read once. A filter on its
    first run marks all its offers and sends none; others send ``most`` at most.
    """
    from pyspark.sql import Window

    hit = F.array_compact(F.array(*[F.when(f.condition(), F.lit(i)) for i, f in filters.items()]))
    found = rows.withColumn("filter_id", F.explode(hit)).join(log, ["filter_id", "offer_id"], "left_anti")
    order = Window.partitionBy("filter_id").orderBy(F.desc_nulls_last("deal"), "offer_id")
    found = found.withColumn("place", F.row_number().over(order))
    first = F.col("filter_id").isin(*first_run) if first_run else F.lit(False)
    return found.where(first | (F.col("place") <= most)).select("filter_id", "offer_id", "place", (~first).alias("send"))


def features(rows: DataFrame, e: str = "e", n: str = "n") -> DataFrame:
    """A GeoJSON feature for each offer, as text."""
    return rows.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(e, n).alias("coordinates")).alias("geometry"),
                F.struct("offer_id", "portal", "price_grosze", "area_m2").alias("properties"),
            )
        ).alias("feature")
    )

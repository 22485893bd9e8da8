"""Valuation of many plots at once: comparables, shrunken medians, nearest neighbours, deal scores."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlens.functions import codes, price
from plotlens.operators import grid, stats
from plotlens.session import drop_staged, staged

#: Comparables: area band, months back, rows of a level at most, price bounds a m2.
BAND, MONTHS, PER_LEVEL, PRICE_M2 = 8, 36, 1500, (1.0, 20_000.0)
#: Enough sales of a segment in all and nearby.
ENOUGH, ENOUGH_NEAR = 12, 5
#: Model 1: pull towards the wider level, least sigma, sales that a sigma needs; both: largest usable sigma.
PULL, LEAST_SIGMA, SIGMA_SALES, LARGEST_SIGMA = 10, 0.18, 8, 0.60
#: Z of the interval by confidence.
Z = {0.80: 1.2816, 0.90: 1.6449, 0.95: 1.96}
#: Model 2: neighbours, weight of distance against features, penalty of another segment, radius, fetched rows.
NEIGHBOURS, GEOGRAPHY, MISMATCH, RADIUS_M, FETCHED = 20, 0.7, 25.0, 15_000.0, 600
#: What a comparable brings along.
SIDE = ("tx_id", "tx_date", "tx_area", "tx_price_m2", "tx_segment")
#: Plot areas at which the price curve may bend.
KNOTS = (800.0, 3000.0, 10_000.0)
#: What of its target it carries.
TARGET = ("target_id", "area_m2", "segment", "as_of")
#: Levels of a comparable from wide to local.
LEVELS = ("wojewodztwo", "powiat", "gmina", "obreb")


def model_sales(tx: DataFrame) -> DataFrame:
    """Sales that models may learn from, as ``tx_*`` columns with codes, segment and price a m2."""
    unit = F.col("price_grosze") / 100 / F.nullif(F.col("area_m2"), F.lit(0))
    rows = tx.withColumn("tx_price_m2", unit).where(
        (F.col("share") == "1/1") & (F.col("trade") == "wolnyRynek") & (F.col("estate") == "nieruchomoscGruntowaNiezabudowana")
        & F.col("tx_price_m2").between(*PRICE_M2)
    )
    return rows.select(
        "tx_id", F.col("parcel_id").alias("tx_parcel"), F.col("sale_date").alias("tx_date"), F.col("area_m2").cast("double").alias("tx_area"), "tx_price_m2",
        codes.segment(F.col("land_use"), F.col("register_use")).alias("tx_segment"), codes.precinct(F.col("parcel_id")).alias("tx_precinct"),
        codes.municipality(F.col("parcel_id")).alias("tx_municipality"), "e", "n",
    )


def with_codes(targets: DataFrame) -> DataFrame:
    return targets.withColumn("precinct", codes.precinct(F.col("parcel_id"))).withColumn("municipality", codes.municipality(F.col("parcel_id")))


def _level() -> Column:
    return (
        F.when(F.col("tx_precinct") == F.col("precinct"), "obreb")
        .when(F.col("tx_municipality") == F.col("municipality"), "gmina")
        .when(F.substring("tx_municipality", 1, 4) == F.substring("municipality", 1, 4), "powiat")
        .otherwise("wojewodztwo")
    )


def _eligible() -> Column:
    """In the window of dates and areas, and not a sale of the plot itself."""
    return (
        (F.col("tx_date") <= F.col("as_of")) & (F.col("tx_date") >= F.date_sub("as_of", 30 * MONTHS))
        & (F.col("tx_area") >= (F.col("area_m2") / BAND).cast("int")) & (F.col("tx_area") <= (F.col("area_m2") * BAND).cast("int"))
        & ~F.col("tx_parcel").eqNullSafe(F.col("parcel_id"))
    )


#: Levels and the digits of the municipality that their areas share; a precinct is small and taken whole.
DIGITS = {"wojewodztwo": 2, "powiat": 4, "gmina": 7}


def _month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def _months_needed(targets: DataFrame, sales: DataFrame, per_level: int) -> DataFrame:
    """``(target_id, level, from)``: the latest month from which on a level surely has ``per_level`` sales of the target's band.

    Read off counts by area, month and octave of plot area: of the band only octaves that lie in it
    whole count, and neither the valuation's own month nor what belongs to a narrower level does.
    Levels that never have so many are left out, and so are municipalities and precincts, which are taken whole.
    """
    octave = F.floor(F.log2("tx_area")).cast("int")
    counts = sales.where("tx_area > 0 and tx_municipality is not null").groupBy("tx_municipality", _month(F.col("tx_date")).alias("month"), octave.alias("octave")).agg(F.count("*").alias("n"))
    counts = staged(counts, "sales-counts")
    asked = targets.select("target_id", "municipality", "area_m2", _month(F.col("as_of")).alias("now"))
    within = (F.pow(F.lit(2.0), "octave") >= F.col("area_m2") / BAND) & (F.pow(F.lit(2.0), F.col("octave") + 1) <= F.col("area_m2") * BAND) & F.col("month").between(F.col("now") - MONTHS + 1, F.col("now") - 1)
    found = []
    for level, narrower in (("wojewodztwo", DIGITS["powiat"]), ("powiat", DIGITS["gmina"])):
        digits = DIGITS[level]
        of = counts.groupBy(F.substring("tx_municipality", 1, digits).alias("area"), "month", "octave").agg(F.sum("n").alias("n"))
        part = asked.join(of, F.substring("municipality", 1, digits) == F.col("area")).where(within).groupBy("target_id", "month").agg(F.sum("n").alias("n"))
        own = counts.groupBy(F.substring("tx_municipality", 1, narrower).alias("area"), "month", "octave").agg(F.sum("n").alias("own"))
        own = asked.join(own, F.substring("municipality", 1, narrower) == F.col("area")).where(within).groupBy("target_id", "month").agg(F.sum("own").alias("own"))
        part = part.join(own, ["target_id", "month"], "left").select("target_id", "month", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"))
        found.append(part.select("target_id", F.lit(level).alias("level"), "month", "n"))
    held = F.sum("n").over(Window.partitionBy("target_id", "level").orderBy(F.desc("month")))
    reached = found[0].unionByName(found[1]).withColumn("held", held).where(F.col("held") >= per_level)
    return reached.groupBy("target_id", "level").agg(F.max("month").alias("from"))


def comparables(targets: DataFrame, sales: DataFrame, per_level: int = PER_LEVEL) -> DataFrame:
    """Targets with the sales of their voivodeship, the ``level`` they share, and the newest of each level.

    A target meets the sales of each level under the level's own key and month by month, and no
    months before those that surely hold the newest ``per_level`` of the level. So a target is
    joined with a few thousand sales, however many its voivodeship has.
    """
    coded = staged(with_codes(targets).select(*TARGET, "parcel_id", "precinct", "municipality"), "coded-targets")
    side = staged(sales.drop("e", "n"), "model-sales")
    need = staged(_months_needed(coded, side, per_level), "months-needed")
    now = _month(F.col("as_of"))
    levels = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.substring("municipality", 1, d).alias("key")) for lv, d in DIGITS.items()], F.struct(F.lit("obreb").alias("level"), F.col("precinct").alias("key"))))
    asked = coded.select("*", levels.alias("__l")).select("*", F.col("__l.level").alias("level"), F.col("__l.key").alias("__key")).drop("__l").where("__key is not null")
    asked = asked.join(need, ["target_id", "level"], "left")
    months = F.sequence(F.greatest(F.coalesce("from", now - MONTHS), now - MONTHS), now)
    asked = asked.withColumn("__month", F.explode(months)).drop("from")
    keys = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.substring("tx_municipality", 1, d).alias("key")) for lv, d in DIGITS.items()], F.struct(F.lit("obreb").alias("level"), F.col("tx_precinct").alias("key"))))
    listed = side.select("*", keys.alias("__l"), _month(F.col("tx_date")).alias("__month")).select("*", F.col("__l.level").alias("level"), F.col("__l.key").alias("__key")).drop("__l").where("__key is not null")
    joined = asked.join(listed, ["level", "__key", "__month"]).where(_eligible() & (F.col("level") == _level()))
    newest = Window.partitionBy("target_id", "level").orderBy(F.desc("tx_date"), "tx_id")
    newest_of = joined.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= per_level)
    return staged(newest_of.select(*TARGET, *SIDE, "level"), "comparables")


#: Sales of a block of a level's sales from new to old; blocks that are looked at first, and how many times more each time after.
BLOCK, FIRST_BLOCKS, WIDER = 512, 6, 8
#: Levels in ``LEVELS`` that are near.
NEAR_LEVELS = (2, 3)


def _area_keys(municipality: str, precinct: str) -> Column:
    """The areas of a plot by level, each with that of the next level, in which a sale belongs to a narrower one."""
    part = lambda d: F.substring(municipality, 1, d)
    keys = (part(2), part(4), F.col(municipality), F.col(precinct), F.lit(None).cast("string"))
    return F.inline(F.filter(F.array(*[F.struct(F.lit(i).alias("lv"), keys[i].alias("key"), keys[i + 1].alias("inner")) for i in range(len(LEVELS))]), lambda x: x["key"].isNotNull()))


def _calendar(side: DataFrame) -> DataFrame:
    """``(lv, key, tx_date, block)``: the days with sales of each area and their blocks of ``BLOCK`` sales from new to old; no day is split."""
    days = side.select("tx_date", _area_keys("tx_municipality", "tx_precinct")).groupBy("lv", "key", "tx_date").agg(F.count("*").alias("n"))
    newer = Window.partitionBy("lv", "key").orderBy(F.desc("tx_date")).rowsBetween(Window.unboundedPreceding, -1)
    return days.select("lv", "key", "tx_date", F.floor(F.coalesce(F.sum("n").over(newer), F.lit(0)) / BLOCK).cast("int").alias("block"))


def _asked_blocks(coded: DataFrame, calendar: DataFrame) -> DataFrame:
    """Targets by level with the first and the last block that may hold one of their sales."""
    asked = coded.select(*TARGET, "parcel_id", _area_keys("municipality", "precinct"))
    ends = asked.select("lv", "key", "as_of").distinct().select("lv", "key", "as_of", F.explode(F.array("as_of", F.date_sub("as_of", 30 * MONTHS + 1))).alias("tx_date"))
    both = calendar.select("lv", "key", F.lit(None).cast("date").alias("as_of"), "tx_date", "block").union(ends.select("lv", "key", "as_of", "tx_date", F.lit(None).cast("int").alias("block")))
    past = Window.partitionBy("lv", "key").orderBy("tx_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.select("lv", "key", "as_of", "tx_date", F.last("block", ignorenulls=True).over(past).alias("at"), F.max("block").over(Window.partitionBy("lv", "key")).alias("oldest")).where("as_of is not null")
    span = both.groupBy("lv", "key", "as_of").agg(F.max(F.when(F.col("tx_date") == F.col("as_of"), F.col("at"))).alias("start"), F.max(F.when(F.col("tx_date") < F.col("as_of"), F.col("at"))).alias("stop"), F.max("oldest").alias("oldest"))
    span = span.select("lv", "key", "as_of", "start", F.coalesce("stop", "oldest").alias("stop")).where("start is not null")
    return asked.join(span, ["lv", "key", "as_of"])


def _met_blocks(asked: DataFrame, side: DataFrame, calendar: DataFrame, counted: bool = False) -> DataFrame:
    """A row for each target, level and block from ``start`` to ``stop``, with the eligible ones of the block's sales in ``sales``.

    With ``counted``, only ``(target_id, lv, block, n)`` of blocks with an eligible one.
    """
    tasks = 8 * asked.sparkSession.sparkContext.defaultParallelism
    asked = asked.withColumn("block", F.explode(F.sequence("start", "stop"))).repartition(tasks, "lv", "key", "block")
    wanted = calendar.join(asked.select("lv", "key", "block").distinct(), ["lv", "key", "block"], "left_semi")
    fields = ("tx_date", "tx_area", "tx_parcel", "inner", "at", "norm", "tx_segment")
    listed = side.select("tx_date", "tx_area", "tx_parcel", "at", "norm", "tx_segment", _area_keys("tx_municipality", "tx_precinct"))
    blocks = listed.join(wanted, ["lv", "key", "tx_date"]).groupBy("lv", "key", "block").agg(F.collect_list(F.struct(*fields)).alias("held"))
    t = lambda c: F.col(f"t.{c}")
    low, high = (t("area_m2") / BAND).cast("int"), (t("area_m2") * BAND).cast("int")

    def fits(s: Column) -> Column:
        return (
            (s["tx_date"] <= t("as_of")) & (s["tx_date"] >= F.date_sub(t("as_of"), 30 * MONTHS)) & (s["tx_area"] >= low) & (s["tx_area"] <= high)
            & ~s["tx_parcel"].eqNullSafe(t("parcel_id")) & ((t("lv") == len(LEVELS) - 1) | ~F.coalesce(s["inner"] == t("inner"), F.lit(False)))
        )

    met = asked.alias("t").join(blocks.alias("b"), ["lv", "key", "block"])
    if counted:
        return met.select("t.*", F.struct("t.*").alias("t"), F.explode("b.held").alias("s")).where(fits(F.col("s"))).groupBy("target_id", "lv", "block").agg(F.count("*").alias("n"))
    return met.select("t.*", F.filter("b.held", fits).alias("sales"))


def _needed_blocks(coded: DataFrame, side: DataFrame, calendar: DataFrame, per_level: int) -> DataFrame | None:
    """``_asked_blocks`` cut where a level has ``per_level`` eligible sales; None if no target meets a sale."""
    open_ = staged(_asked_blocks(coded, calendar), "asked-blocks")
    need, reach, read = None, FIRST_BLOCKS, []
    while not open_.isEmpty():
        last = F.least("stop", F.col("start") + reach - 1)
        counts = _met_blocks(open_.withColumn("stop", last), side, calendar, counted=True)
        counts = counts.withColumn("held", F.sum("n").over(Window.partitionBy("target_id", "lv").orderBy("block")))
        found = staged(counts.groupBy("target_id", "lv").agg(F.min(F.when(F.col("held") >= per_level, F.col("block"))).alias("enough")), "blocks-held")
        rows = open_.join(found, ["target_id", "lv"], "left")
        done = F.col("enough").isNotNull() | (last >= F.col("stop"))
        part = staged(rows.where(done).withColumn("stop", F.coalesce("enough", "stop")).drop("enough"), "blocks-needed")
        need = part if need is None else need.union(part)
        read += [open_, found]
        open_, reach = staged(rows.where(~done).drop("enough"), "asked-blocks"), reach * WIDER
    drop_staged(open_, *read)
    return need


def level_medians(targets: DataFrame, sales: DataFrame, per_level: int = PER_LEVEL, shown: int = 0) -> DataFrame:
    """``(target_id, level, n, segments_used, newest, n_clean, median, sigma, shown)`` of the comparables that model 1 reads.

    They are those of ``comparables`` and ``select_segments``. A target meets whole blocks of a level's sales, from new to
    old, as arrays: a first pass counts eligible ones until a level has ``per_level`` or its window ends, a second one
    takes these blocks, and its rows of packed prices are shuffled once, to their target. ``shown`` holds the numbers of the
    best ones for ``shown_sales``.
    """
    coded = staged(with_codes(targets).select(*TARGET, "parcel_id", "precinct", "municipality").where("as_of is not null and area_m2 is not null").distinct(), "coded-targets")
    of_day = F.row_number().over(Window.partitionBy("tx_date").orderBy("tx_id"))
    norm = F.log(price.normalised(F.col("tx_price_m2"), F.col("tx_area")))
    side = staged(sales.drop("e", "n").where("tx_date is not null").withColumns({"at": _place(of_day), "norm": norm}), "model-sales")
    calendar = staged(_calendar(side), "sales-days")
    need = _needed_blocks(coded, side, calendar, per_level)
    table = F.create_map(*[x for k, v in codes.WIDENING.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    schema = "target_id {}, level string, n bigint, segments_used int, newest date, n_clean bigint, median double, sigma double, shown array<bigint>".format(targets.schema["target_id"].dataType.simpleString())
    if need is None:
        return targets.sparkSession.createDataFrame([], schema)
    met = _met_blocks(need, side, calendar).where(F.size("sales") > 0)
    rank = lambda s: F.when(s["tx_segment"] == F.col("segment"), 0).otherwise(F.coalesce(F.nullif(F.array_position(table[F.col("segment")], s["tx_segment"]), F.lit(0)), F.lit(-1))).cast("tinyint")
    y = lambda s: s["norm"] + price.time_index(s["tx_date"], F.col("as_of"))
    packed = {"at": lambda s: s["at"], "y": y, "rank": rank} | ({"off": lambda s: F.abs(F.log(s["tx_area"] / F.col("area_m2")))} if shown else {})
    met = met.select("target_id", "lv", *[F.transform("sales", f).alias(name) for name, f in packed.items()])
    return met.groupBy("target_id").applyInPandas(lambda df: _level_medians(df, per_level, shown), schema)


def _place(of_day: Column) -> Column:
    """A number of a sale that rises from new to old, within a day by ``tx_id``."""
    return F.shiftleft(-F.unix_date("tx_date").cast("bigint"), 32) + of_day


def _level_medians(df: pd.DataFrame, per_level: int, shown: int) -> pd.DataFrame:
    """One target: the newest of each level, its segment widened while they are too few, and robust medians by level."""
    parts = {}
    for lv in df["lv"].unique():
        rows = df[df["lv"] == lv]
        at, y, rank = (np.concatenate(rows[c].to_list()) for c in ("at", "y", "rank"))
        newest = np.argsort(at, kind="stable")[:per_level]
        off = np.concatenate(rows["off"].to_list())[newest] if shown else None
        parts[lv] = at[newest], y[newest], rank[newest], off
    held = np.array([sum((p[2] == r).sum() for p in parts.values()) for r in range(4)])
    near = np.array([sum((p[2] == r).sum() for lv, p in parts.items() if lv in NEAR_LEVELS) for r in range(4)])
    used = [0]
    for r in range(1, 4):
        if held[used].sum() >= ENOUGH and near[used].sum() >= ENOUGH_NEAR:
            break
        used.append(r)
    whole = held[used].sum() == 0
    segments = 2 if whole else 1 + sum(int(held[r] > 0) for r in used[1:])
    out, left = [], shown
    for lv in sorted(parts, reverse=True):
        at, y, rank, off = parts[lv]
        keep = np.full(len(at), True) if whole else np.isin(rank, used)
        if not keep.any():
            continue
        best = at[keep][np.lexsort((at[keep], off[keep]))][:left].tolist() if shown else []
        left -= len(best)
        prices = y[keep][~np.isnan(y[keep])]
        n, middle, sigma = len(prices), np.nan, np.nan
        if n:
            off_middle = np.abs(prices - np.median(prices))
            spread = np.median(off_middle) * stats.MAD_TO_SIGMA
            clean = prices if n < 5 or spread <= 0 else prices[off_middle <= stats.OUTLIER_SIGMAS * spread]
            n, middle = len(clean), np.median(clean)
            sigma = np.median(np.abs(clean - middle)) * stats.MAD_TO_SIGMA
        newest = dt.date(1970, 1, 1) - dt.timedelta(int(at[keep].min() >> 32))
        out.append((df["target_id"].iloc[0], LEVELS[lv], int(keep.sum()), segments, newest, n, middle, sigma, best))
    return pd.DataFrame(out, columns=["target_id", "level", "n", "segments_used", "newest", "n_clean", "median", "sigma", "shown"])


def model_1(targets: DataFrame, sales: DataFrame, confidence: float = 0.80) -> DataFrame:
    """Model 1 of targets and sales as in ``shrunk_median``, from ``level_medians``."""
    levels = staged(level_medians(targets, sales), "level-medians")
    clean = levels.where("n_clean > 0").select("target_id", "level", F.col("n_clean").alias("n"), "median", "sigma")
    rows_of = levels.groupBy("target_id").agg(F.sum("n").alias("__rows"), F.max("segments_used").alias("segments_used"))
    return _shrink(targets, clean, rows_of, confidence)


#: Widest of the finest cells in which nearby sales are counted, days of a period of these counts, and periods back.
CELL_M, PERIOD = RADIUS_M / 16, 90
BACK = 30 * MONTHS // PERIOD
#: Octaves of plot area: up to so many away a sale may be in the band, and is so surely; plots below 2^LEAST m2 are one class.
MAY, SURELY, LEAST = 4, 2, 4
#: Cells are halved until one holds no more sales than this on average, at most so often, or until that parts few of them any more.
CELL_SALES, HALVED, PARTS = 64, 8, 1.1


def _period(date: Column) -> Column:
    return F.floor(F.unix_date(date) / PERIOD)


def _cell_width(side: DataFrame) -> float:
    """A width of cells by the sales that an occupied one holds: so a target meets as many sales in a dense table as in a thin one."""
    held, *cells = side.agg(F.count("*"), *[F.approx_count_distinct(grid.cell("e2", "n2", CELL_M / 2**k)) for k in range(HALVED + 1)]).first()
    k = 0
    while k < HALVED and held > CELL_SALES * cells[k] and cells[k + 1] > PARTS * cells[k]:
        k += 1
    return CELL_M / 2**k


def _counts_by_cell(side: DataFrame, asked: DataFrame) -> DataFrame:
    """``(x, y, p, o, held)``: sales by cell, period and octave of area, of the periods that a target may look at."""
    octave = F.when(F.col("tx_area") >= 1, F.floor(F.log2("tx_area"))).otherwise(0).cast("int")
    counts = side.groupBy("x", "y", _period(F.col("tx_date")).alias("p"), octave.alias("o")).agg(F.count("*").alias("held"))
    ends = asked.agg((F.min("period") - BACK).alias("first"), F.max("period").alias("last"))
    return counts.join(F.broadcast(ends), F.col("p").between(F.col("first"), F.col("last"))).drop("first", "last")  # a row


def spatial_comparables(targets: DataFrame, sales: DataFrame, radius: float = RADIUS_M, fetched: int = FETCHED) -> DataFrame:
    """Targets with the nearest sales within the radius, their ``level`` and ``dist_m``.

    Counts of sales by cell, at narrowing cells, tell which cells may hold the ``fetched`` nearest that are eligible
    (``grid.closest_cells``); a target is joined with the sales of these only, so with some multiple of ``fetched``, not
    with its city. The finest cells follow the density of the sales, so the multiple does not grow with the table. A target's
    own sales, which are not eligible, are added to what it needs. Repeated targets count once.
    """
    listed = staged(grid.placed(sales).where("tx_date is not null").withColumnsRenamed({"e": "e2", "n": "n2"}), "model-sales")
    width, top = _cell_width(listed), 0
    while width * grid.FAN**top < radius:
        top += 1
    side = listed.withColumn("c", grid.cell("e2", "n2", width)).select("*", "c.x", "c.y").drop("c")
    own = side.groupBy(F.col("tx_parcel").alias("parcel_id")).agg(F.count("*").alias("own"))
    octave = F.when(F.col("area_m2") >= 2**LEAST, F.floor(F.log2("area_m2") - 1e-9)).otherwise(LEAST).cast("int")
    asked = grid.placed(with_codes(targets).select(*TARGET, "parcel_id", "precinct", "municipality", "e", "n")).where("as_of is not null and area_m2 is not null").distinct()
    asked = staged(asked.withColumns({"period": _period(F.col("as_of")), "octave": F.greatest(octave, F.lit(LEAST))}), "spatial-targets")
    needs = asked.join(own, "parcel_id", "left").withColumns({"need": F.coalesce("own", F.lit(0)) + fetched, "limit": F.lit(radius), "start": grid.around("e", "n", width * grid.FAN**top)})
    counts = staged(_counts_by_cell(side, asked), "sales-cells")
    p, o, period, octave = (F.col(c) for c in ("p", "o", "period", "octave"))
    may = p.between(period - BACK, period) & o.between(octave - MAY, octave + MAY)
    surely = (p < period) & (p > period - BACK) & o.between(octave - SURELY, octave + SURELY) & (octave > LEAST)
    cells = grid.closest_cells(needs, counts, "target_id", width, top, ("period", "octave"), ("p", "o"), may, surely)
    joined = cells.distinct().join(asked.drop("period", "octave"), "target_id").join(side, ["x", "y"]).withColumn("dist_m", grid.distance("e", "n", "e2", "n2"))
    joined = joined.where((F.col("dist_m") <= radius) & _eligible()).withColumn("level", _level())
    near = Window.partitionBy("target_id").orderBy("dist_m", "tx_id")
    nearest_of = joined.select(*TARGET, *SIDE, "level", "dist_m").withColumn("__k", F.row_number().over(near)).where(F.col("__k") <= fetched)
    return staged(nearest_of.drop("__k"), "spatial-comparables")


def select_segments(comps: DataFrame) -> DataFrame:
    """The comparables of the target's segment, widened in order while they are too few, with ``segments_used``.

    Where neither the segment nor one that may be added has a sale, all stay and two segments count as used.
    """
    table = F.create_map(*[x for k, v in codes.WIDENING.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    place = F.when(F.col("tx_segment") == F.col("segment"), 0).otherwise(F.array_position(table[F.col("segment")], F.col("tx_segment")))
    ranked = comps.withColumn("__rank", F.coalesce(place, F.lit(0)).cast("int")).withColumn(
        "__rank", F.when((F.col("__rank") == 0) & (F.col("tx_segment") != F.col("segment")), -1).otherwise(F.col("__rank"))
    )
    near = F.col("level").isin("obreb", "gmina")
    counts = ranked.groupBy("target_id").agg(
        *[F.count_if(F.col("__rank") == r).alias(f"n{r}") for r in range(4)], *[F.count_if((F.col("__rank") == r) & near).alias(f"l{r}") for r in range(4)]
    )
    total, local, open_ = F.col("n0"), F.col("l0"), F.lit(True)
    flags, used = [F.lit(True)], F.lit(1)
    for r in range(1, 4):
        open_ = open_ & ~((total >= ENOUGH) & (local >= ENOUGH_NEAR))
        flags.append(open_)
        total = total + F.when(open_, F.col(f"n{r}")).otherwise(0)
        local = local + F.when(open_, F.col(f"l{r}")).otherwise(0)
        used = used + F.when(open_ & (F.col(f"n{r}") > 0), 1).otherwise(0)
    counts = counts.select("target_id", F.array(*flags).alias("__open"), (total == 0).alias("__all"), F.when(total == 0, 2).otherwise(used).alias("segments_used"))
    kept = ranked.join(counts, "target_id").where(F.col("__all") | ((F.col("__rank") >= 0) & F.get("__open", F.col("__rank"))))
    return kept.drop("__rank", "__open", "__all")


def log_prices(comps: DataFrame) -> DataFrame:
    """With ``y``, the log of the normalised price brought to the target's date."""
    norm = price.normalised(F.col("tx_price_m2"), F.col("tx_area"))
    return comps.withColumn("y", F.log(norm) + price.time_index(F.col("tx_date"), F.col("as_of")))


def _priced(out: DataFrame, confidence: float) -> DataFrame:
    """From ``mu`` and ``sigma`` to a value with an interval, in grosze, and whether it is usable."""
    unit = price.denormalised(F.exp("mu"), F.col("area_m2"))
    value = unit * F.col("area_m2")
    z = Z[confidence]
    return (
        out.withColumn("unit_norm", F.exp("mu")).withColumn("unit_for_area", unit)
        .withColumn("value_grosze", F.bround(value * 100).cast("bigint"))
        .withColumn("low_grosze", F.bround(value * F.exp(-z * F.col("sigma")) * 100).cast("bigint"))
        .withColumn("high_grosze", F.bround(value * F.exp(z * F.col("sigma")) * 100).cast("bigint"))
        .withColumn("usable", F.col("sigma") <= LARGEST_SIGMA)
    )


def shrunk_median(targets: DataFrame, comps: DataFrame, confidence: float = 0.80) -> DataFrame:
    """Model 1: robust medians by level, each pulled towards the wider one; a row for each target with a sale.

    ``comps`` come from ``select_segments``. A sigma of too few sales is taken from the wider level.
    """
    rows = staged(log_prices(comps).select("target_id", "level", "y", "segments_used"), "log-prices")
    clean = stats.drop_outliers(rows, ["target_id", "level"], "y")
    levels = stats.robust(clean, ["target_id", "level"], "y")
    rows_of = rows.groupBy("target_id").agg(F.count("*").alias("__rows"), F.max("segments_used").alias("segments_used"))
    return _shrink(targets, levels, rows_of, confidence)


def _shrink(targets: DataFrame, levels: DataFrame, rows_of: DataFrame, confidence: float) -> DataFrame:
    """Values from ``(target_id, level, n, median, sigma)`` and ``(target_id, __rows, segments_used)``."""
    wide = levels.groupBy("target_id").agg(*[F.max(F.when(F.col("level") == lv, F.struct("n", "median", "sigma"))).alias(lv) for lv in LEVELS])
    mu, sigma, local, used = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("bigint"), F.lit(None).cast("string")
    for lv in LEVELS:
        own = F.col(lv)
        lam = own["n"] / (own["n"] + PULL)
        mixed = F.when(mu.isNull(), own["median"]).otherwise(lam * own["median"] + (1 - lam) * mu)
        weak = (own["sigma"] <= 0) | (own["n"] < SIGMA_SALES)
        own_sigma = F.when(weak, F.coalesce(sigma, F.greatest(own["sigma"], F.lit(LEAST_SIGMA)))).otherwise(own["sigma"])
        wide = wide.withColumns({
            f"__mu_{lv}": F.when(own.isNull(), mu).otherwise(mixed), f"__sigma_{lv}": F.when(own.isNull(), sigma).otherwise(own_sigma),
            f"__n_{lv}": F.when(own.isNull(), local).otherwise(own["n"]), f"__used_{lv}": F.when(own.isNull(), used).otherwise(F.lit(lv)),
        })
        mu, sigma, local, used = (F.col(f"__{x}_{lv}") for x in ("mu", "sigma", "n", "used"))
    total = sum((F.coalesce(F.col(lv)["n"], F.lit(0)) for lv in LEVELS), F.lit(0))
    wide = wide.select("target_id", mu.alias("mu"), sigma.alias("s"), local.alias("n_local"), used.alias("level_used"), total.alias("n_comparables"))
    out = targets.join(wide, "target_id").join(rows_of, "target_id")
    n = F.col("n_local")
    factor = F.when(n >= 15, 1.0).when(n >= 3, 1.15).otherwise(1.4) * (1 + 0.10 * (F.col("segments_used") - 1))
    out = out.withColumn("sigma", F.greatest("s", F.lit(LEAST_SIGMA)) * F.sqrt(1 + 1 / n) * factor)
    out = out.withColumn("method", F.when(n >= 15, "median_shrink/kcs").when(n >= 3, "median_shrink/pary").otherwise("median_shrink/regionalny"))
    return _priced(out.withColumn("dropped", F.col("__rows") - F.col("n_comparables")).drop("s", "__rows"), confidence)


def nearest_neighbours(targets: DataFrame, comps: DataFrame, confidence: float = 0.80, prior: DataFrame | None = None, prior_weight: float = 6.0) -> DataFrame:
    """Model 2: neighbours by distance and features together, weighted by a kernel of that distance.

    ``comps`` come from ``spatial_comparables`` and ``select_segments``. ``prior`` has
    ``(target_id, prior_mu)``, the result of model 1 that takes part with a weight of its own.
    """
    years = price.years_between(F.col("tx_date"), F.col("as_of"))
    features = F.pow(F.log(F.col("tx_area") / F.col("area_m2")), 2) + F.pow(years / 3, 2)
    combined = GEOGRAPHY * F.pow(F.col("dist_m") / 1000, 2) + (1 - GEOGRAPHY) * features + MISMATCH * (F.col("tx_segment") != F.col("segment")).cast("double")
    rows = log_prices(comps).withColumn("d", combined)
    near = Window.partitionBy("target_id").orderBy("d", "tx_id")
    rows = rows.withColumn("__k", F.row_number().over(near)).where(F.col("__k") <= max(NEIGHBOURS, 3))
    rows = staged(rows.select("target_id", "tx_id", "y", "d", "segments_used"), "neighbours")
    clean = stats.drop_outliers(rows, ["target_id"], "y")
    counts = clean.groupBy("target_id").agg(F.count("*").alias("__n"))
    rows = rows.join(counts, "target_id").join(clean.select("target_id", "tx_id", F.lit(True).alias("__clean")), ["target_id", "tx_id"], "left")
    rows = rows.where((F.col("__n") < 3) | F.col("__clean"))
    scale = rows.groupBy("target_id").agg(F.greatest(F.median("d"), F.lit(1e-6)).alias("scale"), F.count("*").alias("n_used"), F.max("segments_used").alias("segments_used"))
    rows = rows.select("target_id", "y", "d").join(scale, "target_id").withColumn("w", F.exp(-F.col("d") / (2 * F.col("scale"))))
    rows = staged(rows, "weighted-neighbours")
    points = rows.select("target_id", "y", "w")
    if prior is not None:
        mean = rows.groupBy("target_id").agg((prior_weight * F.avg("w")).alias("w"))
        points = points.union(prior.join(mean, "target_id").select("target_id", F.col("prior_mu").alias("y"), "w"))
    mu = stats.weighted_quantile(points, ["target_id"], "y", "w", 0.5, "mu")
    off = points.join(mu, "target_id").withColumn("off", F.abs(F.col("y") - F.col("mu")))
    spread = stats.weighted_quantile(off, ["target_id"], "off", "w", 0.5, "spread")
    out = targets.join(mu, "target_id").join(spread, "target_id").join(scale.drop("scale"), "target_id")
    sigma = F.greatest(F.col("spread") * stats.MAD_TO_SIGMA, F.lit(LEAST_SIGMA)) * F.sqrt(1 + 1 / F.col("n_used"))
    sigma = sigma * (1 + 0.10 * (F.col("segments_used") - 1)) * F.when(F.col("n_used") < 6, 1.25).otherwise(1.0)
    return _priced(out.withColumn("sigma", sigma).drop("spread"), confidence)


def backtest(valued: DataFrame) -> DataFrame:
    """Errors of ``value_grosze`` against ``actual_grosze`` by segment and in all: median and mean error, coverage, share within 20 %."""
    error = F.abs(F.col("value_grosze") - F.col("actual_grosze")) / F.col("actual_grosze")
    inside = F.col("actual_grosze").between(F.col("low_grosze"), F.col("high_grosze"))
    rows = valued.where("actual_grosze > 0").withColumn("error", error).withColumn("inside", inside.cast("double"))
    rows = rows.withColumn("segment", F.explode(F.array("segment", F.lit("*"))))
    middle = stats.quantiles(rows, ["segment"], "error", [0.5]).select("segment", F.col("q")[0].alias("mdape"))
    found = rows.groupBy("segment").agg(
        F.count("*").alias("n"), F.avg("error").alias("mape"), F.avg("inside").alias("coverage"),
        F.avg((F.col("error") <= 0.20).cast("double")).alias("within_20"),
    )
    return found.join(middle, "segment")


def fitted_slopes(sales: DataFrame, least: int = 200, bounds: tuple[float, float] = (0.4, 1.1)) -> DataFrame:
    """``(segment, n, slope, intercept, r2, accepted)``: log price on log area, for segments with enough sales."""
    rows = sales.select(F.col("tx_segment").alias("segment"), F.log("tx_area").alias("x"), F.log(F.col("tx_price_m2") * F.col("tx_area")).alias("y"))
    out = stats.slope(rows, ["segment"], "x", "y").where(F.col("n") >= least)
    return out.withColumn("accepted", F.col("slope").between(*bounds))


def fitted_curves(sales: DataFrame, knots: tuple[float, ...] = KNOTS, least: int = 200, beside: int = 30) -> DataFrame:
    """``(segment, n, intercept, slope, knots, deltas, r2)``: least squares of log price on log area that bends at ``knots``.

    A knot stays if ``beside`` sales lie on either side. Sums of products are formed in one
    aggregation; only they, a few numbers a segment, are solved in a small Python step.
    """
    x, y = F.log("tx_area"), F.log(F.col("tx_price_m2") * F.col("tx_area"))
    terms = [F.lit(1.0), x, *[F.greatest(F.lit(0.0), x - math.log(k)) for k in knots]]
    named = {f"x{i}": t for i, t in enumerate(terms)} | {"y": y}
    rows = sales.where("tx_area > 0 and tx_price_m2 > 0").select(F.col("tx_segment").alias("segment"), "tx_area", *[c.alias(n) for n, c in named.items()])
    pairs = [(a, b) for i, a in enumerate(named) for b in list(named)[i:]]
    sums = rows.groupBy("segment").agg(
        F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs], *[F.count_if(F.col("tx_area") > k).alias(f"over_{i}") for i, k in enumerate(knots)]
    ).where(F.col("n") >= least)

    def solve(batches):
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                kept = [i for i in range(len(knots)) if min(r[f"over_{i}"], r["n"] - r[f"over_{i}"]) >= beside]
                use = ["x0", "x1", *[f"x{i + 2}" for i in kept]]
                at = lambda a, b, r=r: r[f"{a}_{b}"] if f"{a}_{b}" in r else r[f"{b}_{a}"]
                left, right = np.array([[at(a, b) for b in use] for a in use]), np.array([at(a, "y") for a in use])
                w = np.linalg.lstsq(left, right, rcond=None)[0]
                total = r["y_y"] - r["x0_y"] ** 2 / r["n"]
                rest = r["y_y"] - 2 * w @ right + w @ left @ w
                out.append((r["segment"], r["n"], w[0], w[1], [float(knots[i]) for i in kept], w[2:].tolist(), 1 - rest / total if total > 0 else None))
            yield pd.DataFrame(out, columns=["segment", "n", "intercept", "slope", "knots", "deltas", "r2"])

    return sums.mapInPandas(solve, "segment string, n bigint, intercept double, slope double, knots array<double>, deltas array<double>, r2 double")


def blended(targets: DataFrame, sales: DataFrame, confidence: float = 0.80) -> DataFrame:
    """Model 2 with the result of model 1 as a neighbour of its own weight."""
    prior = model_1(targets, sales, confidence).select("target_id", F.col("mu").alias("prior_mu"))
    return nearest_neighbours(targets, select_segments(spatial_comparables(targets, sales)), confidence, prior)


def shown_comparables(comps: DataFrame, most: int = 12) -> DataFrame:
    """``(target_id, shown)``: the comparables that explain a value: the most local, then the closest in area, then the newest."""
    local = F.array_position(F.array(*[F.lit(lv) for lv in LEVELS]), F.col("level"))
    return _shown(comps, [F.desc(local), F.abs(F.log(F.col("tx_area") / F.col("area_m2"))), F.desc("tx_date"), F.col("tx_id")], most)


def shown_sales(targets: DataFrame, sales: DataFrame, most: int = 12, per_level: int = PER_LEVEL) -> DataFrame:
    """``(target_id, place, tx_id, level)``: as ``shown_comparables``, from ``level_medians``."""
    levels = level_medians(targets, sales, per_level, most).where(F.size("shown") > 0)
    best = levels.select("target_id", "level", F.posexplode("shown").alias("k", "at"))
    local = F.array_position(F.array(*[F.lit(lv) for lv in LEVELS]), F.col("level"))
    best = staged(best.withColumn("place", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc(local), "k"))), "shown-sales")
    named = sales.where("tx_date is not null").select("tx_id", _place(F.row_number().over(Window.partitionBy("tx_date").orderBy("tx_id"))).alias("at"))
    return best.join(named, "at").select("target_id", "place", "tx_id", "level")


def shown_neighbours(comps: DataFrame, most: int = 12) -> DataFrame:
    """``(target_id, shown)``: the nearest comparables."""
    return _shown(comps, [F.col("dist_m"), F.col("tx_id")], most)


def _shown(comps: DataFrame, order: list[Column], most: int) -> DataFrame:
    rows = comps.withColumn("place", F.row_number().over(Window.partitionBy("target_id").orderBy(*order))).where(F.col("place") <= most)
    item = F.struct("place", "tx_id", "level", "tx_date", "tx_area", "tx_price_m2")
    return rows.groupBy("target_id").agg(F.array_sort(F.collect_list(item)).alias("shown"))


def relative_spread(sigma: Column) -> Column:
    """The typical error of a value as a share of it."""
    return F.exp(sigma) - 1

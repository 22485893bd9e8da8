"""Joins by distance, on the cells of a grid: within a radius, and to the nearest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlens.operators import stats
from plotlens.session import drop_staged, staged


def cell(e: str | Column, n: str | Column, size: float) -> Column:
    """The grid cell of a point, by floor division."""
    e, n = (F.col(c) if isinstance(c, str) else c for c in (e, n))
    return F.struct(F.floor(e / size).cast("bigint").alias("x"), F.floor(n / size).cast("bigint").alias("y"))


def around(e: str, n: str, size: float) -> Column:
    """The cell of a point and its eight neighbours, as an array."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    own = cell(e, n, size)
    return F.transform(offsets, lambda o: F.struct((own["x"] + o["dx"]).alias("x"), (own["y"] + o["dy"]).alias("y")))


def distance(e1, n1, e2, n2) -> Column:
    return F.sqrt(F.pow(F.col(e1) - F.col(e2), 2) + F.pow(F.col(n1) - F.col(n2), 2))


def placed(rows: DataFrame) -> DataFrame:
    """Rows whose point is finite: not null, not NaN, not infinite."""
    return rows.where("abs(e) < double('infinity') and abs(n) < double('infinity')")  # NaN is above infinity, null is unknown


def within(left: DataFrame, right: DataFrame, radius: float, name: str = "dist_m") -> DataFrame:
    """Pairs of rows at most ``radius`` apart; both have ``e`` and ``n``, the right ones come back as ``e2`` and ``n2``.

    Cells are as wide as the radius, so a partner is in the same cell or one next to it. The left,
    the smaller side, is repeated for nine cells. Rows without a finite point have no partner.
    """
    a = placed(left).withColumn("__cell", F.explode(around("e", "n", radius)))
    b = placed(right).withColumnsRenamed({"e": "e2", "n": "n2"}).withColumn("__cell", cell("e2", "n2", radius))
    joined = a.join(b, "__cell").withColumn(name, distance("e", "n", "e2", "n2"))
    return joined.where(F.col(name) <= radius).drop("__cell")


#: Right rows of a block and left rows of a chunk: what a task holds of two cells at a time.
BLOCK, CHUNK = 32_768, 64
#: The step of a missing value.
NO_STEP = -(1 << 62)


def _packed(rows: DataFrame, size: int, columns: list[str], name: str) -> DataFrame:
    """``(x, y, part, name)``: the rows of each cell in pieces of about ``size``, each with arrays of ``columns`` as a struct."""
    counts = rows.groupBy("x", "y").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    parts = rows.join(counts, ["x", "y"]).withColumn("part", F.floor(F.rand() * F.col("parts")).cast("int"))
    pieces = parts.groupBy("x", "y", "part").agg(F.collect_list(F.struct(*columns)).alias("held"))
    return pieces.select("x", "y", "part", F.struct(*[F.col("held")[c].alias(c) for c in columns]).alias(name))


def within_quantiles(left: DataFrame, right: DataFrame, key: str, value: str, radius: float, qs: list[float]) -> DataFrame:
    """``(key, n, nearest, q)``: the right rows at most ``radius`` from each left row: how many, how near, and exact quantiles of ``value``.

    No pair becomes a row. Pieces of two neighbouring cells meet as arrays; a first pass counts the values in reach by
    their steps (``stats.step_of``), a second one takes the values of the steps that hold the wanted ranks. The distances
    are as many as in ``within``; what is shuffled grows with the left rows. Left rows without a partner are left out.
    """
    b = placed(right).select(F.col("e").cast("double").alias("e2"), F.col("n").cast("double").alias("n2"), F.col(value).cast("double").alias("v"))
    b = b.withColumns({"s": F.when(F.col("v").isNull(), NO_STEP).otherwise(stats.step_of("v")), "c": cell("e2", "n2", radius)}).select("c.x", "c.y", "e2", "n2", "v", "s")
    blocks = staged(_packed(b, BLOCK, ["e2", "n2", "v", "s"], "b"), "blocks-within")
    a = placed(left).select(F.col(key).alias("k"), F.col("e").cast("double").alias("e"), F.col("n").cast("double").alias("n"))
    kind = a.schema["k"].dataType.simpleString()

    numbers = blocks.groupBy("x", "y").agg(F.collect_list("part").alias("parts"))
    tasks = 8 * left.sparkSession.sparkContext.defaultParallelism

    def met(asked: DataFrame) -> DataFrame:
        """Chunks of left rows, repeated for nine cells, with each block of the cell; a crowded cell is dealt out by its blocks."""
        columns = asked.columns
        cells = asked.withColumn("c", F.explode(around("e", "n", radius))).select("c.x", "c.y", *columns)
        chunks = _packed(cells, CHUNK, columns, "a").drop("part").join(numbers, ["x", "y"]).select("x", "y", F.explode("parts").alias("part"), "a")
        return chunks.repartition(tasks, "x", "y", "part").join(blocks, ["x", "y", "part"]).select("a", "b")

    def rows_of(df: pd.DataFrame):
        """Each left row with the distances of a block, of which it is near some."""
        for a, b in zip(df["a"], df["b"], strict=True):
            e2, n2, v, s = (np.asarray(b[c], dtype=t) for c, t in (("e2", float), ("n2", float), ("v", float), ("s", "int64")))
            for i, (e, n) in enumerate(zip(a["e"], a["n"], strict=True)):
                d = np.sqrt((e - e2) ** 2 + (n - n2) ** 2)
                near = d <= radius
                if near.any():
                    yield a, i, d, near, v, s

    def count(batches):
        for df in batches:
            out = []
            for a, i, d, near, _, s in rows_of(df):
                steps, held = np.unique(s[near], return_counts=True)
                out.append((a["k"][i], int(held.sum()), float(d.min()), steps.tolist(), held.tolist()))
            yield pd.DataFrame(out, columns=["k", "n", "nearest", "steps", "held"])

    def values(batches):
        for df in batches:
            out = []
            for a, i, _, near, v, s in rows_of(df):
                hit = near & np.isin(s, np.asarray(a["wanted"][i]))
                if hit.any():
                    out.append((a["k"][i], s[hit].tolist(), v[hit].tolist()))
            yield pd.DataFrame(out, columns=["k", "s", "v"])

    found = staged(met(a).mapInPandas(count, f"k {kind}, n bigint, nearest double, steps array<bigint>, held array<bigint>"), "counts-within")
    hist = found.select("k", F.explode(F.arrays_zip("steps", "held")).alias("h")).groupBy("k", F.col("h.steps").alias("__s")).agg(F.sum("h.held").alias("c")).where(F.col("__s") != NO_STEP)
    wanted = staged(stats.wanted_ranks(hist, ["k"], qs), "wanted-within")
    asked = a.join(wanted.groupBy("k").agg(F.collect_set("__s").alias("wanted")), "k")
    rows = met(asked).mapInPandas(values, f"k {kind}, s array<bigint>, v array<double>")
    rows = rows.select("k", F.explode(F.arrays_zip("s", "v")).alias("h")).select("k", F.col("h.s").alias("__s"), F.col("h.v").alias("__v"), F.lit(1).alias("__c"))
    middle = staged(stats.values_at(rows, wanted, ["k"], qs, "q"), "quantiles-within")
    out = found.groupBy("k").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest")).join(middle.select("k", "q"), "k", "left")
    drop_staged(blocks, wanted)
    return out.withColumnRenamed("k", key)


#: Cells of one width that a cell of the next one is cut into, along a side.
FAN = 4


def closest_cells(asked: DataFrame, counts: DataFrame, key: str, width: float, top: int, by: tuple[str, ...] = (), kinds: tuple[str, ...] = (), may: Column | None = None, surely: Column | None = None) -> DataFrame:
    """``(key, x, y)``: the cells of ``width`` that may hold one of the ``need`` nearest points of a row, at most ``limit`` away.

    ``asked`` has ``key, e, n, need, limit``, the columns ``by`` and the cells ``start`` of the widest grid, ``top`` steps
    up. ``counts`` has a row ``x, y, held`` for each cell with points or, with ``kinds``, for each of their kinds; then ``may`` and
    ``surely`` tell from ``by`` and ``kinds`` whether such points may count for a row, and surely do. Going down a step, the
    farthest corners of the cells bound the distance of the last point that is needed, and a cell that begins beyond the
    bound goes. So counts are read of a few cells a step, and no points at all.
    """
    names, tasks = [key, "e", "n", "need", "limit", *by], 4 * asked.sparkSession.sparkContext.defaultParallelism
    open_ = asked.select(*names, F.explode("start").alias("c")).select(*names, "c.x", "c.y")
    inner = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(FAN) for dy in range(FAN)])
    for step in range(top, -1, -1):
        size, part = width * FAN**step, FAN**step
        level = counts.groupBy(F.floor(F.col("x") / part).alias("x"), F.floor(F.col("y") / part).alias("y"), *kinds).agg(F.sum("held").alias("held")) if step else counts
        if kinds:  # the tables are small, and meeting the kinds is the work
            cells = open_.repartition(tasks, "x", "y").join(level, ["x", "y"]).where(may)
            cells = cells.groupBy(*names, "x", "y").agg(F.sum(F.when(surely, F.col("held")).otherwise(0)).alias("held"))
        else:
            cells = open_.join(level, ["x", "y"])
        for axis, point in (("x", "e"), ("y", "n")):
            low, high = F.col(axis) * size - F.col(point), (F.col(axis) + 1) * size - F.col(point)
            cells = cells.withColumns({f"near_{axis}": F.greatest(low, -high, F.lit(0.0)), f"far_{axis}": F.greatest(-low, high)})
        cells = cells.select(*names, "x", "y", "held", *[F.sqrt(F.pow(f"{w}_x", 2) + F.pow(f"{w}_y", 2)).alias(w) for w in ("near", "far")])
        so_far = F.sum("held").over(Window.partitionBy(key).orderBy("far", "x", "y").rowsBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(F.col("so_far") >= F.col("need"), F.col("far"))).over(Window.partitionBy(key))
        reach = F.least(bound, F.col("limit"))  # that of the two which is known
        cells = cells.withColumn("so_far", so_far).withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("near") <= F.col("reach") * (1 + 1e-9) + 1e-3))
        if step:
            open_ = cells.select(*names, "x", "y", F.explode(inner).alias("d")).select(*names, (F.col("x") * FAN + F.col("d.dx")).alias("x"), (F.col("y") * FAN + F.col("d.dy")).alias("y"))
    return cells.select(key, "x", "y")


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, size: float) -> DataFrame:
    """``(key, right_key, dist_m)``: the nearest right row of each left row, the smaller key on a tie.

    Two rounds. A partner within ``size`` is looked for in the cell of that width and its neighbours. For rows without one,
    counts by cell, from cells around all points down to those of ``size``, tell where the nearest point may be
    (``closest_cells``). Points of one place are one candidate: the smallest key stands for them. Rows without a finite
    point, on either side, are left out.
    """
    points = placed(right).groupBy((F.col("e") + 0.0).alias("e2"), (F.col("n") + 0.0).alias("n2")).agg(F.min(right_key).alias(right_key))
    points = staged(points.withColumn("c", cell("e2", "n2", size)).select("c.x", "c.y", "e2", "n2", right_key), "nearest-points")
    extent = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")]).first()
    asked = placed(left).select(key, "e", "n")
    if extent["min_x"] is None:
        return asked.select(key, F.lit(None).cast(right.schema[right_key].dataType).alias(right_key), F.lit(None).cast("double").alias("dist_m")).limit(0)
    asked = staged(asked, "nearest-asked")

    def best_of(cells: DataFrame) -> DataFrame:
        pairs = cells.join(points, ["x", "y"]).withColumn("dist_m", distance("e", "n", "e2", "n2"))
        return pairs.groupBy(key).agg(F.min(F.struct("dist_m", right_key)).alias("best")).select(key, f"best.{right_key}", "best.dist_m")

    near = staged(best_of(asked.withColumn("c", F.explode(around("e", "n", size))).select(key, "e", "n", "c.x", "c.y")).where(F.col("dist_m") <= size), "nearest-first")
    open_ = asked.join(near.select(key), key, "left_anti").withColumns({"need": F.lit(1), "limit": F.lit(None).cast("double")})
    top, spread = 0, [range(extent[f"min_{c}"], extent[f"max_{c}"] + 1) for c in ("x", "y")]
    while max(s.stop - s.start for s in spread) > FAN**top:
        top += 1
    columns, lines = (sorted({s[0] // FAN**top, s[-1] // FAN**top}) for s in spread)  # two at most
    start = F.array(*[F.struct(F.lit(x).cast("bigint").alias("x"), F.lit(y).cast("bigint").alias("y")) for x in columns for y in lines])
    counts = staged(points.groupBy("x", "y").agg(F.count("*").alias("held")), "nearest-cells")
    far = closest_cells(open_.withColumn("start", start), counts, key, size, top)
    return near.union(staged(best_of(far.join(open_.select(key, "e", "n"), key)), "nearest-far"))


def tiles(points: DataFrame, most: int = 5000, smallest: float = 1000.0, largest: float = 64_000.0) -> DataFrame:
    """``(size, x, y, n)``: square tiles that are split in four while they hold over ``most`` points and stay above ``smallest``.

    A level at a time, over counts only: the points of tiles that are fine are not looked at again.
    """
    size = finest = largest
    while finest / 2 >= smallest:
        finest /= 2
    base = staged(placed(points).groupBy(cell("e", "n", finest).alias("c")).agg(F.count("*").alias("n")).select("c.x", "c.y", "n"), "tile-counts")
    out, open_ = None, base
    while True:
        step = int(size / finest)
        key = F.struct(F.floor(F.col("x") / step).alias("tx"), F.floor(F.col("y") / step).alias("ty"))
        sums = open_.groupBy(key.alias("t")).agg(F.sum("n").alias("n"))
        last = size / 2 < finest
        fine = sums.where((F.col("n") <= most) | F.lit(last))
        part = fine.select(F.lit(float(size)).alias("size"), F.col("t.tx").alias("x"), F.col("t.ty").alias("y"), "n")
        out = part if out is None else out.union(part)
        if last:
            return out
        open_ = open_.withColumn("t", key).join(sums.where(F.col("n") > most).select("t"), "t", "left_semi").drop("t")
        size /= 2

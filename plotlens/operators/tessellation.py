"""Polygons cut into cells: inner cells that need no test, and border cells with the few sides that pass them.

A shape is any number of polygons, each an outline and the holes behind it; a point is inside if it
is inside an odd number of rings. The cells of a shape are squares of a grid that halves from level
to level. A cell without a side is inner or outer as a whole; one with sides is quartered down to
the wanted width, and further while many sides pass it. So a shape has as many cells as its border
is long, whatever the size of its box, and a point meets a shape only in the one cell it lies in.

A cell knows whether its south-west corner is inside. From there to a point the way leads north
along the western side, then east, and each side that crosses it changes the answer. Both legs stay
in the cell, so its own sides are enough. Where the way passes a side too closely for the rounding
of doubles, the point is tested against the whole shape instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlens.functions import geo
from plotlens.operators.grid import placed
from plotlens.session import drop_staged, staged

#: Width of a border cell in metres, sides that one may have, and how often it is halved for them at most.
SIZE_M, SIDES, DEEPEST = 500.0, 12, 8
#: The grid begins off round coordinates, on which corners and borders of shapes are likely.
ORIGIN = (0.1370562, 0.4283291)
#: Sides that are so near to a cell belong to it; a point so near to a side is on it; a way so near to a side is not trusted. Metres.
MARGIN, ON_BORDER, DOUBTFUL = 1e-3, 1e-9, 1e-6
#: Quarterings between two writes of what is still open.
PASSES = 2


def with_polygons(shapes: DataFrame) -> DataFrame:
    """``shapes`` with their outline as ``polygons`` (polygons of rings), from that column, ``rings`` (one polygon) or ``ring`` (without holes)."""
    if "polygons" in shapes.columns:
        return shapes
    if "rings" in shapes.columns:
        return shapes.withColumn("polygons", F.when(F.col("rings").isNotNull(), F.array("rings"))).drop("rings")
    return shapes.withColumn("polygons", F.when(F.col("ring").isNotNull(), F.array(F.array("ring")))).drop("ring")


def _north(e: str, n0: str, n: str) -> str:
    """SQL: whether an odd number of ``sides`` is crossed on the way from ``(e, n0)`` north to ``(e, n)``; what is on a line counts as west of it."""
    height = f"(s.n1 + ({e} - s.e1) * (s.n2 - s.n1) / (s.e2 - s.e1))"
    below = lambda to: f"({height} < {to} or ({height} = {to} and (s.n2 - s.n1) * (s.e2 - s.e1) <= 0))"
    return f"size(filter(sides, s -> (s.e1 > {e}) != (s.e2 > {e}) and {below(n0)} != {below(n)})) % 2 = 1"


def _east(n: str, e0: str, e: str) -> str:
    """SQL: whether an odd number of ``sides`` is crossed on the way from ``(e0, n)`` east to ``(e, n)``, by the rule of ``geo.inside``."""
    place = f"(s.e1 + ({n} - s.n1) * (s.e2 - s.e1) / (s.n2 - s.n1))"
    return f"size(filter(sides, s -> (s.n1 > {n}) != (s.n2 > {n}) and {place} > {e0} and {place} <= {e})) % 2 = 1"


def _near(distance: float, *places: tuple[str, str]) -> str:
    """SQL: whether one of ``sides`` comes so near to one of the places; ``t`` is how far along a side its nearest point is."""

    def one(e, n):
        along = f"coalesce(try_divide(({e} - s.e1) * (s.e2 - s.e1) + ({n} - s.n1) * (s.n2 - s.n1), (s.e2 - s.e1) * (s.e2 - s.e1) + (s.n2 - s.n1) * (s.n2 - s.n1)), 0D)"
        t = f"greatest(0D, least(1D, {along}))"
        return f"hypot({e} - s.e1 - {t} * (s.e2 - s.e1), {n} - s.n1 - {t} * (s.n2 - s.n1)) <= {distance!r}D"

    return f"exists(sides, s -> {' or '.join(one(*p) for p in places)})"


#: The sides that may pass a square: their box meets it, and its corners are not all on one hand of them.
_HAND = [f"(s.e2 - s.e1) * ({n} - s.n1) - (s.n2 - s.n1) * ({e} - s.e1)" for e in ("w", "e") for n in ("s0", "n")]
_TOUCHING = (
    "filter(sides, s -> least(s.e1, s.e2) <= e and greatest(s.e1, s.e2) >= w and least(s.n1, s.n2) <= n and greatest(s.n1, s.n2) >= s0 "
    f"and least({', '.join(_HAND)}) <= 0 and greatest({', '.join(_HAND)}) >= 0)"
)
#: Width, western and southern line of a cell.
_WIDTH = f"{SIZE_M!r}D * pow(2D, level)"
_CORNER = [f"{_WIDTH} AS width", f"{ORIGIN[0]!r}D + x * {_WIDTH} AS west", f"{ORIGIN[1]!r}D + y * {_WIDTH} AS south"]


def _first(shapes: DataFrame, id_: str) -> DataFrame:
    """The cells, four at most, that hold a shape: their width is at least that of its box. All are open."""
    sides = F.flatten(F.transform(F.flatten("polygons"), geo.edges))
    rows = shapes.where("polygons is not null").select(F.col(id_).alias("id"), F.filter(sides, lambda s: s["e1"].isNotNull()).alias("sides")).where("size(sides) > 0")
    ends = lambda f, g, a: f"array_{f}(transform(sides, s -> {g}(s.{a}1, s.{a}2))) AS {a}_{f}"
    rows = rows.selectExpr("*", *[ends(f, g, a) for a in "en" for f, g in (("min", "least"), ("max", "greatest"))])
    rows = rows.selectExpr("*", f"cast(ceil(log2((greatest(e_max - e_min, n_max - n_min, {SIZE_M!r}D) + {4 * MARGIN!r}D) / {SIZE_M!r}D)) as int) AS level").selectExpr("*", f"{_WIDTH} AS width")
    span = lambda a, o: f"sequence(floor(({a}_min - {MARGIN!r}D - {o!r}D) / width), floor(({a}_max + {MARGIN!r}D - {o!r}D) / width))"
    rows = rows.selectExpr("*", f"explode({span('e', ORIGIN[0])}) AS x").selectExpr("*", f"explode({span('n', ORIGIN[1])}) AS y").drop("width").selectExpr("*", *_CORNER)
    outside = f"least(e_min - {MARGIN!r}D, west)"  # the way from there is all of the row that sides can be in
    return rows.selectExpr("id", "level", "x", "y", "sides", f"{_east('south', outside, 'west')} AS odd", f"not {_near(DOUBTFUL, ('west', 'south'))} AS sure", "'open' AS kind")


def _settled(cells: DataFrame) -> DataFrame:
    """Open cells with the sides that touch them and what they are (``kind``: inner, border or still open), without outer ones."""
    own = ["id", "level", "x", "y", "odd", "sure", "kind"]
    m = f"{MARGIN!r}D"
    rows = cells.selectExpr("*", *_CORNER).selectExpr(*own, "sides", f"west - {m} AS w", f"south - {m} AS s0", f"west + width + {m} AS e", f"south + width + {m} AS n")
    rows = rows.selectExpr(*own, f"case when kind = 'open' then {_TOUCHING} else sides end AS sides").selectExpr("*", "size(sides) AS passing")
    fine = f"level <= {-DEEPEST} or (level <= 0 and passing <= {SIDES})"
    kind = f"case when kind <> 'open' then kind when sure and passing = 0 then if(odd, 'inner', 'outer') when passing = 0 or {fine} then 'border' else 'open' end"
    return rows.selectExpr("id", "level", "x", "y", "sides", "odd", "sure", f"{kind} AS kind")


def _quarters(cells: DataFrame) -> DataFrame:
    """The four quarters of open cells, other cells but outer ones as they are."""
    own = ["id", "level", "x", "y", "sides", "odd", "sure", "kind"]
    rows = cells.where("kind <> 'outer'").selectExpr("*", *_CORNER).selectExpr(*own, "west", "south", "west + width / 2 AS centre", "south + width / 2 AS middle")
    rows = rows.selectExpr(
        *own, f"odd != ({_north('west', 'south', 'middle')}) AS up", f"{_east('south', 'west', 'centre')} AS low_turn", f"{_east('middle', 'west', 'centre')} AS high_turn",
        f"sure and not {_near(DOUBTFUL, ('west', 'middle'), ('centre', 'south'), ('centre', 'middle'))} AS still",
    )
    kid = lambda x, y, odd, sure="still", down=1: f"named_struct('level', level - {down}, 'x', {x}, 'y', {y}, 'odd', {odd}, 'sure', {sure})"
    kids = f"array({kid('2 * x', '2 * y', 'odd')}, {kid('2 * x + 1', '2 * y', 'odd != low_turn')}, {kid('2 * x', '2 * y + 1', 'up')}, {kid('2 * x + 1', '2 * y + 1', 'up != high_turn')})"
    rows = rows.selectExpr("id", "sides", "kind", f"explode(if(kind = 'open', {kids}, array({kid('x', 'y', 'odd', 'sure', 0)}))) AS k")
    return rows.selectExpr("id", "k.level", "k.x", "k.y", "sides", "k.odd", "k.sure", "kind")


def cells_of(shapes: DataFrame, id_: str) -> DataFrame:
    """``(id, level, x, y, inner, sides, odd, sure)`` of all shapes, staged: two quarterings a pass over the open cells, nothing is shuffled."""
    open_, parts = _first(shapes, id_), []
    while True:
        now = _settled(open_)
        for _ in range(PASSES):
            now = _settled(_quarters(now))
        parts.append(staged(now, "cells"))
        open_ = parts[-1].where("kind = 'open'")
        if open_.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    out = out.where("kind in ('inner', 'border')").selectExpr("id", "level", "x", "y", "kind = 'inner' AS inner", "sides", "odd", "sure")
    out = staged(out, "shape-cells")
    drop_staged(*parts)
    return out


def candidates(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``points`` beside the cells that they lie in, one of a shape at most: an equi-join, for each width of cells that occurs."""
    levels = [r[0] for r in cells.select("level").distinct().collect()]  # a dozen or so, as widths double
    at = lambda c, o, k: f"floor(({c} - {o!r}D) / {SIZE_M * 2.0**k!r}D)"
    keys = ", ".join(f"named_struct('level', {k}, 'x', {at('e', ORIGIN[0], k)}, 'y', {at('n', ORIGIN[1], k)})" for k in levels)
    keys = f"array({keys})" if levels else "cast(array() as array<struct<level:int,x:bigint,y:bigint>>)"
    return placed(points).withColumn("__key", F.explode(F.expr(keys))).join(cells.selectExpr("id", "named_struct('level', level, 'x', x, 'y', y) AS __key", "inner", "sides", "odd", "sure"), "__key")


def covering(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pairs of a point (``e``, ``n``) and a shape (``polygons``, ``rings`` or ``ring``) that covers it; the boundary counts.

    What comes back of a shape is all its other columns. Shapes without an outline and points
    without finite coordinates have no pair; repeated rows are paired each.
    """
    numbered = staged(with_polygons(shapes).withColumn("__id", F.monotonically_increasing_id()), "shapes")
    cells = cells_of(numbered, "__id")
    rows = candidates(points, cells).withColumns({"__corner": F.expr(f"{SIZE_M!r}D * pow(2D, __key.level)")})
    rows = rows.withColumns({"__west": F.expr(f"{ORIGIN[0]!r}D + __key.x * __corner"), "__south": F.expr(f"{ORIGIN[1]!r}D + __key.y * __corner")})
    inside = f"odd != (({_north('__west', '__south', 'n')}) != ({_east('n', '__west', 'e')}))"
    state = f"case when inner or {_near(ON_BORDER, ('e', 'n'))} then 'hit' when not sure or {_near(DOUBTFUL, ('__west', 'n'))} then 'doubt' when {inside} then 'hit' end"
    met = rows.withColumn("__state", F.expr(state)).where("__state is not null").select(*[F.col(f"`{c}`") for c in points.columns], F.col("id").alias("__id"), "__state")
    met = staged(met, "points-in-cells")
    attributes = numbered.drop("polygons")
    hits = met.where("__state = 'hit'").drop("__state").join(attributes, "__id")
    checked = met.where("__state = 'doubt'").drop("__state").join(numbered, "__id").where(geo.in_polygons(F.col("e"), F.col("n"), F.col("polygons"))).drop("polygons")
    return hits.unionByName(checked).drop("__id")

"""Spatial joins: grid-binned candidates with an owner cell, at the level of each shape's size.

A shape is put into the few cells, of a size like its own, that its box meets;
two shapes meet at the coarser of their levels. So a large shape costs a few
rows rather than one for each fine cell, and a pair is found exactly once, in
the cell of the larger of both lower corners, without a ``distinct``.

Cells grow only as far as one holds about ``PER_CELL`` shapes on average: a
chip-wide shape is put into many cells of that size rather than one cell being
given all shapes of the chip.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")
#: Shapes that a cell of the coarsest level holds, about.
PER_CELL = 20_000


def _level(cell: int, margin: int) -> Column:
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * margin
    return F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1)) / F.lit(cell))), F.lit(0)).cast("int")


def _binned(t: DataFrame, side: str, margin: int, cell: int, levels: list[int], carry: Sequence[str]) -> DataFrame:
    t = t.withColumn("__own", F.least(_level(cell, margin), F.lit(levels[-1]))).withColumn("__lv", F.explode(F.filter(F.lit(levels), lambda v: v >= F.col("__own"))))
    size = F.element_at(F.create_map(*[F.lit(x) for v in levels for x in (v, cell << v)]), F.col("__lv"))
    low = lambda c, m: F.floor((F.col(c) - m) / size).cast("long")
    high = lambda c, m: F.floor((F.col(c) + m) / size).cast("long")
    t = t.withColumns({"__gx0": low("x0", margin), "__gy0": low("y0", margin), "__gx1": high("x1", margin), "__gy1": high("y1", margin)})
    t = t.withColumn("__gx", F.explode(F.sequence("__gx0", "__gx1"))).withColumn("__gy", F.explode(F.sequence("__gy0", "__gy1")))
    return t.select(F.col("__lv").alias("lv"), F.col("__gx").alias("gx"), F.col("__gy").alias("gy"), *[F.col(c).alias(f"{side}{c}") for c in ("__own", "__gx0", "__gy0")], *[F.col(c).alias(f"{side}_{c}") for c in carry])


def size_levels(tables: Sequence[tuple[DataFrame, int]], cell: int = 512, per_cell: int = PER_CELL) -> list[int]:
    """The levels of the shapes of ``(table, margin)``, none coarser than one whose cells hold ``per_cell`` shapes on average. Eager."""
    found = None
    for t, margin in tables:
        own = t.select(_level(cell, margin).alias("lv"), *BOX)
        found = own if found is None else found.union(own)
    rows = found.groupBy("lv").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).collect()
    rows = [r for r in rows if r["lv"] is not None]
    if not rows:
        return [0]
    n = sum(r["n"] for r in rows)
    area = max(max(r["x1"] for r in rows) - min(r["x0"] for r in rows), 1) * max(max(r["y1"] for r in rows) - min(r["y0"] for r in rows), 1)
    # a cell of side s holds n * s * s / area shapes
    top = max(math.ceil(math.log2(max(math.sqrt(area * per_cell / n) / cell, 1.0))), 0)
    return sorted({min(r["lv"], top) for r in rows})


def candidates(a: DataFrame, b: DataFrame | None = None, margin: int = 0, on: Sequence[str] = (), cell: int = 512, levels: list[int] | None = None) -> DataFrame:
    """Pairs whose closed boxes are within ``margin`` of each other per axis, once each.

    ``a`` and ``b`` have ``id, x0, y0, x1, y1`` and the equality keys ``on``;
    all columns come out as ``a_*`` and ``b_*``. Without ``b``, unordered pairs
    of ``a`` with ``a_id < b_id``. ``levels``: the size levels to use, where
    they are known; else one small aggregation (a row for each level) finds them.
    """
    other = a if b is None else b
    if levels is None:
        levels = size_levels([(a, margin)] if b is None else [(a, margin), (b, 0)], cell)
    left = _binned(a, "a", margin, cell, levels, a.columns)
    right = _binned(other, "b", 0, cell, levels, other.columns).withColumnsRenamed({"lv": "b_lv", "gx": "b_gx", "gy": "b_gy"})
    met = (F.col("lv") == F.col("b_lv")) & (F.col("gx") == F.col("b_gx")) & (F.col("gy") == F.col("b_gy"))
    for k in on:
        met = met & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    met = met & (F.col("lv") == F.greatest("a__own", "b__own"))
    met = met & (F.col("gx") == F.greatest("a__gx0", "b__gx0")) & (F.col("gy") == F.greatest("a__gy0", "b__gy0"))
    met = met & (F.col("a_x0") - margin <= F.col("b_x1")) & (F.col("b_x0") - margin <= F.col("a_x1"))
    met = met & (F.col("a_y0") - margin <= F.col("b_y1")) & (F.col("b_y0") - margin <= F.col("a_y1"))
    if b is None:
        met = met & (F.col("a_id") < F.col("b_id"))
    pairs = left.join(right, met)
    return pairs.select(*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in other.columns])


def gap(axis: str) -> Column:
    """Distance of the two boxes along an axis, 0 where they overlap or touch."""
    return F.greatest(F.col(f"a_{axis}0") - F.col(f"b_{axis}1"), F.col(f"b_{axis}0") - F.col(f"a_{axis}1"), F.lit(0)).cast("long")


def overlap(axis: str) -> Column:
    """Signed length that the two boxes share along an axis."""
    return (F.least(f"a_{axis}1", f"b_{axis}1") - F.greatest(f"a_{axis}0", f"b_{axis}0")).cast("long")


def distance2() -> Column:
    return gap("x") * gap("x") + gap("y") * gap("y")


def isqrt(v: Column) -> Column:
    """Floor of the square root, exact for longs."""
    r = F.floor(F.sqrt(v.cast("double"))).cast("long")
    r = F.when(r * r > v, r - 1).otherwise(r)
    return F.when((r + 1) * (r + 1) <= v, r + 1).otherwise(r)


def touching(t: DataFrame, on: Sequence[str] = ("layer",), cell: int = 512) -> DataFrame:
    """Edges ``(a, b)`` of boxes that share an edge, a corner or an area."""
    return candidates(t, None, 0, on, cell).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def tiled(boxes: DataFrame, tile: int | None = None) -> DataFrame:
    """``boxes`` cut at the borders of square tiles, with the tile's ``tx`` and ``ty``; the parts of a box are disjoint.

    ``tile``: the tiles' side; else sixteen times the boxes' mean longer side, by
    one small aggregation. Boxes without area stay whole, in the tile of their lower corner.
    """
    if tile is None:
        side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        tile = max(int(16 * (boxes.agg(F.avg(side)).first()[0] or 0)), 256)
    first = lambda c: F.floor(F.col(c) / tile).cast("long")
    last = lambda lo, hi: F.greatest(F.ceil(F.col(hi) / tile).cast("long") - 1, first(lo))
    t = boxes.withColumn("tx", F.explode(F.sequence(first("x0"), last("x0", "x1")))).withColumn("ty", F.explode(F.sequence(first("y0"), last("y0", "y1"))))
    low = lambda c, k: F.greatest(F.col(c), F.col(k) * tile).alias(c)
    high = lambda c, k: F.least(F.col(c), (F.col(k) + 1) * tile).alias(c)
    cut = {"x0": low("x0", "tx"), "y0": low("y0", "ty"), "x1": high("x1", "tx"), "y1": high("y1", "ty")}
    return t.select(*[cut.get(c, F.col(c)) for c in boxes.columns], "tx", "ty")

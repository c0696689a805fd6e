"""Metal fill: candidates on a grid, the first legal ones of each window until its density is met, and the check of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stage import staged
from .derived import areas, boolean
from .drc import density, violations
from .spatial import candidates

BOX = ["x0", "y0", "x1", "y1"]


def fill_candidates(region: tuple[int, int, int, int], window: int, size: int, pitch: int, pattern: str = "grid", spark=None) -> DataFrame:
    """``id, wx, wy, x0, y0, x1, y1``: squares of side ``size`` every ``pitch`` that lie whole in one window of the region, in rows from below.

    ``staggered`` moves every second row by half a pitch; ``chequerboard``
    leaves every second square out.
    """
    x0, y0, x1, y1 = region
    nx, ny = (x1 - x0) // pitch + 1, (y1 - y0) // pitch + 1
    g = spark.range(nx * ny).select("id", (F.col("id") % nx).alias("i"), F.expr(f"id div {nx}").alias("j"))
    if pattern == "chequerboard":
        g = g.where((F.col("i") + F.col("j")) % 2 == 0)
    elif pattern not in ("grid", "staggered"):
        raise ValueError(f"no pattern {pattern}")
    shift = F.when(F.col("j") % 2 == 1, pitch // 2).otherwise(0) if pattern == "staggered" else F.lit(0)
    g = g.select("id", (F.lit(x0) + F.col("i") * pitch + shift).alias("x0"), (F.lit(y0) + F.col("j") * pitch).alias("y0")).withColumns({"x1": F.col("x0") + size, "y1": F.col("y0") + size})
    at = lambda c, o: F.expr(f"({c} - {o}) div {window}")
    g = g.withColumns({"wx": at("x0", x0), "wy": at("y0", y0)})
    return g.where((F.col("x1") <= x1) & (F.col("y1") <= y1) & (F.expr(f"(x1 - {x0} - 1) div {window}") == F.col("wx")) & (F.expr(f"(y1 - {y0} - 1) div {window}") == F.col("wy"))).select("id", "wx", "wy", *BOX)


def window_areas(rects: DataFrame, region: tuple[int, int, int, int], window: int) -> DataFrame:
    """``wx, wy, covered``: the exact area of the union of boxes in each window of the region; windows without any have no row."""
    x0, y0, x1, y1 = region
    t = rects.select(*[F.greatest(F.col(c), F.lit(o)).alias(c) for c, o in (("x0", x0), ("y0", y0))], *[F.least(F.col(c), F.lit(o)).alias(c) for c, o in (("x1", x1), ("y1", y1))]).where("x1 > x0 and y1 > y0")
    t = t.withColumn("wx", F.explode(F.sequence(F.expr(f"(x0 - {x0}) div {window}"), F.expr(f"(x1 - {x0} - 1) div {window}")))).withColumn("wy", F.explode(F.sequence(F.expr(f"(y0 - {y0}) div {window}"), F.expr(f"(y1 - {y0} - 1) div {window}"))))
    low = lambda c, k, o: F.greatest(F.col(c), F.lit(o) + F.col(k) * window).alias(c)
    high = lambda c, k, o: F.least(F.col(c), F.lit(o) + (F.col(k) + 1) * window).alias(c)
    key = F.struct("wx", "wy")
    cut = t.select(key.alias("grp"), low("x0", "wx", x0), low("y0", "wy", y0), high("x1", "wx", x0), high("y1", "wy", y0))
    return areas(boolean(cut, cut.limit(0), "union")).select("grp.wx", "grp.wy", F.col("area").alias("covered"))


def fill(rects: DataFrame, region: tuple[int, int, int, int], window: int, low: float, high: float, size: int, pitch: int, spacing: int, pattern: str = "grid", keepout: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(fills(id, wx, wy, box), windows(wx, wy, before, after, status))``.

    A window below ``low`` takes its first legal candidates, in order, until it
    reaches it, and none that would bring it over ``high``. Legal: ``spacing``
    away from every shape, and outside ``keepout``. Candidates lie within one
    window and ``pitch`` apart, so windows don't depend on each other.
    ``Converged`` where the density lies within both bounds, else ``Infeasible``.
    """
    spark = rects.sparkSession
    if pitch < size + spacing:
        raise ValueError("the pitch leaves less than the spacing between fills")
    x0, y0, x1, y1 = region
    whole = fill_candidates(region, window, size, pitch, pattern, spark)
    near = candidates(whole.select("id", *BOX), rects.select("id", *BOX), spacing)
    gx = F.greatest(F.col("a_x0") - F.col("b_x1"), F.col("b_x0") - F.col("a_x1"), F.lit(0))
    gy = F.greatest(F.col("a_y0") - F.col("b_y1"), F.col("b_y0") - F.col("a_y1"), F.lit(0))
    taken = near.where(gx * gx + gy * gy < spacing * spacing).select(F.col("a_id").alias("bad"))
    if keepout is not None:
        over = candidates(whole.select("id", *BOX), keepout.select("id", *BOX)).where("a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1")
        taken = taken.union(over.select("a_id"))
    legal = whole.join(taken.distinct(), F.col("id") == F.col("bad"), "left_anti")
    nx, ny = -(-(x1 - x0) // window), -(-(y1 - y0) // window)
    grid = spark.range(nx * ny).select((F.col("id") % nx).alias("gx"), F.expr(f"id div {nx}").alias("gy"))
    w, h = (F.least(F.lit(e), F.lit(o) + (F.col(k) + 1) * window) - (F.lit(o) + F.col(k) * window) for e, o, k in ((x1, x0, "gx"), (y1, y0, "gy")))
    grid = grid.withColumn("size", w * h)
    state = grid.join(window_areas(rects, region, window), (F.col("gx") == F.col("wx")) & (F.col("gy") == F.col("wy")), "left").select(F.col("gx").alias("wx"), F.col("gy").alias("wy"), "size", F.coalesce("covered", F.lit(0)).alias("before"))
    one = size * size
    need = F.greatest(F.ceil((F.lit(low) * F.col("size") - F.col("before")) / one), F.lit(0))
    room = F.greatest(F.floor((F.lit(high) * F.col("size") - F.col("before")) / one), F.lit(0))
    state = staged(state.withColumn("take", F.least(need, room).cast("long")), "fill-windows")
    ranked = legal.withColumn("k", F.row_number().over(W.partitionBy("wx", "wy").orderBy("id")))
    fills = staged(ranked.join(state.select("wx", "wy", "take"), ["wx", "wy"]).where("k <= take").select("id", "wx", "wy", *BOX), "fills")
    got = fills.groupBy("wx", "wy").agg((F.count(F.lit(1)) * one).alias("new"))
    out = state.join(got, ["wx", "wy"], "left").withColumn("after", F.col("before") + F.coalesce("new", F.lit(0)))
    ok = (F.col("after") >= F.lit(low) * F.col("size")) & (F.col("after") <= F.lit(high) * F.col("size"))
    return fills, out.select("wx", "wy", "before", "after", F.when(ok, "Converged").otherwise("Infeasible").alias("status"))


def with_fill(rects: DataFrame, fills: DataFrame, layer: int, first_id: int) -> DataFrame:
    """The layer's boxes and its fills as one table; fills are numbered from ``first_id``."""
    return rects.select("id", "layer", *BOX).unionByName(fills.select((F.col("id") + first_id).alias("id"), F.lit(layer).alias("layer"), *BOX))


def recheck(rects: DataFrame, fills: DataFrame, layer: int, window: int, low: float, high: float) -> DataFrame:
    """Windows of the filled layer whose density is still below ``low`` or above ``high``."""
    top = (rects.agg(F.max("id")).first()[0] or 0) + 1
    return density(with_fill(rects, fills, layer, top), window, round(low * 1e6), round(high * 1e6))


def scoped_density(rects: DataFrame, region: DataFrame, exclusion: DataFrame | None, window: int, step: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Sliding windows over ``region`` less ``exclusion`` (boxes ``id, box``): the exact share of each window's scope that the boxes cover, in ppm.

    Windows start at the region's lower-left corner, every ``step``, and are cut
    at its box; one without any scope has no row.
    """
    spark = rects.sparkSession
    r = region.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    if r["x0"] is None:
        return density(rects.limit(0), window, 0)
    nx, ny = max(-(-(r["x1"] - r["x0"] - window) // step) + 1, 1), max(-(-(r["y1"] - r["y0"] - window) // step) + 1, 1)
    w = spark.range(nx * ny).select("id", (F.lit(r["x0"]) + F.col("id") % nx * step).alias("x0"), (F.lit(r["y0"]) + F.expr(f"id div {nx}") * step).alias("y0"))
    w = w.withColumns({"x1": F.least(F.col("x0") + window, F.lit(r["x1"])), "y1": F.least(F.col("y0") + window, F.lit(r["y1"]))})

    def cut(t: DataFrame) -> DataFrame:
        hit = candidates(w, t.select("id", *BOX)).where("a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1")
        return hit.select(F.col("a_id").alias("grp"), *[F.greatest(f"a_{c}", f"b_{c}").alias(c) for c in ("x0", "y0")], *[F.least(f"a_{c}", f"b_{c}").alias(c) for c in ("x1", "y1")])

    none = cut(region).limit(0)
    scope = staged(boolean(cut(region), cut(exclusion) if exclusion is not None else none, "subtraction"), "scope")
    share = areas(boolean(cut(rects), scope, "intersection")).withColumnsRenamed({"grp": "g", "area": "covered"})
    d = areas(scope).join(share, F.col("grp") == F.col("g"), "left").join(w, F.col("grp") == F.col("id"))
    layer = rects.select("layer").head(1)
    d = d.withColumn("ppm", F.expr("coalesce(covered, 0) * 1000000 div area")).withColumn("layer", F.lit(layer[0][0] if layer else 0))
    parts = []
    if low is not None:
        parts.append(violations(d.where(F.col("ppm") < round(low * 1e6)), "min_density", round(low * 1e6), F.col("ppm"), "x0", "y0"))
    if high is not None:
        parts.append(violations(d.where(F.col("ppm") > round(high * 1e6)), "max_density", round(high * 1e6), F.col("ppm"), "x0", "y0"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

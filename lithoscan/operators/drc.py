"""Design rules over axis-aligned rectangles ``(id, layer, x0, y0, x1, y1)`` and ring edges.

Every rule is one lazy DataFrame of ``rule_id, kind, layer, measured, limit, x,
y``. Distances are compared squared and as longs; a distance of 0 is contact and
never a violation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .graph import labelled
from .spatial import candidates, distance2, gap, isqrt, overlap, tiled, touching

COLUMNS = ["rule_id", "kind", "layer", "measured", "limit", "x", "y"]


def violations(found: DataFrame, kind: str | Column, limit: int | Column, measured: Column, x: Column | str, y: Column | str, layer: Column | str = "layer", rule_id: str | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return found.select(
        (F.lit(rule_id) if rule_id else kind).alias("rule_id"),
        kind.alias("kind"),
        (F.col(layer) if isinstance(layer, str) else layer).cast("string").alias("layer"),
        measured.cast("long").alias("measured"),
        (F.lit(limit) if isinstance(limit, int) else limit).cast("long").alias("limit"),
        (F.col(x) if isinstance(x, str) else x).cast("long").alias("x"),
        (F.col(y) if isinstance(y, str) else y).cast("long").alias("y"),
    )


def report(parts: list[DataFrame]) -> DataFrame:
    """All findings once: equal rows of several rules' parts are one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()


# --- vertices and edges -------------------------------------------------------


def off_grid(vertices: DataFrame, grid: int) -> DataFrame:
    """Vertices ``(id, layer, x, y)`` that lie off the grid; measured is x where x is off, else y."""
    bad = vertices.where((F.col("x") % grid != 0) | (F.col("y") % grid != 0))
    return violations(bad, "off_grid", grid, F.when(F.col("x") % grid != 0, F.col("x")).otherwise(F.col("y")), "x", "y")


def angle(edges: DataFrame, allowed: list[float], tolerance: float = 0.5) -> DataFrame:
    """Edges whose direction, modulo 180 degrees, is within ``tolerance`` of no allowed angle."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    turn = F.pmod(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))), F.lit(180.0))
    near = F.lit(False)
    for a in allowed:
        d = F.abs(turn - F.lit(float(a) % 180))
        near = near | (F.least(d, 180 - d) <= tolerance)
    return violations(edges.where(((dx != 0) | (dy != 0)) & ~near), "angle", 0, F.lit(-1), "x0", "y0")


def min_edge_length(edges: DataFrame, least: int) -> DataFrame:
    d2 = (F.col("x1") - F.col("x0")).cast("long") ** 2 + (F.col("y1") - F.col("y0")).cast("long") ** 2
    d2 = d2.cast("long")
    return violations(edges.where((d2 > 0) & (d2 < least * least)), "min_edge_length", least, isqrt(d2), "x0", "y0")


# --- one box -------------------------------------------------------------------


def _narrow() -> Column:
    return F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))


def min_width_rect(rects: DataFrame, least: int) -> DataFrame:
    return violations(rects.where(_narrow() < least), "min_width", least, _narrow(), "x0", "y0")


def max_width(rects: DataFrame, most: int) -> DataFrame:
    return violations(rects.where(_narrow() > most), "max_width", most, _narrow(), "x0", "y0")


def area() -> Column:
    return (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))


def cheesing(rects: DataFrame, most: int) -> DataFrame:
    """Boxes larger than ``most`` without a hole; boxes have none."""
    return violations(rects.where(area() > most), "cheesing", most, area(), "x0", "y0")


def merge_groups(rects: DataFrame) -> DataFrame:
    """``rects`` with ``grp``: the smallest id of those on the layer that it touches, directly or not."""
    return labelled(rects, touching(rects))


def union_areas(rects: DataFrame, by: str = "grp") -> DataFrame:
    """Exact area of the union of boxes for each value of ``by``: slabs between successive x, and covered y within each.

    Boxes are first cut at the borders of tiles of about sixteen boxes' size, so
    slabs are local and the work is by (group, tile): a chip-wide group is many
    tasks' work. A slab's boxes are merged by a running maximum over their lower ends.
    """
    from pyspark.sql import Window as W

    cut = tiled(rects.select(by, "x0", "y0", "x1", "y1"))
    keys = [by, "tx", "ty"]
    xs = cut.select(*keys, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slabs = xs.withColumn("nx", F.lead("x").over(W.partitionBy(*keys).orderBy("x"))).where("nx is not null").withColumnsRenamed({k: f"__{k}" for k in keys})
    # slabs of the same group and tile only; a box meets each slab between its own sides
    same = (F.col(by) == F.col(f"__{by}")) & (F.col("tx") == F.col("__tx")) & (F.col("ty") == F.col("__ty"))
    pieces = cut.join(slabs, same & (F.col("x0") <= F.col("x")) & (F.col("nx") <= F.col("x1"))).select(*keys, "x", "nx", "y0", "y1")
    w = W.partitionBy(*keys, "x").orderBy("y0", "y1").rowsBetween(W.unboundedPreceding, -1)
    covered = pieces.withColumn("top", F.coalesce(F.max("y1").over(w), F.col("y0")))
    new = F.greatest(F.col("y1") - F.greatest("y0", "top"), F.lit(0)).cast("long") * (F.col("nx") - F.col("x"))
    return covered.groupBy(by).agg(F.sum(new).cast("long").alias("area"))


def min_area(rects: DataFrame, least: int) -> DataFrame:
    """Merged shapes whose union is below ``least``, at their lowest-left corner."""
    groups = merge_groups(rects)
    low = groups.groupBy("grp", "layer").agg(F.min(F.struct("x0", "y0")).alias("p"))
    bad = union_areas(groups).where(F.col("area") < least).join(low, "grp")
    return violations(bad, "min_area", least, F.col("area"), F.col("p.x0"), F.col("p.y0"))


# --- two boxes -----------------------------------------------------------------


def min_spacing_pairs(rects: DataFrame, least: int) -> DataFrame:
    """Pairs on one layer nearer than ``least`` and not in contact, with d2 and the boxes."""
    d2 = distance2()
    return candidates(rects, None, least, ["layer"]).withColumn("d2", d2).where((F.col("d2") > 0) & (F.col("d2") < least * least))


def min_spacing(rects: DataFrame, least: int, strict: bool = False) -> DataFrame:
    """Spacing with merged shapes: a pair of one merged shape is a ``notch`` (unless ``strict``), and none where one box covers the gap."""
    pairs = min_spacing_pairs(rects, least)
    groups = merge_groups(rects).select(F.col("id").alias("gid"), "grp")
    ga, gb = groups.withColumnsRenamed({"gid": "ida", "grp": "ga"}), groups.withColumnsRenamed({"gid": "idb", "grp": "gb"})
    both = pairs.join(ga, F.col("a_id") == F.col("ida")).join(gb, F.col("b_id") == F.col("idb"))
    both = both.withColumn("same", F.col("ga") == F.col("gb"))
    side = lambda ax: (
        F.when(gap(ax) > 0, F.least(f"a_{ax}1", f"b_{ax}1")).otherwise(F.greatest(f"a_{ax}0", f"b_{ax}0")),
        F.when(gap(ax) > 0, F.greatest(f"a_{ax}0", f"b_{ax}0")).otherwise(F.least(f"a_{ax}1", f"b_{ax}1")),
    )
    (gx0, gx1), (gy0, gy1) = side("x"), side("y")
    own = both.where("same").select(F.xxhash64("a_id", "b_id").alias("id"), F.col("a_layer").alias("layer"), F.col("a_id").alias("pa"), F.col("b_id").alias("pb"), gx0.alias("x0"), gy0.alias("y0"), gx1.alias("x1"), gy1.alias("y1"))
    hosts = candidates(own, rects, 0, ["layer"])
    covered = hosts.where("b_x0 <= a_x0 and b_x1 >= a_x1 and b_y0 <= a_y0 and b_y1 >= a_y1 and b_id <> a_pa and b_id <> a_pb").select(F.col("a_pa").alias("ca"), F.col("a_pb").alias("cb")).distinct()
    open_ = both.join(covered, (F.col("a_id") == F.col("ca")) & (F.col("b_id") == F.col("cb")), "left_anti")
    kind = F.when(F.col("same") & F.lit(not strict), "notch").otherwise("min_spacing")
    return violations(open_, kind, least, isqrt(F.col("d2")), "a_x1", "a_y0", "a_layer", "min_spacing")


def min_spacing_diff(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Boxes of two layers nearer than ``least``; contact and containment don't count."""
    found = candidates(a, b, least).withColumn("d2", distance2()).where((F.col("d2") > 0) & (F.col("d2") < least * least))
    return violations(found, "min_spacing_diff", least, isqrt(F.col("d2")), "a_x1", "a_y0", F.concat_ws(":", "a_layer", "b_layer"))


def corner_to_corner(rects: DataFrame, least: int) -> DataFrame:
    """Pairs of different merged shapes that share no span on either axis and whose nearest corners are nearer than ``least``; marked at a's."""
    found = candidates(rects, None, least, ["layer"]).where((overlap("x") <= 0) & (overlap("y") <= 0)).withColumn("d2", distance2()).where((F.col("d2") > 0) & (F.col("d2") < least * least))
    x = F.when(F.col("a_x1") <= F.col("b_x0"), F.col("a_x1")).otherwise(F.col("a_x0"))
    y = F.when(F.col("a_y1") <= F.col("b_y0"), F.col("a_y1")).otherwise(F.col("a_y0"))
    return violations(_of_different_shapes(found, rects), "corner_to_corner", least, isqrt(F.col("d2")), x, y, "a_layer")


def _of_different_shapes(pairs: DataFrame, rects: DataFrame) -> DataFrame:
    """``pairs`` (a_*, b_*) without those whose boxes are parts of one merged shape."""
    pairs = staged(pairs, "pairs")
    groups = staged(merge_groups(rects).select(F.col("id").alias("gid"), "grp"), "groups")
    ga, gb = groups.withColumnsRenamed({"gid": "ida", "grp": "ga"}), groups.withColumnsRenamed({"gid": "idb", "grp": "gb"})
    return pairs.join(ga, F.col("a_id") == F.col("ida")).join(gb, F.col("b_id") == F.col("idb")).where("ga <> gb").select(*pairs.columns)


def prl_spacing(rects: DataFrame, threshold: int, spacing: int) -> DataFrame:
    """Pairs that face each other over at least ``threshold`` and are nearer than ``spacing``."""
    run = F.greatest(overlap("x"), overlap("y"))
    found = candidates(rects, None, spacing, ["layer"]).withColumn("d2", distance2()).where((F.col("d2") > 0) & (F.col("d2") < spacing * spacing) & (run >= threshold))
    return violations(found, "prl_spacing", spacing, isqrt(F.col("d2")), "a_x1", "a_y0", "a_layer")


def wide_spacing(rects: DataFrame, width: int, spacing: int) -> DataFrame:
    """Pairs nearer than ``spacing`` of which one is at least ``width`` wide."""
    wide = lambda s: F.least(F.col(f"{s}_x1") - F.col(f"{s}_x0"), F.col(f"{s}_y1") - F.col(f"{s}_y0")) >= width
    found = candidates(rects, None, spacing, ["layer"]).withColumn("d2", distance2()).where((F.col("d2") > 0) & (F.col("d2") < spacing * spacing) & (wide("a") | wide("b")))
    return violations(found, "wide_dependent_spacing", spacing, isqrt(F.col("d2")), "a_x1", "a_y0", "a_layer")


def _box_edges(side: str) -> list[dict[str, Column]]:
    """The edges of the box ``<side>_*`` counter-clockwise from its lower-left corner, as boxes, with start and outward direction."""
    x0, y0, x1, y1 = (F.col(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1"))
    box = lambda a, b, c, d, sx, sy, nx, ny: {"x0": a, "y0": b, "x1": c, "y1": d, "sx": sx, "sy": sy, "nx": nx, "ny": ny}
    return [box(x0, y0, x1, y0, x0, y0, 0, -1), box(x1, y0, x1, y1, x1, y0, 1, 0), box(x0, y1, x1, y1, x1, y1, 0, 1), box(x0, y0, x0, y1, x0, y1, -1, 0)]


def _zone_hit(end: str, other: str, width: int, spacing: int) -> Column:
    """The nearest ``struct(d2, k, x, y)`` of an edge of ``other`` in the zone before a short edge of ``end``, marked at the short edge's start; null without one."""
    hits = []
    for i, e in enumerate(_box_edges(end)):
        length = e["x1"] - e["x0"] + e["y1"] - e["y0"]
        zone = {"x0": e["x0"] + min(e["nx"], 0) * spacing, "x1": e["x1"] + max(e["nx"], 0) * spacing, "y0": e["y0"] + min(e["ny"], 0) * spacing, "y1": e["y1"] + max(e["ny"], 0) * spacing}
        for j, o in enumerate(_box_edges(other)):
            meets = (zone["x0"] <= o["x1"]) & (o["x0"] <= zone["x1"]) & (zone["y0"] <= o["y1"]) & (o["y0"] <= zone["y1"])
            gx = F.greatest(e["x0"] - o["x1"], o["x0"] - e["x1"], F.lit(0)).cast("long")
            gy = F.greatest(e["y0"] - o["y1"], o["y0"] - e["y1"], F.lit(0)).cast("long")
            d2 = gx * gx + gy * gy
            ok = (length > 0) & (length < width) & meets & (d2 > 0) & (d2 < spacing * spacing)
            hits.append(F.when(ok, F.struct(d2.alias("d2"), F.lit(4 * i + j).alias("k"), e["sx"].cast("long").alias("x"), e["sy"].cast("long").alias("y"))))
    return F.array_min(F.array_compact(F.array(*hits)))


def eol_spacing(rects: DataFrame, width: int, spacing: int) -> DataFrame:
    """Pairs of different merged shapes of which an edge shorter than ``width`` has an edge of the other in the zone of ``spacing`` before it.

    One row a pair: the nearest such edge of the first box, or else of the second one; measured is the distance of
    the two edges, the mark is where the short one starts, counter-clockwise.
    """
    found = candidates(rects, None, spacing, ["layer"]).withColumn("d2", distance2()).where((F.col("d2") > 0) & (F.col("d2") < spacing * spacing))
    found = found.withColumn("hit", F.coalesce(_zone_hit("a", "b", width, spacing), _zone_hit("b", "a", width, spacing))).where("hit is not null")
    return violations(_of_different_shapes(found, rects), "eol_spacing", spacing, isqrt(F.col("hit.d2")), F.col("hit.x"), F.col("hit.y"), "a_layer")


def _inset(side: str) -> Column:
    return {"l": F.col("a_x0") - F.col("b_x0"), "r": F.col("b_x1") - F.col("a_x1"), "b": F.col("a_y0") - F.col("b_y0"), "t": F.col("b_y1") - F.col("a_y1")}[side]


def min_enclosure(inner: DataFrame, outer: DataFrame, least: int) -> DataFrame:
    """Inner boxes whose best host leaves less than ``least`` around them; without a host that has them strictly inside, 0."""
    inset = F.least(*[_inset(s) for s in "lrbt"])
    best = candidates(inner, outer).where(inset > 0).groupBy(F.col("a_id").alias("hid")).agg(F.max(inset).alias("best"))
    found = inner.join(best, F.col("id") == F.col("hid"), "left").withColumn("best", F.coalesce("best", F.lit(0))).where(F.col("best") < least)
    return violations(found, "min_enclosure", least, F.col("best"), "x0", "y0")


def asymmetric_enclosure(inner: DataFrame, outer: DataFrame, least: int) -> DataFrame:
    """Inner boxes without a host that has them strictly inside and leaves ``least`` on one side of each axis; measured is the best host's lesser of both."""
    both = F.least(F.greatest(_inset("l"), _inset("r")), F.greatest(_inset("b"), _inset("t")))
    inside = F.least(*[_inset(s) for s in "lrbt"]) > 0
    best = candidates(inner, outer).where(inside).groupBy(F.col("a_id").alias("hid")).agg(F.max(both).alias("best"))
    found = inner.join(best, F.col("id") == F.col("hid"), "left").withColumn("best", F.coalesce("best", F.lit(0))).where(F.col("best") < least)
    return violations(found, "asymmetric_enclosure", least, F.col("best"), "x0", "y0")


def min_extension(a: DataFrame, ref: DataFrame, least: int) -> DataFrame:
    """How far a box that crosses another one reaches beyond it, one row for each side below ``least``: bottom and top of boxes at least as tall as wide, else left and right.

    Marked at the box's left or lower side, on the side of the other box that it is measured from.
    """
    tall = (F.col("a_y1") - F.col("a_y0")) >= (F.col("a_x1") - F.col("a_x0"))
    side = lambda past, x, y: F.struct(past.cast("long").alias("past"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    ax, ay, bx0, by0, bx1, by1 = (F.col(c) for c in ("a_x0", "a_y0", "b_x0", "b_y0", "b_x1", "b_y1"))
    upright = F.array(side(by0 - ay, ax, by0), side(F.col("a_y1") - by1, ax, by1))
    flat = F.array(side(bx0 - ax, bx0, ay), side(F.col("a_x1") - bx1, bx1, ay))
    sides = candidates(a, ref).select("a_layer", F.explode(F.when(tall, upright).otherwise(flat)).alias("s")).where(F.col("s.past") < least)
    return violations(sides, "min_extension", least, F.col("s.past"), F.col("s.x"), F.col("s.y"), "a_layer")


def overlap_rect(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Boxes of a whose best overlap with the union of b is narrower than ``least`` both ways taken.

    The parts of a box that b covers are merged where they share an edge or an
    area; the best of those counts, and a box that b doesn't cover at all has 0.
    A merged part that isn't a box can't be measured: ``overlap_geometry_error``, -1.
    """
    low, high = (lambda c: F.greatest(f"a_{c}", f"b_{c}").alias(c)), (lambda c: F.least(f"a_{c}", f"b_{c}").alias(c))
    cut = candidates(a, b).where((overlap("x") > 0) & (overlap("y") > 0))
    cut = cut.select(F.xxhash64("a_id", "b_id").alias("id"), F.col("a_id").alias("own"), low("x0"), low("y0"), high("x1"), high("y1"))
    cut = staged(cut, "overlaps")
    met = candidates(cut, None, 0, ["own"]).where((F.greatest(overlap("x"), overlap("y")) > 0)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    parts = staged(labelled(cut, met), "overlap-parts")
    whole = parts.groupBy("grp").agg(F.first("own").alias("own"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1")]).join(union_areas(parts), "grp")
    best = whole.groupBy(F.col("own").alias("hid")).agg(F.max(_narrow()).alias("best"), F.bool_or(F.col("area") != area()).alias("odd"))
    found = a.join(best, F.col("id") == F.col("hid"), "left").withColumn("best", F.when(F.col("odd"), -1).otherwise(F.coalesce("best", F.lit(0)))).where(F.col("best") < least)
    name = F.concat(F.col("layer").cast("string"), F.lit(":"), F.lit(_layer_name(b)))
    return violations(found, F.when(F.col("odd"), "overlap_geometry_error").otherwise("overlap"), least, F.col("best"), "x0", "y0", name, "overlap")


def _layer_name(t: DataFrame) -> str:
    """The layer of a table of one layer; empty where it has no row."""
    first = t.select(F.col("layer").cast("string").alias("layer")).head(1)
    return first[0]["layer"] if first else ""


def _centred(t: DataFrame) -> DataFrame:
    return t.select("id", "layer", F.expr("(x0 + x1) div 2").alias("cx"), F.expr("(y0 + y1) div 2").alias("cy"), F.col("x0").alias("bx0"), F.col("y0").alias("by0")).withColumns({"x0": F.col("cx"), "y0": F.col("cy"), "x1": F.col("cx"), "y1": F.col("cy")})


def redundant_via(vias: DataFrame, count: int, within: int) -> DataFrame:
    """Vias with fewer than ``count`` - 1 others whose centre is within ``within``; measured counts the via itself."""
    c = _centred(vias)
    near = candidates(c, None, within, ["layer"]).where(distance2() <= within * within).select(F.explode(F.array("a_id", "b_id")).alias("nid"))
    n = near.groupBy("nid").agg(F.count(F.lit(1)).alias("n"))
    found = c.join(n, F.col("id") == F.col("nid"), "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1).where(F.col("n") < count)
    return violations(found, "redundant_via", count, F.col("n"), "bx0", "by0")


def via_array(vias: DataFrame, threshold: int, spacing: int) -> DataFrame:
    """Groups of more than ``threshold`` vias linked by gaps up to ``spacing`` that have a pair below it: one row, at the first such pair."""
    pairs = candidates(vias, None, spacing, ["layer"]).withColumn("d2", distance2()).where((F.col("d2") > 0) & (F.col("d2") <= spacing * spacing))
    groups = labelled(vias, pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).select(F.col("id").alias("gid"), "grp")
    large = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)
    close = pairs.where(F.col("d2") < spacing * spacing).join(groups, F.col("a_id") == F.col("gid")).join(large, "grp")
    first = close.groupBy("grp").agg(F.min(F.struct("a_id", "b_id", "d2", "a_x0", "a_y0", "a_layer")).alias("m"))
    return violations(first, "via_array_spacing", spacing, isqrt(F.col("m.d2")), F.col("m.a_x0"), F.col("m.a_y0"), F.col("m.a_layer"))


def max_distance_to_tap(diffs: DataFrame, taps: DataFrame, most: int) -> DataFrame:
    """Boxes with a corner that has no tap's centre within ``most``: one row, at the first such corner of LL, LR, UR, UL."""
    corners = diffs.select(
        F.col("id").alias("did"), "layer",
        F.posexplode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])).alias("k", "p"),
    )
    corners = corners.select((F.col("did") * 4 + F.col("k")).alias("id"), "did", "layer", "k", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))
    near = candidates(corners, _centred(taps), most).where(distance2() <= most * most).select(F.col("a_id").alias("nid")).distinct()
    far = corners.join(near, F.col("id") == F.col("nid"), "left_anti")
    first = far.groupBy("did", "layer").agg(F.min(F.struct("k", "x0", "y0")).alias("m"))
    return violations(first, "max_distance_to_tap", most, F.lit(0), F.col("m.x0"), F.col("m.y0"))


# --- windows -------------------------------------------------------------------


def window_cover(rects: DataFrame, window: int, step: int) -> DataFrame:
    """``layer, wx, wy, x, y, covered``: box area in windows of side ``window`` every ``step`` from the layer's lower-left corner.

    Overlaps count twice; the grid is whole, empty windows have 0. A box goes to
    the windows that it meets, so the work is by window.
    """
    box = rects.groupBy("layer").agg(F.min("x0").alias("lx"), F.min("y0").alias("ly"), F.max("x1").alias("hx"), F.max("y1").alias("hy"))
    # one row per layer, so it can be broadcast
    t = rects.join(F.broadcast(box), "layer")
    first = lambda lo, base: F.greatest(F.floor((F.col(lo) - F.col(base) - window) / step) + 1, F.lit(0)).cast("long")
    last = lambda hi, base: F.greatest(F.ceil((F.col(hi) - F.col(base)) / step) - 1, F.lit(0)).cast("long")
    n = lambda hi, lo: F.greatest(F.ceil((F.col(hi) - F.col(lo)) / step), F.lit(1)).cast("long")
    t = t.withColumns({"nx": n("hx", "lx"), "ny": n("hy", "ly")})
    t = t.withColumn("wx", F.explode(F.sequence(first("x0", "lx"), F.least(last("x1", "lx"), F.col("nx") - 1))))
    t = t.withColumn("wy", F.explode(F.sequence(first("y0", "ly"), F.least(last("y1", "ly"), F.col("ny") - 1))))
    ax = F.least(F.col("x1"), F.col("lx") + F.col("wx") * step + window) - F.greatest(F.col("x0"), F.col("lx") + F.col("wx") * step)
    ay = F.least(F.col("y1"), F.col("ly") + F.col("wy") * step + window) - F.greatest(F.col("y0"), F.col("ly") + F.col("wy") * step)
    cover = t.groupBy("layer", "wx", "wy").agg(F.sum(F.greatest(ax, F.lit(0)).cast("long") * F.greatest(ay, F.lit(0))).cast("long").alias("covered"))
    grid = box.withColumns({"nx": n("hx", "lx"), "ny": n("hy", "ly")}).withColumn("wx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("wy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    grid = grid.select("layer", "wx", "wy", (F.col("lx") + F.col("wx") * step).alias("x"), (F.col("ly") + F.col("wy") * step).alias("y"))
    return grid.join(cover, ["layer", "wx", "wy"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def ppm(window: int) -> Column:
    return F.expr(f"covered * 1000000 div {window * window}")


def density(rects: DataFrame, window: int, low: int | None = None, high: int | None = None, step: int | None = None) -> DataFrame:
    """Windows whose density, in parts per million, is below ``low`` or above ``high``."""
    d = window_cover(rects, window, step or window).withColumn("ppm", ppm(window))
    parts = []
    if low is not None:
        parts.append(violations(d.where(F.col("ppm") < low), "min_density", low, F.col("ppm"), "x", "y"))
    if high is not None:
        parts.append(violations(d.where(F.col("ppm") > high), "max_density", high, F.col("ppm"), "x", "y"))
    return report(parts)


def density_gradient(rects: DataFrame, window: int, most: int) -> DataFrame:
    """Neighbouring windows, to the right and above, whose densities differ by more than ``most`` ppm."""
    d = window_cover(rects, window, window).withColumn("ppm", ppm(window)).select("layer", "wx", "wy", "x", "y", "ppm")
    near = d.select("layer", F.col("ppm").alias("other"), F.explode(F.array(F.struct((F.col("wx") - 1).alias("wx"), F.col("wy").alias("wy"), F.lit("x").alias("ax")), F.struct(F.col("wx").alias("wx"), (F.col("wy") - 1).alias("wy"), F.lit("y").alias("ax")))).alias("p"))
    both = d.join(near.select("layer", F.col("p.wx").alias("wx"), F.col("p.wy").alias("wy"), "other"), ["layer", "wx", "wy"])
    diff = F.abs(F.col("ppm") - F.col("other"))
    return violations(both.where(diff > most), "density_gradient", most, diff, "x", "y")


def cmp_thickness(rects: DataFrame, window: int, base: int, slope_ppm: int) -> DataFrame:
    """``layer, x, y, thickness``: a linear polishing model of each window's density."""
    d = window_cover(rects, window, window).withColumn("ppm", ppm(window))
    return d.select("layer", "x", "y", (F.lit(base) + F.expr(f"ppm * {slope_ppm} div 1000000")).cast("long").alias("thickness"))

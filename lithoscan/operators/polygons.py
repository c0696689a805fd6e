"""Design rules over polygons of any shape, by their edges.

``edges(id, layer, ei, x0, y0, x1, y1)``: a ring's edges, numbered, from each
vertex to the next. Distances of polygons are the least of their edges', found
by the spatial bins, so the work is by near edges, never by pairs of whole rings.
Coordinates must span less than 2^30: products then fit longs and squares of
them decimals; :func:`validity` reports what doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.stage import staged
from .drc import violations
from .graph import labelled
from .spatial import candidates, isqrt, overlap

#: Widest span of coordinates that the rules' arithmetic holds.
MOST_SPAN = 1 << 30


def _div(a: Column, b: Column | int) -> Column:
    """Whole division that drops the fraction."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def edges_of(polygons: DataFrame) -> DataFrame:
    """Edges of ``polygons(id, layer, ring array<struct<x, y>>)``, without those of no length."""
    n = F.size("ring")
    at = lambda k, c: F.get("ring", k)[c].cast("long")
    e = polygons.where("size(ring) > 0").select("id", "layer", "ring", F.explode(F.sequence(F.lit(0), n - 1)).alias("ei"))
    after = (F.col("ei") + 1) % n
    e = e.select("id", "layer", "ei", at(F.col("ei"), "x").alias("x0"), at(F.col("ei"), "y").alias("y0"), at(after, "x").alias("x1"), at(after, "y").alias("y1"))
    return e.where("x0 <> x1 or y0 <> y1")


def boxes_of(edges: DataFrame) -> DataFrame:
    """``id, layer, x0, y0, x1, y1, edges, is_box, area, sx, sy``: each ring's bounding box, whether it is that box, its area and its first vertex."""
    twice = F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")))
    low, high = (lambda c: F.min(F.least(f"{c}0", f"{c}1"))), (lambda c: F.max(F.greatest(f"{c}0", f"{c}1")))
    upright = F.bool_and((F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1")))
    by = edges.groupBy("id", "layer").agg(
        low("x").alias("bx0"), low("y").alias("by0"), high("x").alias("bx1"), high("y").alias("by1"), F.count(F.lit(1)).alias("edges"), upright.alias("upright"),
        _div(twice, 2).cast("long").alias("area"), F.min_by(F.struct("x0", "y0"), "ei").alias("first"),
    )
    return by.select(
        "id", "layer", F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"), "edges",
        ((F.col("edges") == 4) & F.col("upright")).alias("is_box"), "area", F.col("first.x0").alias("sx"), F.col("first.y0").alias("sy"),
    )


def _as_boxes(edges: DataFrame) -> DataFrame:
    """Edges as boxes with their ring in ``poly``, their number as ``id``, and start and end."""
    return edges.select(
        F.col("id").alias("poly"), F.col("ei").alias("id"), "layer", F.col("x0").cast("long").alias("sx"), F.col("y0").cast("long").alias("sy"), F.col("x1").cast("long").alias("ex"), F.col("y1").cast("long").alias("ey"),
        *[f(f"{c}0", f"{c}1").cast("long").alias(f"{c}{k}") for k, f in ((0, F.least), (1, F.greatest)) for c in "xy"],
    )


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _point_d2(px: Column, py: Column, side: str) -> Column:
    """Squared distance of a point and the segment ``<side>``; that of the foot on it without its fraction."""
    sx, sy, ex, ey = (F.col(f"{side}_{c}") for c in ("sx", "sy", "ex", "ey"))
    vx, vy, wx, wy = ex - sx, ey - sy, px - sx, py - sy
    along, length2, cross = vx * wx + vy * wy, vx * vx + vy * vy, (vx * wy - vy * wx).cast("decimal(19,0)")
    at_end = (px - ex) * (px - ex) + (py - ey) * (py - ey)
    return F.when(along <= 0, wx * wx + wy * wy).when(length2 <= along, at_end).otherwise(_div(cross * cross, length2).cast("long"))


def segment_d2() -> Column:
    """Squared distance of the segments ``a_*`` and ``b_*``, 0 where they meet."""
    a, b = ([F.col(f"{s}_{c}") for c in ("sx", "sy", "ex", "ey")] for s in "ab")
    gx = F.greatest(F.col("a_x0") - F.col("b_x1"), F.col("b_x0") - F.col("a_x1"), F.lit(0))
    gy = F.greatest(F.col("a_y0") - F.col("b_y1"), F.col("b_y0") - F.col("a_y1"), F.lit(0))
    straight = lambda s: (F.col(f"{s}_sx") == F.col(f"{s}_ex")) | (F.col(f"{s}_sy") == F.col(f"{s}_ey"))
    across = lambda p, q: _turn(*p, q[0], q[1]) * _turn(*p, q[2], q[3]) <= 0
    meet = (gx == 0) & (gy == 0) & across(a, b) & across(b, a)
    ends = F.least(_point_d2(a[0], a[1], "b"), _point_d2(a[2], a[3], "b"), _point_d2(b[0], b[1], "a"), _point_d2(b[2], b[3], "a"))
    return F.when(straight("a") & straight("b"), gx * gx + gy * gy).when(meet, F.lit(0)).otherwise(ends).cast("long")


def distances(a: DataFrame, b: DataFrame | None, cutoff: int, on: tuple[str, ...] = ("layer",)) -> DataFrame:
    """``a, b, d2``: pairs of rings with edges within ``cutoff`` of each other per axis, and their least squared distance.

    Without ``b``, pairs of ``a`` with a < b. Pairs farther off have no row.
    """
    left = _as_boxes(a)
    right = left if b is None else _as_boxes(b)
    near = candidates(left, right, cutoff, on if b is None else ())
    near = near.where("a_poly < b_poly") if b is None else near
    return near.groupBy(F.col("a_poly").alias("a"), F.col("b_poly").alias("b")).agg(F.min(segment_d2()).alias("d2"))


def merged(edges: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """``id, grp``: the smallest id of the rings of one layer whose boundaries meet, directly or not. ``near``: distances that are there already."""
    near = distances(edges, None, 0) if near is None else near
    ids = edges.select("id").distinct()
    return labelled(ids, near.where("d2 = 0").select("a", "b"))


def inside(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``points(poly, x, y)`` with ``inside``: strictly within the ring ``poly``, by the parity of the edges to the right.

    A point on the boundary isn't inside. Points meet the edges that their ray
    passes by the spatial bins.
    """
    ends = edges.groupBy(F.col("id").alias("ring")).agg(F.max(F.greatest("x0", "x1")).alias("far"))
    rays = points.select("poly", "x", "y").distinct().join(ends, F.col("poly") == F.col("ring"))
    rays = rays.select(F.xxhash64("poly", "x", "y").alias("id"), "poly", F.col("x").cast("long").alias("x0"), F.col("y").cast("long").alias("y0"), F.greatest("x", "far").cast("long").alias("x1"), F.col("y").cast("long").alias("y1"))
    met = candidates(staged(rays, "rays"), _as_boxes(edges), 0, ["poly"])
    px, py, sx, sy, ex, ey = (F.col(c) for c in ("a_x0", "a_y0", "b_sx", "b_sy", "b_ex", "b_ey"))
    turn = (ex - sx) * (py - sy) - (px - sx) * (ey - sy)
    right = ((sy > py) != (ey > py)) & F.when(ey > sy, turn > 0).otherwise(turn < 0)
    on = (turn == 0) & px.between(F.col("b_x0"), F.col("b_x1")) & py.between(F.col("b_y0"), F.col("b_y1"))
    by = met.groupBy(F.col("a_poly").alias("p"), px.alias("qx"), py.alias("qy")).agg((F.count_if(right) % 2 == 1).alias("odd"), F.bool_or(on).alias("on"))
    met_at = (F.col("poly") == F.col("p")) & (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy"))
    return points.join(by, met_at, "left").withColumn("inside", F.coalesce(F.col("odd") & ~F.col("on"), F.lit(False))).drop("p", "qx", "qy", "odd", "on")


def contained(inner: DataFrame, outer: DataFrame, near: DataFrame, same: bool = False) -> DataFrame:
    """``a, b``: rings of ``inner`` that lie strictly inside one of ``outer``.

    ``near``: :func:`distances` of both, with a cutoff of 0 at least: boundaries
    that meet rule a pair out, and then one vertex decides. ``same``: rings of
    one table, each layer by itself.
    """
    boxes = lambda e: boxes_of(e).select("id", "layer", "x0", "y0", "x1", "y1", "sx", "sy")
    pairs = candidates(boxes(inner), boxes(outer), 0, ("layer",) if same else ())
    pairs = pairs.where("b_x0 < a_x0 and b_y0 < a_y0 and a_x1 < b_x1 and a_y1 < b_y1")
    meet = near.where("d2 = 0").select(F.col("a").alias("ma"), F.col("b").alias("mb"))
    meet = meet.union(meet.select("mb", "ma")) if same else meet
    pairs = pairs.join(meet, (F.col("a_id") == F.col("ma")) & (F.col("b_id") == F.col("mb")), "left_anti")
    points = pairs.select(F.col("b_id").alias("poly"), F.col("a_sx").alias("x"), F.col("a_sy").alias("y"), F.col("a_id").alias("a"))
    return inside(staged(points, "contained"), outer).where("inside").select("a", F.col("poly").alias("b"))


def _pairs(edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``(near, found)``: the distances within ``least``, and the pairs nearer than it that don't meet, with both boxes as a_* and b_*."""
    near = staged(distances(edges, None, least), "distances")
    boxes = staged(boxes_of(edges), "ring-boxes")
    a, b = (boxes.select(*[F.col(c).alias(f"{s}_{c}") for c in boxes.columns]) for s in "ab")
    return near, near.where((F.col("d2") > 0) & (F.col("d2") < least * least)).join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))


def _without(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """``pairs`` without those that ``gone(a, b)`` has, either way round."""
    g = gone.select(F.least("a", "b").alias("wa"), F.greatest("a", "b").alias("wb"))
    return pairs.join(g, (F.col("a_id") == F.col("wa")) & (F.col("b_id") == F.col("wb")), "left_anti")


def _grouped(pairs: DataFrame, edges: DataFrame, near: DataFrame) -> DataFrame:
    groups = staged(merged(edges, near), "merged")
    ga, gb = groups.withColumnsRenamed({"id": "ida", "grp": "ga"}), groups.withColumnsRenamed({"id": "idb", "grp": "gb"})
    return pairs.join(ga, F.col("a_id") == F.col("ida")).join(gb, F.col("b_id") == F.col("idb")).withColumn("same", F.col("ga") == F.col("gb"))


def _gap_box() -> dict[str, Column]:
    """The region between two boxes: the facing band, or what lies between the nearest corners."""
    low = lambda ax: F.when(overlap(ax) > 0, F.greatest(f"a_{ax}0", f"b_{ax}0")).otherwise(F.least(f"a_{ax}1", f"b_{ax}1"))
    high = lambda ax: F.when(overlap(ax) > 0, F.least(f"a_{ax}1", f"b_{ax}1")).otherwise(F.greatest(f"a_{ax}0", f"b_{ax}0"))
    # boxes that overlap on both axes: the band is that of x, the gap in y
    both = (overlap("x") > 0) & (overlap("y") > 0)
    y0 = F.when(both, F.least("a_y1", "b_y1")).otherwise(low("y"))
    y1 = F.when(both, F.greatest("a_y0", "b_y0")).otherwise(high("y"))
    return {"x0": low("x"), "y0": y0, "x1": high("x"), "y1": y1}


def min_spacing(edges: DataFrame, least: int, strict: bool = False) -> DataFrame:
    """Rings of a layer nearer than ``least``: not in contact, neither inside the other; within one merged shape a ``notch`` (unless ``strict``), and none where another ring that is a box covers the gap."""
    near, pairs = _pairs(edges, least)
    pairs = staged(_grouped(_without(pairs, contained(edges, edges, near, True)), edges, near), "spacing")
    gaps = pairs.where("same").select(F.xxhash64("a_id", "b_id").alias("id"), F.col("a_layer").alias("layer"), F.col("a_id").alias("pa"), F.col("b_id").alias("pb"), *[v.alias(k) for k, v in _gap_box().items()])
    hosts = boxes_of(edges).where("edges = 4").select("id", "layer", "x0", "y0", "x1", "y1")
    # where both boxes overlap, the gap's sides come the wrong way round
    turned = {f"{ax}{k}": f(f"{ax}0", f"{ax}1") for k, f in ((0, F.least), (1, F.greatest)) for ax in "xy"}
    whole = gaps.select("id", "layer", "pa", "pb", *[F.col(c).alias(f"g{c}") for c in turned], *[v.alias(c) for c, v in turned.items()])
    covered = candidates(whole, hosts, 0, ["layer"]).where("b_x0 <= a_gx0 and b_x1 >= a_gx1 and b_y0 <= a_gy0 and b_y1 >= a_gy1 and b_id <> a_pa and b_id <> a_pb")
    pairs = _without(pairs, covered.select(F.col("a_pa").alias("a"), F.col("a_pb").alias("b")))
    kind = F.when(F.col("same") & F.lit(not strict), "notch").otherwise("min_spacing")
    return violations(pairs, kind, least, isqrt(F.col("d2")), "a_x1", "a_y0", "a_layer", "min_spacing")


def gap_fills(edges: DataFrame, least: int) -> DataFrame:
    """``layer, x0, y0, x1, y1``: boxes that close the open gaps below ``least`` within merged shapes, half of ``least`` wider on each side."""
    near, pairs = _pairs(edges, least)
    pairs = staged(_grouped(_without(pairs, contained(edges, edges, near, True)), edges, near).where("same"), "gaps")
    box = pairs.select("a_id", "b_id", F.col("a_layer").alias("layer"), *[v.cast("long").alias(k) for k, v in _gap_box().items()]).where("x1 > x0 and y1 > y0")
    own = box.select(F.xxhash64("a_id", "b_id").alias("id"), "layer", F.col("a_id").alias("pa"), F.col("b_id").alias("pb"), "x0", "y0", "x1", "y1")
    hosts = boxes_of(edges).where("edges = 4").select("id", "layer", "x0", "y0", "x1", "y1")
    solid = candidates(own, hosts, 0, ["layer"]).where("b_x0 <= a_x0 and b_x1 >= a_x1 and b_y0 <= a_y0 and b_y1 >= a_y1 and b_id <> a_pa and b_id <> a_pb").select(F.col("a_id").alias("solid")).distinct()
    half = least // 2
    left = own.join(solid, F.col("id") == F.col("solid"), "left_anti")
    return left.select("layer", (F.col("x0") - half).alias("x0"), (F.col("y0") - half).alias("y0"), (F.col("x1") + half).alias("x1"), (F.col("y1") + half).alias("y1"))


def min_spacing_diff(a: DataFrame, b: DataFrame, least: int) -> DataFrame:
    """Rings of two layers nearer than ``least``; contact and containment don't count."""
    near = staged(distances(a, b, least), "distances")
    boxes = lambda e, s: boxes_of(e).select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "layer", "x0", "y0", "x1", "y1")])
    pairs = near.where((F.col("d2") > 0) & (F.col("d2") < least * least)).join(boxes(a, "a"), F.col("a") == F.col("a_id")).join(boxes(b, "b"), F.col("b") == F.col("b_id"))
    held = contained(a, b, near).union(contained(b, a, near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d2")).select("b", "a"))
    held = held.select(F.col("a").alias("ha"), F.col("b").alias("hb"))
    pairs = pairs.join(held, (F.col("a_id") == F.col("ha")) & (F.col("b_id") == F.col("hb")), "left_anti")
    return violations(pairs, "min_spacing_diff", least, isqrt(F.col("d2")), "a_x1", "a_y0", F.concat_ws(":", "a_layer", "b_layer"))


def prl_spacing(edges: DataFrame, threshold: int, spacing: int) -> DataFrame:
    """Rings whose boxes face each other over at least ``threshold`` and that are nearer than ``spacing``."""
    _, pairs = _pairs(edges, spacing)
    run = F.when((overlap("x") > 0) & (overlap("y") < 0), overlap("x")).when((overlap("y") > 0) & (overlap("x") < 0), overlap("y"))
    return violations(pairs.where(run >= threshold), "prl_spacing", spacing, isqrt(F.col("d2")), "a_x1", "a_y0", "a_layer")


def wide_spacing(edges: DataFrame, width: int, spacing: int) -> DataFrame:
    """Rings nearer than ``spacing`` of which one's box is at least ``width`` wide; one inside the other doesn't count."""
    near, pairs = _pairs(edges, spacing)
    wide = lambda s: F.least(F.col(f"{s}_x1") - F.col(f"{s}_x0"), F.col(f"{s}_y1") - F.col(f"{s}_y0")) >= width
    pairs = _without(pairs.where(wide("a") | wide("b")), contained(edges, edges, near, True))
    return violations(pairs, "wide_dependent_spacing", spacing, isqrt(F.col("d2")), "a_x1", "a_y0", "a_layer")


def corner_to_corner(edges: DataFrame, least: int) -> DataFrame:
    """Rings of different merged shapes whose boxes share no span on either axis and that have vertices nearer than ``least``; marked at the nearest vertex of the first."""
    near, pairs = _pairs(edges, least)
    pairs = _grouped(pairs.where((overlap("x") <= 0) & (overlap("y") <= 0)), edges, near).where("not same").select("a", "b", "a_layer")
    points = edges.select(F.col("id").alias("poly"), "ei", F.col("x0").cast("long").alias("x"), F.col("y0").cast("long").alias("y"))
    pa, pb = (points.select(*[F.col(c).alias(f"{s}_{c}") for c in points.columns]) for s in "pq")
    d2 = (F.col("p_x") - F.col("q_x")) * (F.col("p_x") - F.col("q_x")) + (F.col("p_y") - F.col("q_y")) * (F.col("p_y") - F.col("q_y"))
    both = pairs.join(pa, F.col("a") == F.col("p_poly")).join(pb, F.col("b") == F.col("q_poly")).withColumn("v2", d2)
    first = both.groupBy("a", "b", "a_layer").agg(F.min(F.struct("v2", "p_ei", "q_ei", "p_x", "p_y")).alias("m")).where(F.col("m.v2") < least * least)
    return violations(first, "corner_to_corner", least, isqrt(F.col("m.v2")), F.col("m.p_x"), F.col("m.p_y"), "a_layer")


def eol_spacing(edges: DataFrame, width: int, spacing: int) -> DataFrame:
    """Rings of different merged shapes of which an axis-parallel edge shorter than ``width`` has an edge of the other in the zone of ``spacing`` before it.

    As :func:`lithoscan.operators.drc.eol_spacing`, by edges: one row a pair, the first ring's short edges first.
    """
    near, pairs = _pairs(edges, spacing)
    pairs = staged(_grouped(pairs, edges, near).where("not same").select("a", "b", F.col("a_layer").alias("layer")), "eol-pairs")
    ccw = edges.groupBy(F.col("id").alias("ring")).agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) > 0).alias("ccw"))
    e = _as_boxes(edges).join(ccw, F.col("poly") == F.col("ring")).drop("ring")
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    short = e.where(((dx == 0) | (dy == 0)) & (dx * dx + dy * dy < width * width))
    # outward: to the right of a counter-clockwise edge
    turn = F.when(F.col("ccw"), 1).otherwise(-1)
    nx, ny = turn * F.signum(dy), -turn * F.signum(dx)
    zone = {"x0": F.col("x0") + F.least(nx, F.lit(0)) * spacing, "y0": F.col("y0") + F.least(ny, F.lit(0)) * spacing, "x1": F.col("x1") + F.greatest(nx, F.lit(0)) * spacing, "y1": F.col("y1") + F.greatest(ny, F.lit(0)) * spacing}
    own = [*[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")]]
    zones = short.select("poly", "id", "layer", "sx", "sy", "ex", "ey", *own, *[v.cast("long").alias(k) for k, v in zone.items()])
    hit = candidates(zones, _as_boxes(edges), 0, ["layer"]).where("a_poly <> b_poly")
    hit = hit.withColumnsRenamed({f"a_{c}": f"z_{c}" for c in ("x0", "y0", "x1", "y1")}).withColumnsRenamed({f"a_o{c}": f"a_{c}" for c in ("x0", "y0", "x1", "y1")})
    hit = hit.withColumn("e2", segment_d2()).where((F.col("e2") > 0) & (F.col("e2") < spacing * spacing))
    p, q = F.least("a_poly", "b_poly"), F.greatest("a_poly", "b_poly")
    first = hit.groupBy(p.alias("p"), q.alias("q")).agg(F.min(F.struct((F.col("a_poly") > F.col("b_poly")).alias("second"), "e2", "a_id", "b_id", "a_sx", "a_sy")).alias("m"))
    found = pairs.join(first, (F.col("a") == F.col("p")) & (F.col("b") == F.col("q")))
    return violations(found, "eol_spacing", spacing, isqrt(F.col("m.e2")), F.col("m.a_sx"), F.col("m.a_sy"))


def min_enclosure(inner: DataFrame, outer: DataFrame, least: int) -> DataFrame:
    """Inner rings whose best host leaves less than ``least`` around them; without a host that has them strictly inside, 0."""
    near = staged(distances(inner, outer, least + 1, ()), "distances")
    held = contained(inner, outer, near).select(F.col("a").alias("ha"), F.col("b").alias("hb"))
    far = F.lit((least + 1) * (least + 1))  # boundaries that aren't near are at least so far off
    room = held.join(near, (F.col("ha") == F.col("a")) & (F.col("hb") == F.col("b")), "left").groupBy("ha").agg(F.max(isqrt(F.least(F.coalesce("d2", far), far))).alias("best"))
    found = boxes_of(inner).join(room, F.col("id") == F.col("ha"), "left").withColumn("best", F.coalesce("best", F.lit(0))).where(F.col("best") < least)
    return violations(found, "min_enclosure", least, F.col("best"), "x0", "y0")


def asymmetric_enclosure(inner: DataFrame, outer: DataFrame, least: int) -> DataFrame:
    """Inner rings without a host that has them strictly inside and leaves ``least`` on one side of each axis, by boxes; measured is the best host's lesser of both."""
    near = staged(distances(inner, outer, 0, ()), "distances")
    held = contained(inner, outer, near).select(F.col("a").alias("ha"), F.col("b").alias("hb"))
    boxes = lambda e, s: boxes_of(e).select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
    pairs = held.join(boxes(inner, "a"), F.col("ha") == F.col("a_id")).join(boxes(outer, "b"), F.col("hb") == F.col("b_id"))
    side = lambda ax: F.greatest(F.col(f"a_{ax}0") - F.col(f"b_{ax}0"), F.col(f"b_{ax}1") - F.col(f"a_{ax}1"))
    best = pairs.groupBy("ha").agg(F.max(F.least(side("x"), side("y"))).alias("best"))
    found = boxes_of(inner).join(best, F.col("id") == F.col("ha"), "left").withColumn("best", F.coalesce("best", F.lit(0))).where(F.col("best") < least)
    return violations(found, "asymmetric_enclosure", least, F.col("best"), "x0", "y0")


# --- one ring --------------------------------------------------------------------


def facing_gaps(edges: DataFrame, interior: bool, most: int) -> DataFrame:
    """Parallel edges of one ring with a common span, less than ``most`` apart: ``id, layer, gap, x, y`` at the middle of the gap.

    ``interior``: the middle, on whole coordinates, is strictly inside; else it
    isn't. So a gap of 1 counts as outside. Diagonal edges count like others.
    """
    near = staged(candidates(_as_boxes(edges), None, most, ["poly"]), "near-edges")
    c = {f"{s}{k}": F.col(f"{s}_{k}") for s in "ab" for k in ("sx", "sy", "ex", "ey", "x0", "y0", "x1", "y1")}
    lo, hi = (lambda ax: F.greatest(c[f"a{ax}0"], c[f"b{ax}0"])), (lambda ax: F.least(c[f"a{ax}1"], c[f"b{ax}1"]))
    found = None
    for ax, by in (("x", "y"), ("y", "x")):
        upright = near.where((c[f"as{ax}"] == c[f"ae{ax}"]) & (c[f"bs{ax}"] == c[f"be{ax}"]) & (lo(by) < hi(by)))
        middle = {ax: _div(c[f"a{ax}0"] + c[f"b{ax}0"], 2), by: _div(lo(by) + hi(by), 2)}
        own = upright.select("a_poly", "a_layer", F.abs(c[f"a{ax}0"] - c[f"b{ax}0"]).alias("gap"), middle["x"].alias("x"), middle["y"].alias("y"))
        found = own if found is None else found.union(own)
    found = found.union(_diagonal_gaps(near))
    found = found.select(F.col("a_poly").alias("poly"), F.col("a_layer").alias("layer"), F.col("gap").cast("long").alias("gap"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    found = inside(staged(found.where((F.col("gap") > 0) & (F.col("gap") < most)), "gaps"), edges)
    return found.where(F.col("inside") == F.lit(interior)).select(F.col("poly").alias("id"), "layer", "gap", "x", "y")


def _diagonal_gaps(near: DataFrame) -> DataFrame:
    """``a_poly, a_layer, gap, x, y`` of the parallel diagonal edges of ``near``: the perpendicular distance where they run side by side."""
    c = {f"{s}{k}": F.col(f"{s}_{k}") for s in "ab" for k in ("sx", "sy", "ex", "ey")}
    slanted = near.where((c["asx"] != c["aex"]) & (c["asy"] != c["aey"]) & (c["bsx"] != c["bex"]) & (c["bsy"] != c["bey"]))
    slanted = slanted.withColumns({"adx": c["aex"] - c["asx"], "ady": c["aey"] - c["asy"]}).where((F.col("adx") * (c["bey"] - c["bsy"]) - F.col("ady") * (c["bex"] - c["bsx"])) == 0)
    along = lambda px, py: (px - c["asx"]) * F.col("adx") + (py - c["asy"]) * F.col("ady")
    d = slanted.withColumns({"ts": along(c["bsx"], c["bsy"]), "te": along(c["bex"], c["bey"]), "length2": F.col("adx") * F.col("adx") + F.col("ady") * F.col("ady")})
    d = d.withColumns({"tlo": F.greatest(F.least("ts", "te"), F.lit(0)), "thi": F.least(F.greatest("ts", "te"), F.col("length2")), "cross": F.col("adx") * (c["bsy"] - c["asy"]) - F.col("ady") * (c["bsx"] - c["asx"])}).where("tlo < thi")
    wide = lambda x: F.col(x).cast("decimal(19,0)")
    d = d.withColumn("span", F.col("tlo") + F.col("thi")).withColumns({
        "d2": _div(wide("cross") * wide("cross"), F.col("length2")).cast("long"),
        "nx": wide("adx") * wide("span") - wide("ady") * wide("cross"), "ny": wide("ady") * wide("span") + wide("adx") * wide("cross"),
    })
    # the nearest whole of n / (2 length2), halves away from 0
    whole = lambda n: _div(F.col(n) + F.signum(F.col(n)).cast("decimal(1,0)") * wide("length2"), (2 * F.col("length2")).cast("decimal(19,0)")).cast("long")
    d = d.withColumns({"root": F.floor(F.sqrt(F.col("d2").cast("double"))).cast("long"), "mx": c["asx"] + whole("nx"), "my": c["asy"] + whole("ny")})
    gap = F.when(F.col("root") * F.col("root") > F.col("d2"), F.col("root") - 1).when((F.col("root") + 1) * (F.col("root") + 1) <= F.col("d2"), F.col("root") + 1).otherwise(F.col("root"))
    return d.select("a_poly", "a_layer", gap.alias("gap"), F.col("mx").alias("x"), F.col("my").alias("y"))


def min_width(edges: DataFrame, least: int) -> DataFrame:
    """Boxes narrower than ``least``, at their lower-left corner, and every inside gap below it of other rings."""
    boxes = boxes_of(edges)
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    plain = violations(boxes.where("is_box").where(narrow < least), "min_width", least, narrow, "x0", "y0")
    others = edges.join(boxes.where("not is_box").select("id"), "id", "left_semi")
    return plain.union(violations(facing_gaps(others, True, least), "min_width", least, F.col("gap"), "x", "y"))


def notch(edges: DataFrame, least: int) -> DataFrame:
    """Outside gaps of a ring with itself below ``least``."""
    return violations(facing_gaps(edges, False, least), "notch", least, F.col("gap"), "x", "y")


def _rings(polygons: DataFrame, found: str, of) -> DataFrame:
    """``of(ring)`` rows for each of ``polygons(id, layer, ring)``."""
    schema = f"id long, layer string, {found}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, layer, *row) for i, layer, ring in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for row in of([(p["x"], p["y"]) for p in ring])]
            if rows:
                kinds = [pa.int64(), pa.string(), *(pa.string() if c.endswith("string") else pa.int64() for c in found.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return polygons.select(F.col("id").cast("long"), F.col("layer").cast("string"), F.coalesce("ring", F.array().cast("array<struct<x:bigint,y:bigint>>")).alias("ring")).mapInArrow(run, schema)


def holes(polygons: DataFrame) -> DataFrame:
    """``id, layer, area, x, y``: the holes that a ring's own walk encloses, at their least vertex."""
    return _rings(polygons, "area long, x long, y long", lambda ring: [(abs(kernels.area2(h)) // 2, *min(h)) for h in kernels.keyhole_holes(ring)])


def min_enclosed_area(polygons: DataFrame, least: int) -> DataFrame:
    """Holes smaller than ``least``."""
    return violations(holes(polygons).where(F.col("area") < least), "min_enclosed_area", least, F.col("area"), "x", "y")


def cheesing(polygons: DataFrame, most: int) -> DataFrame:
    """Rings larger than ``most`` whose own walk encloses no hole; material within them doesn't count as one."""
    large = boxes_of(edges_of(polygons)).where(F.col("area") > most)
    whole = large.join(holes(polygons).select(F.col("id").alias("hid")).distinct(), F.col("id") == F.col("hid"), "left_anti")
    return violations(whole, "cheesing", most, F.col("area"), "x0", "y0")


def validity(polygons: DataFrame) -> DataFrame:
    """What no rule is defined over: rings without an area (measured 0), that cross or touch themselves wrongly (1), or that span too much (``geometry_capacity``), at their box's lower-left corner."""

    def faults(ring: list[tuple[int, int]]) -> list[tuple]:
        if not ring:
            return [("polygon_validity", 0, 0, 0)]
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        if max(xs) - min(xs) >= MOST_SPAN or max(ys) - min(ys) >= MOST_SPAN:
            return [("geometry_capacity", 1, min(xs), min(ys))]
        fault = kernels.validity(ring)
        return [("polygon_validity", fault[1], min(xs), min(ys))] if fault else []

    found = _rings(polygons, "kind string, measured long, x long, y long", faults)
    return violations(found, F.col("kind"), 0, F.col("measured"), "x", "y", rule_id="__geometry__")

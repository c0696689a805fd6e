"""Electrical evidence from layouts: antenna ratios, supply networks, pads and clamps, wells and taps, discharge paths.

Nodes are boxes ``(id, layer, x0, y0, x1, y1, net)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import discard, staged
from .derived import boolean
from .erc import findings
from .spatial import candidates, overlap

BOX = ["x0", "y0", "x1", "y1"]

# Names of supply rails with their volts, and of ground.
RAILS = {"VDD": 1.8, "VPWR": 1.8, "VCC": 1.8, "VDDH": 3.3, "VDDL": 0.9}
GROUNDS = ("VSS", "GND", "VGND", "GROUND", "DGND", "AGND")


def _area() -> Column:
    return (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))


def union_metrics(boxes: DataFrame, by: str = "grp") -> DataFrame:
    """``(by, area, perimeter)`` of the union of boxes for each value of ``by``.

    The union as disjoint boxes; what two of them share of their sides is no
    boundary. Work is by tile, so a group of any size is many tasks' work.
    """
    own = boxes.select(F.col(by).alias("grp"), *BOX)
    parts = staged(boolean(own, own.limit(0), "union").withColumn("id", F.monotonically_increasing_id()), "union-parts")
    met = candidates(parts, None, 0, ["grp"])
    shared = met.groupBy(F.col("a_grp").alias("g")).agg(F.sum(F.greatest(overlap("x"), overlap("y"), F.lit(0))).alias("shared"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    total = parts.groupBy("grp").agg(F.sum(w * h).cast("long").alias("area"), F.sum(2 * (w + h)).cast("long").alias("round"))
    out = total.join(shared, F.col("grp").eqNullSafe(F.col("g")), "left")
    return out.select(F.col("grp").alias(by), "area", (F.col("round") - 2 * F.coalesce("shared", F.lit(0))).cast("long").alias("perimeter"))


# --- antennas -----------------------------------------------------------------------


def antenna_electrical(nodes: DataFrame, gate_areas: DataFrame, metals: Sequence[int], ratio: float) -> DataFrame:
    """Nets whose area on all ``metals`` together is over ``ratio`` times their gates'; at the net's lowest box. ``gate_areas(id, gate)``."""
    metal = F.when(F.col("layer").isin(list(metals)), _area()).otherwise(0)
    by = nodes.join(gate_areas.withColumnRenamed("id", "gid"), F.col("id") == F.col("gid"), "left").groupBy("net").agg(
        F.sum(metal).alias("metal"), F.sum(F.coalesce("gate", F.lit(0))).alias("gate"), F.min(F.struct("id", "x0", "y0")).alias("m")
    )
    return findings(by.where((F.col("gate") > 0) & (F.col("metal") > F.lit(ratio) * F.col("gate"))), "antenna_electrical", F.col("net"), F.col("m.x0"), F.col("m.y0"))


@dataclass(frozen=True)
class Diode:
    """What a diode on a net takes off its ratio: ``credit`` a square micrometre and a ``bonus``, or all of it."""

    layer: int
    credit: float = 0.0
    bonus: float = 0.0
    waives: bool = False


def effective_antenna(nodes: DataFrame, gates: DataFrame, collectors: Sequence[tuple[int, float | None]], most: float, diode: Diode | None = None, dbu_nm: float = 1.0) -> DataFrame:
    """``net, gate_um2, etched_um2, diode_um2, ratio, waived, violates``: the effective ratio of each net with a gate.

    ``gates(net, box)``: gate regions. ``collectors``: layers, by area where the
    thickness is None and else by their side walls, the union's perimeter times
    the thickness (um). Regions are unions, so what overlaps counts once.
    """
    um = dbu_nm / 1000.0
    own = union_metrics(gates, "net").select("net", (F.col("area") * um * um).alias("gate_um2"))
    etched = None
    for layer, thick in collectors:
        m = union_metrics(nodes.where(F.col("layer") == layer), "net")
        part = m.select("net", ((F.col("area") * um * um) if thick is None else F.col("perimeter") * um * float(thick)).alias("e"))
        etched = part if etched is None else etched.union(part)
    out = own.join(etched.groupBy("net").agg(F.sum("e").alias("etched_um2")), "net", "left").fillna(0.0, ["etched_um2"])
    if diode is not None:
        d = union_metrics(nodes.where(F.col("layer") == diode.layer), "net").select("net", (F.col("area") * um * um).alias("diode_um2"))
        out = out.join(d, "net", "left").fillna(0.0, ["diode_um2"])
    else:
        out = out.withColumn("diode_um2", F.lit(0.0))
    has = F.col("diode_um2") > 0
    credit = F.when(has, F.col("diode_um2") * diode.credit + diode.bonus).otherwise(0.0) if diode is not None and not diode.waives else F.lit(0.0)
    out = out.withColumn("ratio", F.greatest(F.col("etched_um2") / F.col("gate_um2") - credit, F.lit(0.0))).withColumn("waived", has & F.lit(diode is not None and diode.waives))
    return out.withColumn("violates", ~F.col("waived") & (F.col("ratio") > most))


# --- supplies -----------------------------------------------------------------------


def supply_nets(names: DataFrame, globals_: Sequence[str] = ()) -> DataFrame:
    """``net, name, kind, volts``: the nets of ``names(net, name)`` that are rails or ground by name; a global net of another name is ground."""
    upper = F.upper("name")
    ground = upper.isin(list(GROUNDS)) | upper.startswith("VSS")
    volts = F.lit(None).cast("double")
    for rail, v in RAILS.items():
        volts = F.when(upper == rail, F.lit(v)).otherwise(volts)
    volts = F.coalesce(volts, F.when(upper.startswith("VDD"), F.lit(1.8)))
    kind = F.when(ground, "ground").when(volts.isNotNull(), "power").when(F.col("name").isin(list(globals_)), "ground")
    return names.withColumn("kind", kind).where("kind is not null").select("net", "name", "kind", F.when(F.col("kind") == "power", volts).otherwise(0.0).alias("volts"))


def supply_grid(nodes: DataFrame, supplies: DataFrame, vias: Sequence[tuple[int, Sequence[int], float]]) -> tuple[DataFrame, DataFrame]:
    """``(points, edges)`` of the supply nets: ``id, net, x, y, volts, fixed`` with each net's first box fixed, and ``a, b, ohm``.

    ``vias``: (cut layer, layers that it joins, ohm). An edge joins two boxes on
    a cut's layers that the same cut meets, once; of several cuts in parallel
    the conductances add.
    """
    on = nodes.join(supplies.select(F.col("net").alias("sn"), "volts"), F.col("net") == F.col("sn")).drop("sn")
    first = on.groupBy("net").agg(F.min("id").alias("first")).withColumnRenamed("net", "fn")
    points = on.join(first, F.col("net") == F.col("fn")).select("id", "net", F.expr("(x0 + x1) div 2").alias("x"), F.expr("(y0 + y1) div 2").alias("y"), "volts", (F.col("id") == F.col("first")).alias("fixed"))
    edges = None
    for cut, layers, ohm in vias:
        hit = candidates(nodes.where(F.col("layer") == cut).select("id", *BOX), on.where(F.col("layer").isin(list(layers))).select("id", *BOX))
        hit = hit.select(F.col("a_id").alias("cut"), F.col("b_id").alias("n"))
        # a cut meets the few boxes of the layers that it joins
        pair = hit.select("cut", F.col("n").alias("a")).join(hit.select("cut", F.col("n").alias("b")), "cut").where("a < b").select("a", "b", F.lit(1.0 / max(ohm, 1e-6)).alias("siemens"))
        edges = pair if edges is None else edges.union(pair)
    return points, edges.groupBy("a", "b").agg((1 / F.sum("siemens")).alias("ohm"))


# --- discharge ------------------------------------------------------------------------


def kth_smallest(rows: DataFrame, value: str, k: int) -> int | None:
    """The k-th smallest (from 0) of a column of longs from 0 to 2^48: three passes of counts by 16 bits. Eager; None where there are fewer."""
    prefix, left = 0, k
    for shift in (32, 16, 0):
        own = rows.where(F.shiftright(value, shift + 16) == prefix) if shift < 32 else rows
        counts = own.groupBy(F.shiftright(value, shift).alias("b")).count().orderBy("b").collect()  # 65,536 rows at most
        for r in counts:
            if left < r["count"]:
                prefix = r["b"]
                break
            left -= r["count"]
        else:
            return None
    return prefix


def pads(nodes: DataFrame, top: int, supplies: DataFrame, times: int = 100) -> DataFrame:
    """``id, net, x0, y0, x1, y1, direction``: boxes of the top metal of at least ``times`` its median area; ``power``, ``ground`` or ``unknown`` by their net. Eager."""
    metal = nodes.where(F.col("layer") == top).withColumn("area", _area())
    n = metal.count()
    median = kth_smallest(metal, "area", n // 2) if n else None
    if median is None:
        return metal.limit(0).select("id", "net", *BOX, F.lit("").alias("direction"))
    large = metal.where(F.col("area") >= max(median * times, 1))
    kinds = supplies.select(F.col("net").alias("sn"), "kind")
    return large.join(kinds, F.col("net") == F.col("sn"), "left").select("id", "net", *BOX, F.coalesce("kind", F.lit("unknown")).alias("direction"))


def clamps(devices: DataFrame, supplies: DataFrame) -> DataFrame:
    """``dev_id, pad_net, rail_net``: devices ``(dev_id, class, s, d, g, body)`` whose class names a clamp, by the first terminal that is off, and on, a rail."""
    rail = supplies.select(F.col("net").alias("rail"))
    own = devices.where(F.lower("class").contains("esd") | F.lower("class").contains("clamp"))
    pins = own.select("dev_id", "s", "d", F.posexplode(F.array("s", "d", "g", "body")).alias("k", "net")).where("net is not null")
    pins = pins.join(rail, F.col("net") == F.col("rail"), "left")
    at = lambda on: F.min_by("net", F.when(on, F.col("k")))
    by = pins.groupBy("dev_id", "s", "d").agg(at(F.col("rail").isNull()).alias("off"), at(F.col("rail").isNotNull()).alias("on"), F.count_if(F.col("rail").isNull()).alias("n_off"), F.count_if(F.col("rail").isNotNull()).alias("n_on"))
    return by.select("dev_id", F.when(F.col("n_off") > 0, F.col("off")).otherwise(F.col("s")).alias("pad_net"), F.when(F.col("n_on") > 0, F.col("on")).otherwise(F.col("d")).alias("rail_net"))


def clamp_paths(pads_: DataFrame, clamps_: DataFrame) -> DataFrame:
    """``pad, net, dev_id, rail_net``: signal pads and the clamps on their net."""
    return pads_.where("direction = 'unknown'").join(clamps_, F.col("net") == F.col("pad_net")).select(F.col("id").alias("pad"), "net", "dev_id", "rail_net")


def guard_rings(rings: DataFrame, grounds: DataFrame) -> DataFrame:
    """``id, layer, width, biased``: shapes ``rings(id, layer, box, area, net)`` whose box's perimeter squared is at least 50 times their area; biased on a net of ``grounds(net)``."""
    round_ = 2 * ((F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0"))).cast("double")
    like = rings.where(round_ * round_ / F.greatest("area", F.lit(1)) >= 50)
    ground = grounds.select(F.col("net").alias("gn")).distinct()
    return like.join(ground, F.col("net") == F.col("gn"), "left").select("id", "layer", F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("width"), F.col("gn").isNotNull().alias("biased"))


def discharge_paths(needs: DataFrame, edges: DataFrame, targets: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``req, status, target, ohm, capacity, clamp``: for each need the path of least resistance from its source to a target, over edges that carry its current.

    ``needs(req, source, amps, most_ohm, most_volts)``, ``edges(a, b, ohm,
    amps, volts, both)``, ``targets(req, node)``. Distances are relaxed edge by
    edge for all needs at once, a join and an aggregation a round, until none
    falls. ``status``: ``ok``, ``no path`` or ``too much resistance``. Eager.
    """
    way = edges.select("a", "b", "ohm", "amps", "volts").union(edges.where("both").select("b", "a", "ohm", "amps", "volts"))
    fit = needs.select("req", F.col("amps").alias("need"), "most_volts")
    way = staged(way.join(fit, (F.col("amps") >= F.col("need")) & (F.col("volts") <= F.col("most_volts"))).select("req", "a", "b", "ohm", "amps", "volts"), "ways")
    best = F.struct("ohm", "capacity", "clamp")
    inf = F.lit(float("inf"))
    now = staged(needs.select("req", F.col("source").alias("node"), F.struct(F.lit(0.0).alias("ohm"), inf.alias("capacity"), F.lit(0.0).alias("clamp")).alias("best")), "reached")
    for _ in range(max_rounds):
        n = now.select(F.col("req").alias("r"), F.col("node").alias("from"), "best")
        step = way.join(n, (F.col("req") == F.col("r")) & (F.col("a") == F.col("from")))
        step = step.select("req", F.col("b").alias("node"), (F.col("best.ohm") + F.col("ohm")).alias("ohm"), F.least("best.capacity", "amps").alias("capacity"), F.greatest("best.clamp", "volts").alias("clamp")).select("req", "node", best.alias("best"))
        new = staged(now.union(step).groupBy("req", "node").agg(F.min_by("best", "best.ohm").alias("best")), "reached")
        was = now.select(F.col("req").alias("r"), F.col("node").alias("m"), F.col("best.ohm").alias("was"))
        moved = new.join(was, (F.col("req") == F.col("r")) & (F.col("node") == F.col("m")), "left").where("was is null or best.ohm < was").head(1)
        discard(now)
        now = new
        if not moved:
            break
    else:
        raise RuntimeError("discharge paths did not settle")
    hit = now.join(targets, ["req", "node"]).join(needs.select(F.col("req").alias("rr"), "source"), F.col("req") == F.col("rr")).where("node <> source")
    first = hit.groupBy("req").agg(F.min(F.struct("best.ohm", "node", "best.capacity", "best.clamp")).alias("f"))
    out = needs.join(first, "req", "left")
    status = F.when(F.col("f").isNull(), "no path").when(F.col("f.ohm") > F.col("most_ohm"), "too much resistance").otherwise("ok")
    return out.select("req", status.alias("status"), F.col("f.node").alias("target"), F.col("f.ohm").alias("ohm"), F.col("f.capacity").alias("capacity"), F.col("f.clamp").alias("clamp"))


def latchup_checks(sites: DataFrame, least_width: float, most_aggressor: float, most_victim: float, most_tap: float) -> DataFrame:
    """``site, check``: what is wrong with ``sites(site, ring_width, continuous, biased, aggressor_um, victim_um, tap_um)``; a site without a ring has a null width."""
    checks = F.array_compact(F.array(
        F.when(F.col("ring_width").isNull(), "no ring"), F.when(F.col("ring_width") < least_width, "narrow ring"), F.when(~F.col("continuous"), "broken ring"), F.when(~F.col("biased"), "unbiased ring"),
        F.when(F.col("aggressor_um") > most_aggressor, "aggressor too far"), F.when(F.col("victim_um") > most_victim, "victim too far"), F.when(F.col("tap_um") > most_tap, "tap too far"),
    ))
    return sites.select("site", F.explode(checks).alias("check"))


# --- substrate ------------------------------------------------------------------------


def well_taps(wells: DataFrame, taps: DataFrame, dbu_nm: float = 1.0) -> DataFrame:
    """``well, tap, net, x, y, edge_nm``: taps on a net whose box meets a well's, with the distance of their centre to the well's nearest side."""
    hit = candidates(taps.where("net is not null"), wells.select("id", *BOX))
    cx, cy = F.expr("(a_x0 + a_x1) div 2"), F.expr("(a_y0 + a_y1) div 2")
    side = lambda c, ax: F.greatest(F.least(c - F.col(f"b_{ax}0"), F.col(f"b_{ax}1") - c), F.lit(0))
    return hit.select(F.col("b_id").alias("well"), F.col("a_id").alias("tap"), F.col("a_net").alias("net"), cx.alias("x"), cy.alias("y"), (F.least(side(cx, "x"), side(cy, "y")) * F.lit(dbu_nm)).cast("long").alias("edge_nm"))


def untapped_wells(wells: DataFrame, taps: DataFrame) -> DataFrame:
    """Wells that no tap on a net meets."""
    return wells.join(well_taps(wells, taps).select(F.col("well").alias("w")).distinct(), F.col("id") == F.col("w"), "left_anti")


def latchup_sites(devices: DataFrame, reach_nm: float = 50_000.0, dbu_nm: float = 1.0) -> DataFrame:
    """``n_dev, p_dev, distance_nm, severity``: N and P devices ``(dev_id, kind, x, y)`` within ``reach_nm``; High below a tenth of it, Medium below two fifths."""
    most = int(reach_nm / dbu_nm)
    at = lambda k: devices.where(F.col("kind") == k).select(F.col("dev_id").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    near = candidates(at("nmos"), at("pmos"), most)
    dx, dy = (F.col("a_x0") - F.col("b_x0")) * F.lit(dbu_nm), (F.col("a_y0") - F.col("b_y0")) * F.lit(dbu_nm)
    near = near.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= reach_nm)
    severity = F.when(F.col("d") < reach_nm / 10, "High").when(F.col("d") < reach_nm * 0.4, "Medium").otherwise("Low")
    return near.select(F.col("a_id").alias("n_dev"), F.col("b_id").alias("p_dev"), F.floor("d").cast("long").alias("distance_nm"), severity.alias("severity"))

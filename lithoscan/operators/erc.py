"""Electrical checks on nets and devices: heuristics, and the typed sign-off formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stage import staged
from .spatial import candidates, overlap

BOLTZMANN = 8.617333262e-5


def findings(t: DataFrame, check: str, detail: Column, x: Column | str = "x0", y: Column | str = "y0") -> DataFrame:
    at = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    return t.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"), at(x).alias("x"), at(y).alias("y"))


def _hits(a: DataFrame, b: DataFrame) -> DataFrame:
    return candidates(a, b).select(F.col("a_id").alias("hid")).distinct()


def floating_gate(nodes: DataFrame, gate_nets: DataFrame, driven: DataFrame, inner: list[int]) -> DataFrame:
    """Gate nets that no source or drain is on and that have no box outside the ``inner`` layers; at their lowest box."""
    outside = nodes.where(~F.col("layer").isin(inner)).select("net").distinct()
    bad = gate_nets.select("net").distinct().join(driven.select("net").distinct(), "net", "left_anti").join(outside, "net", "left_anti")
    at = nodes.groupBy("net").agg(F.min(F.struct("id", "x0", "y0")).alias("m"))
    return findings(bad.join(at, "net"), "floating_gate", F.col("net"), F.col("m.x0"), F.col("m.y0"))


def floating_well(wells: DataFrame, diffs: DataFrame, implants: DataFrame) -> DataFrame:
    """Wells that touch no channel box which itself touches an implant."""
    tied = diffs.join(_hits(diffs, implants), F.col("id") == F.col("hid"), "left_semi")
    return findings(wells.join(_hits(wells, tied), F.col("id") == F.col("hid"), "left_anti"), "floating_well", F.col("id"))


def missing_tie(diffs: DataFrame, pads: DataFrame, most: int) -> DataFrame:
    """Channels of at least ``most`` squared with a corner farther than ``most`` from the centre of every pad that touches them; the first such corner of LL, LR, UR, UL."""
    big = diffs.where((F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0")) >= most * most)
    cx, cy = F.expr("(b_x0 + b_x1) div 2"), F.expr("(b_y0 + b_y1) div 2")
    corners = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))
    d2 = lambda x, y: (cx - F.col(f"a_{x}")) * (cx - F.col(f"a_{x}")) + (cy - F.col(f"a_{y}")) * (cy - F.col(f"a_{y}"))
    nearest = candidates(big, pads).groupBy(F.col("a_id").alias("hid")).agg(*[F.min(d2(x, y)).alias(f"d{k}") for k, (x, y) in enumerate(corners)])
    # the first corner without a pad near enough; a channel without pads has none at its first
    far = F.coalesce(*[F.when(F.coalesce(F.col(f"d{k}") > most * most, F.lit(True)), F.struct(F.col(x).alias("x"), F.col(y).alias("y"))) for k, (x, y) in enumerate(corners)])
    found = big.join(nearest, F.col("id") == F.col("hid"), "left").withColumn("far", far).where("far is not null")
    return findings(found, "missing_tie", F.col("id"), F.col("far.x"), F.col("far.y"))


def multiple_drivers(devices: DataFrame) -> DataFrame:
    """``net, gates``: nets that no gate is on, driven by drains of devices with more than one gate net."""
    driven = devices.groupBy(F.col("d").alias("net")).agg(F.count_distinct("g").alias("gates")).where("gates > 1")
    return driven.join(devices.select(F.col("g").alias("net")).distinct(), "net", "left_anti")


def supply_short(devices: DataFrame) -> DataFrame:
    """``n_dev, p_dev``: the first N/P pair of one gate that shares two source/drain nets which aren't gates.

    Devices meet by the two ends that they would share, of which only the first
    N and the first P device are kept, so no pairs are made. A device has as many
    such twos as its ends make: one, unless its id has several rows.
    """
    gates = devices.select(F.col("g").alias("net")).distinct()
    ends = devices.where("g is not null").select("dev_id", "kind", "g", F.explode(F.array_distinct(F.array("s", "d"))).alias("net")).where("net is not null").join(gates, "net", "left_anti")
    own = ends.groupBy("dev_id", "kind").agg(F.array_sort(F.collect_set(F.struct("g", "net"))).alias("ends")).where("size(ends) >= 2")
    twos = F.flatten(F.transform("ends", lambda one, i: F.transform(F.slice("ends", i + 2, F.size("ends")), lambda other: F.struct(one.alias("one"), other.alias("other")))))
    lowest = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("dev_id")))
    both = own.select("dev_id", "kind", F.explode(twos).alias("two")).groupBy("two").agg(lowest("nmos").alias("n_dev"), lowest("pmos").alias("p_dev")).where("n_dev is not null and p_dev is not null")
    # all twos that the first N device shares have it as their first
    return both.agg(F.min(F.struct("n_dev", "p_dev")).alias("first")).where("first is not null").select("first.n_dev", "first.p_dev")


def tie_high_low(devices: DataFrame) -> DataFrame:
    """``net``: gate nets that are a source and never a drain."""
    pick = lambda c: devices.select(F.col(c).alias("net")).distinct()
    return pick("g").join(pick("s"), "net", "left_semi").join(pick("d"), "net", "left_anti")


def soft_connection(pads: DataFrame, wells: DataFrame, metals: DataFrame) -> DataFrame:
    """The first two pads ``(pa, pb, well)`` in one well that don't touch and have no metal box in common.

    A well's pads are numbered by id; only the first pad that has such a partner
    matters, so pads are compared with the well's others in order, a block of
    first pads at a time, until a block has one: pairs are never all made where
    the answer comes early. Eager.
    """
    box = ("x0", "y0", "x1", "y1")
    inside = candidates(pads, wells).select(F.col("a_id").alias("pad"), F.col("b_id").alias("well"), *[F.col(f"a_{c}").alias(c) for c in box])
    inside = staged(inside, "pads-in-wells")
    on = staged(candidates(pads, metals).select(F.col("a_id").alias("pad"), F.col("b_id").alias("metal")), "pads-on-metals")
    out = inside.select(F.col("pad").alias("pa"), F.col("pad").alias("pb"), "well")
    done, block = None, 64
    while True:
        left = inside if done is None else inside.where(F.col("pad") > done)
        first = [r["pad"] for r in left.select("pad").distinct().orderBy("pad").limit(block).collect()]
        if not first:
            return out.limit(0)
        a = inside.where(F.col("pad").isin(first)).select("well", F.col("pad").alias("pa"), *[F.col(c).alias(f"a_{c}") for c in box])
        b = inside.select(F.col("well").alias("wb"), F.col("pad").alias("pb"), *[F.col(c).alias(f"b_{c}") for c in box])
        pairs = a.join(b, (F.col("well") == F.col("wb")) & (F.col("pa") < F.col("pb"))).where((overlap("x") < 0) | (overlap("y") < 0))
        mine = on.where(F.col("pad").isin(first)).select(F.col("pad").alias("ca"), "metal")
        common = mine.join(on.select(F.col("pad").alias("cb"), "metal"), "metal").select("ca", "cb").distinct()
        found = pairs.join(common, (F.col("pa") == F.col("ca")) & (F.col("pb") == F.col("cb")), "left_anti").select("pa", "pb", "well").orderBy("pa", "pb", "well").limit(1)
        found = staged(found, "soft-connection")
        if found.head(1):
            return found
        done, block = first[-1], min(block * 4, 4096)


def unconnected_pin(nodes: DataFrame, device_nets: DataFrame, metals: list[int]) -> DataFrame:
    """Metal boxes whose net no device is on."""
    return findings(nodes.where(F.col("layer").isin(metals)).join(device_nets.select("net").distinct(), "net", "left_anti"), "unconnected_pin", F.col("id"))


def esd_missing(nodes: DataFrame, device_nets: DataFrame, metals: list[int]) -> DataFrame:
    """Nets without a device that have a metal box within 1 of the layout's bounding box: one row, at the lowest box."""
    box = nodes.agg(F.min("x0").alias("lx"), F.min("y0").alias("ly"), F.max("x1").alias("hx"), F.max("y1").alias("hy"))
    edge = nodes.where(F.col("layer").isin(metals)).join(F.broadcast(box)).where("x0 - lx <= 1 or y0 - ly <= 1 or hx - x1 <= 1 or hy - y1 <= 1")
    first = edge.join(device_nets.select("net").distinct(), "net", "left_anti").groupBy("net").agg(F.min(F.struct("id", "x0", "y0")).alias("m"))
    return findings(first, "esd_missing", F.col("net"), F.col("m.x0"), F.col("m.y0"))


def hv_crossing(nodes: DataFrame, wells: DataFrame, device_nets: DataFrame, metals: list[int]) -> DataFrame:
    """Nets without a device with a metal box that touches a well, and one (or the same) that no well holds whole; at the lowest box."""
    m = nodes.where(F.col("layer").isin(metals))
    pairs = candidates(m, wells)
    touch = pairs.select(F.col("a_net").alias("net")).distinct()
    held = pairs.where("b_x0 <= a_x0 and b_y0 <= a_y0 and b_x1 >= a_x1 and b_y1 >= a_y1").select(F.col("a_id").alias("hid")).distinct()
    out = m.join(held, F.col("id") == F.col("hid"), "left_anti").select("net").distinct()
    first = m.groupBy("net").agg(F.min(F.struct("id", "x0", "y0")).alias("m"))
    bad = first.join(touch, "net", "left_semi").join(out, "net", "left_semi").join(device_nets.select("net").distinct(), "net", "left_anti")
    return findings(bad, "hv_domain_crossing", F.col("net"), F.col("m.x0"), F.col("m.y0"))


def em_width(nodes: DataFrame, driven: DataFrame, metals: list[int], least: int) -> DataFrame:
    """Metal boxes narrower than ``least`` on nets with a source or drain."""
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return findings(nodes.where(F.col("layer").isin(metals) & (narrow < least)).join(driven.select("net").distinct(), "net", "left_semi"), "em_current_density", narrow)


# --- sign-off formulas -----------------------------------------------------------


def antenna_cumulative(stages: DataFrame, limit_milli: int) -> DataFrame:
    """``net, stage, milli``: where the running sum of ``stages(net, stage, collector, gate)`` over the gate is over the limit after a stage."""
    run = W.partitionBy("net").orderBy("stage").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = stages.where("gate > 0").withColumn("total", F.sum("collector").over(run)).withColumn("milli", F.expr("cast(total * 1000 div gate as bigint)"))
    return d.where(F.col("milli") > limit_milli).select("net", "stage", "milli")


def electromigration(branches: DataFrame, limit: float, activation: float = 0.9, exponent: float = 2.0, reference_k: float = 378.15, blech: float = 0.0) -> DataFrame:
    """``branch_id, density, allowed``: branches whose current density is over the limit at their temperature.

    ``branches(branch_id, current_ua, width, length, temp_c)``; density in
    microamperes per unit of width. The limit scales as Black's equation at equal
    lifetime. Short branches, of density times length up to ``blech``, are exempt.
    """
    density = F.col("current_ua").cast("double") / F.col("width")
    kelvin = F.col("temp_c") + 273.15
    allowed = F.lit(limit) * F.exp(F.lit(activation / (exponent * BOLTZMANN)) * (1 / kelvin - F.lit(1 / reference_k)))
    return branches.withColumns({"density": F.abs(density), "allowed": allowed}).where((F.col("density") > F.col("allowed")) & (F.col("density") * F.col("length") > blech)).select("branch_id", "density", "allowed")


def lifetime(parts: DataFrame, base_hours: float, exponent: float, activation: float, reference_v: float, reference_k: float, least_hours: float) -> DataFrame:
    """``id, hours``: parts ``(id, volts, temp_c)`` whose inverse-power and Arrhenius lifetime is below ``least_hours``."""
    kelvin = F.col("temp_c") + 273.15
    hours = F.lit(base_hours) * F.pow(F.lit(reference_v) / F.col("volts"), F.lit(exponent)) * F.exp(F.lit(activation / BOLTZMANN) * (1 / kelvin - F.lit(1 / reference_k)))
    return parts.withColumn("hours", hours).where(F.col("hours") < least_hours).select("id", "hours")


def ir_drop(nodes: DataFrame, nominal: float, most_volts: float, most_percent: float, over: float = 0.0) -> DataFrame:
    """``id, check, volts``: nodes ``(id, volts)`` whose drop is over the absolute or the relative limit, or that are above nominal by more than ``over``."""
    drop = F.lit(nominal) - F.col("volts")
    checks = F.array_compact(F.array(
        F.when(drop > most_volts, "ir_drop_volts"), F.when(drop * 100 > most_percent * nominal, "ir_drop_percent"), F.when(-drop > over, "overvoltage")
    ))
    return nodes.select("id", F.explode(checks).alias("check"), F.round("volts", 6).alias("volts"))


def suite_status(statuses: DataFrame, expected: int) -> DataFrame:
    """``all_clean``: whether ``statuses(check, status)`` has that many checks and each is Clean; an absent one is never clean."""
    return statuses.agg(((F.count(F.lit(1)) == expected) & F.coalesce(F.bool_and(F.col("status") == "Clean"), F.lit(False))).alias("all_clean"))

"""Whole flows: a netlist from a layout, and its verdict against a reference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stage import staged
from . import devices as recognition
from . import lvs
from .devices import BOX, BjtRule, CapacitorRule, DiodeRule, MosRule, ResistorRule
from .graph import refine


@dataclass(frozen=True)
class NetDeck:
    """``conductors``: layers that carry nets; ``vias``: (cut layer, layers that it joins); the device rules; names that are one net everywhere."""

    conductors: tuple[int, ...]
    vias: tuple[tuple[int, tuple[int, ...]], ...] = ()
    mos: tuple[MosRule, ...] = ()
    resistors: tuple[ResistorRule, ...] = ()
    diodes: tuple[DiodeRule, ...] = ()
    capacitors: tuple[CapacitorRule, ...] = ()
    bipolars: tuple[BjtRule, ...] = ()
    globals: tuple[str, ...] = ()
    reduce: bool = True


@dataclass
class Netlist:
    """``nodes(id, layer, box, shape, net)``, ``mos(dev_id, kind, flavor, g, s, d, body, w, l, as_, ps, ad, pd)``, the other devices,
    ``names(net, name, names)``, ``faults(check, detail)`` of what couldn't be a device, ``floating(net, boxes)``."""

    nodes: DataFrame
    mos: DataFrame
    resistors: DataFrame | None
    diodes: DataFrame | None
    capacitors: DataFrame | None
    bipolars: DataFrame | None
    names: DataFrame | None
    faults: DataFrame
    floating: DataFrame
    more: dict[str, DataFrame] = field(default_factory=dict)


def numbered(rows: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """``rows`` numbered without gaps in ``order``, by ranges: no task sorts the whole table. Eager."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    within = staged(parted.withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1), "numbered")
    # a row for each partition
    base = within.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = within.join(F.broadcast(base.select("__part", "__base")), "__part")
    return out.select(*rows.columns, (F.lit(start) + F.col("__base") + F.col("__at")).cast("long").alias(name))


def channel_segments(gates: DataFrame) -> DataFrame:
    """``diff_id, k, x0, y0, x1, y1, lo, hi, along_x``: what stays of each channel between its gates, numbered along its axis.

    ``gates`` as of :func:`lithoscan.operators.lvs.gates`; spans of gates that
    meet are one. Ends without a length are none.
    """
    tall = (F.col("y0") <= F.col("dy0")) & (F.col("y1") >= F.col("dy1"))
    axis = gates.groupBy("diff_id").agg((2 * F.count_if(tall) >= F.count(F.lit(1))).alias("along_x")).withColumnRenamed("diff_id", "d")
    g = gates.join(axis, F.col("diff_id") == F.col("d")).withColumns({
        "lo": F.when(F.col("along_x"), F.col("x0")).otherwise(F.col("y0")), "hi": F.when(F.col("along_x"), F.col("x1")).otherwise(F.col("y1")),
        "from": F.when(F.col("along_x"), F.col("dx0")).otherwise(F.col("dy0")), "to": F.when(F.col("along_x"), F.col("dx1")).otherwise(F.col("dy1")),
    })
    order = W.partitionBy("diff_id").orderBy("lo", "hi", "poly_id")
    top = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    g = g.withColumn("opens", F.coalesce((F.col("lo") > top).cast("int"), F.lit(1)))
    g = g.withColumn("span", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = g.groupBy("diff_id", "along_x", "span", "from", "to", "dx0", "dy0", "dx1", "dy1").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    after = W.partitionBy("diff_id").orderBy("span")
    before = spans.select("*", F.coalesce(F.lag("hi").over(after), F.col("from")).alias("s0"), F.col("lo").alias("s1"), (F.col("span") - 1).alias("k"))
    last = spans.withColumn("next", F.lead("lo").over(after)).where("next is null").select(*spans.columns, F.col("hi").alias("s0"), F.col("to").alias("s1"), F.col("span").alias("k"))
    parts = before.select("*").unionByName(last).where("s1 > s0")
    pick = lambda along, across: F.when(F.col("along_x"), F.col(along)).otherwise(F.col(across))
    return parts.select(
        "diff_id", F.col("k").cast("long").alias("k"), pick("s0", "dx0").alias("x0"), pick("dy0", "s0").alias("y0"), pick("s1", "dx1").alias("x1"), pick("dy1", "s1").alias("y1"), F.col("s0").alias("lo"), F.col("s1").alias("hi"), "along_x",
    )


def extract_netlist(shapes: DataFrame, deck: NetDeck, texts: DataFrame | None = None, dbu_nm: float = 1.0) -> Netlist:
    """The netlist of ``shapes(id, layer, x0, y0, x1, y1)`` and ``texts(text_id, text, x, y)`` by a deck.

    Channels are cut at their gates, and the parts are nodes of their own,
    numbered after the shapes. Nets are numbered from 0 in order of their first
    node. A transistor's source is the last part before its gate, its drain the
    first one behind; one that lacks either is none. A body without a well is
    null. Crossings that no rule, or several, meet are ``faults``. Eager up to the nets.
    """
    spark = shapes.sparkSession
    shapes = staged(shapes.select("id", "layer", *BOX), "shapes")
    pairs = sorted({(r.gate, r.channel) for r in deck.mos})
    gates = None
    for gate, channel in pairs:
        own = lvs.gates(shapes.where(F.col("layer") == gate), shapes.where(F.col("layer") == channel)).withColumn("d_layer", F.lit(channel))
        gates = own if gates is None else gates.union(own)
    top = shapes.agg(F.max("id")).first()[0] or 0
    carrying = [*deck.conductors, *[cut for cut, _ in deck.vias]]
    nodes = shapes.where(F.col("layer").isin(carrying)).withColumn("shape", F.col("id"))
    if gates is not None:
        gates = staged(gates, "gates")
        parts = channel_segments(gates).join(gates.select(F.col("diff_id").alias("dd"), "d_layer").distinct(), F.col("diff_id") == F.col("dd")).drop("dd")
        parts = staged(numbered(parts, ["diff_id", "k"], "id", top + 1), "segments")
        cut = nodes.join(gates.select(F.col("diff_id").alias("id")).distinct(), "id", "left_anti")
        nodes = cut.select("id", "layer", *BOX, "shape").union(parts.select("id", F.col("d_layer").alias("layer"), *BOX, F.col("diff_id").alias("shape")))
    nodes = staged(nodes, "nodes")
    joins = spark.createDataFrame([(cut, la) for cut, las in deck.vias for la in las] or [(-1, -1)], "la int, lb int")
    bound = lvs.bind_texts(texts, nodes) if texts is not None else None
    same = lvs.global_net_edges(bound.select("id", "text"), list(deck.globals)) if bound is not None and deck.globals else None
    found = staged(lvs.nets(nodes, joins, same), "raw-nets")
    ids = lvs.compact_nets(found)
    found = staged(found.join(ids, "net").drop("net").withColumnRenamed("net_id", "net"), "nets")
    # a shape's own net; that of a channel which was cut is its first part's
    of_shape = staged(found.groupBy(F.col("shape").alias("id")).agg(F.min_by("net", "id").alias("net")), "shape-nets")

    faults = spark.createDataFrame([], "check string, detail string")
    mos = spark.createDataFrame([], "dev_id long, kind string, flavor string, g long, s long, d long, body long, w long, l long, as_ long, ps long, ad long, pd long")
    if gates is not None:
        rules = staged(recognition.mos_rules(shapes, deck.mos, [r.marker for r in deck.bipolars]), "mos-rules")
        faults = rules.where("status not in ('ok', 'base')").select(F.lit("device").alias("check"), F.format_string("gate %d over channel %d: %s", "poly_id", "diff_id", "status").alias("detail"))
        part = parts.join(found.select(F.col("id").alias("pid"), "net"), F.col("id") == F.col("pid")).select(F.col("diff_id").alias("pd"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), "net", "along_x")
        g = gates.join(part, F.col("diff_id") == F.col("pd")).withColumns({"glo": F.when(F.col("along_x"), F.col("x0")).otherwise(F.col("y0")), "ghi": F.when(F.col("along_x"), F.col("x1")).otherwise(F.col("y1"))})
        w = F.when(F.col("along_x"), F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0"))
        ends = g.groupBy("poly_id", "diff_id", w.cast("long").alias("w"), (F.col("ghi") - F.col("glo")).cast("long").alias("l")).agg(
            F.max_by("net", F.when(F.col("phi") <= F.col("glo"), F.col("plo"))).alias("s"), F.min_by("net", F.when(F.col("plo") >= F.col("ghi"), F.col("plo"))).alias("d"),
            F.count_if(F.col("phi") <= F.col("glo")).alias("ns"), F.count_if(F.col("plo") >= F.col("ghi")).alias("nd"),
        ).where("ns > 0 and nd > 0")
        dev = ends.join(rules.where("status = 'ok'"), ["poly_id", "diff_id"]).join(of_shape.select(F.col("id").alias("gid"), F.col("net").alias("g")), F.col("poly_id") == F.col("gid"))
        dev = dev.join(of_shape.select(F.col("id").alias("wid"), F.col("net").alias("body")), F.col("well") == F.col("wid"), "left")
        dev = numbered(dev.select("poly_id", "diff_id", "kind", "flavor", "g", "s", "d", "body", "w", "l"), ["diff_id", "poly_id"], "dev_id")
        channels = shapes.where(F.col("layer").isin(sorted({r.channel for r in deck.mos})))
        mos = staged(recognition.diffusion(dev, channels, of_shape).select("dev_id", "kind", "flavor", "g", "s", "d", "body", "w", "l", "as_", "ps", "ad", "pd"), "mos")
    layers_of_gates = sorted({r.gate for r in deck.mos})
    out = Netlist(
        found, mos,
        recognition.resistors(shapes, of_shape, deck.resistors, layers_of_gates) if deck.resistors else None,
        recognition.diodes(shapes, of_shape, deck.diodes) if deck.diodes else None,
        recognition.capacitors(shapes, of_shape, deck.capacitors, dbu_nm) if deck.capacitors else None,
        recognition.bipolars(shapes, of_shape, deck.bipolars) if deck.bipolars else None,
        lvs.net_names(found, bound) if bound is not None else None, faults, found.limit(0).select("net", F.lit(0).cast("long").alias("boxes")),
    )
    out.floating = lvs.floating_nets(found.select("id", "net"), terminals(out))
    return out


def terminals(n: Netlist) -> DataFrame:
    """``(net)``: every net that a pin of a device is on."""
    out = n.mos.select(F.explode(F.array("g", "s", "d")).alias("net"))
    for t, pins in ((n.resistors, ("a", "b")), (n.diodes, ("a", "c")), (n.capacitors, ("a", "b")), (n.bipolars, ("emitter", "base", "collector"))):
        if t is not None:
            out = out.union(t.select(F.explode(F.array(*[F.col(p).cast("long") for p in pins])).alias("net")))
    return out.distinct()


def reduced(n: Netlist, protected: DataFrame | None = None) -> DataFrame:
    """Transistors after parallel and series reduction, as :func:`lithoscan.operators.lvs.compare` takes them."""
    kind = F.when(F.col("flavor") == "standard", F.col("kind")).otherwise(F.concat_ws("_", "kind", "flavor"))
    rows = n.mos.select("dev_id", kind.alias("kind"), "g", "s", "d", "w", "l")
    return lvs.series_reduce(rows, protected)


def net_seed_conflicts(layout_pins: DataFrame, reference_pins: DataFrame, seeds: DataFrame) -> DataFrame:
    """``cls, names``: classes that two or more of the reference's seeded nets ``seeds(net, name)`` fall into: the layout can't tell them apart."""
    _, nets = refine(layout_pins.union(reference_pins))
    hit = nets.where("side = 'reference'").join(seeds, "net")
    by = hit.groupBy("cls").agg(F.count_distinct("name").alias("n"), F.array_join(F.sort_array(F.collect_set("name")), " and ").alias("names"))
    return by.where("n > 1").select("cls", "names")


@dataclass
class LvsResult:
    """``status``: Match, Mismatch or Error; ``findings(check, detail)``; ``pairs(dev_id, reference)`` where classes are single."""

    status: str
    findings: DataFrame
    pairs: DataFrame | None = None


def run_lvs(spark: SparkSession, layout: Netlist | DataFrame, reference: DataFrame, seeds: DataFrame | None = None, fail_on_floating: bool = False, absolute: float = 0.0, relative: float = 0.0, strict: bool = False) -> LvsResult:
    """Whether a layout's transistors are the reference's. Eager.

    Faults of the extraction are an Error, never a match. Floating nets and
    nets with several names are reported and fail only if asked. Then counts,
    topology, seeds and sizes, the first that differs deciding; a match pairs
    the devices whose class is single on both sides.
    """
    findings = spark.createDataFrame([], "check string, detail string")
    rows = layout
    if isinstance(layout, Netlist):
        if layout.faults.head(1):
            return LvsResult("Error", layout.faults)
        rows = reduced(layout) if layout.more.get("reduce") is None else layout.mos
        findings = layout.floating.select(F.lit("floating_net").alias("check"), F.format_string("net %d, %d boxes", "net", "boxes").alias("detail"))
        if layout.names is not None:
            findings = findings.union(layout.names.where("names > 1").select(F.lit("label_conflict").alias("check"), F.format_string("net %d has %d names, first %s", "net", "names", "name").alias("detail")))
        if fail_on_floating and layout.floating.head(1):
            return LvsResult("Mismatch", findings)
    rows = staged(rows.select("dev_id", "kind", "g", "s", "d", "w", "l"), "lvs-layout")
    bad = staged(lvs.compare(rows, reference, absolute, relative, strict), "lvs-findings")
    if bad.head(1):
        return LvsResult("Mismatch", findings.union(bad))
    pins, ref_pins = lvs.device_pins(rows, "layout", strict), lvs.device_pins(reference, "reference", strict)
    if seeds is not None:
        clash = staged(net_seed_conflicts(pins, ref_pins, seeds).select(F.lit("net_seed_conflict").alias("check"), F.concat("names", F.lit(" can't be told apart")).alias("detail")), "lvs-seeds")
        if clash.head(1):
            return LvsResult("Mismatch", findings.union(clash))
    classes, _ = refine(pins.union(ref_pins))
    single = classes.groupBy("cls").agg(F.count_if(F.col("side") == "layout").alias("n"), F.max(F.when(F.col("side") == "layout", F.col("dev_id"))).alias("dev_id"), F.max(F.when(F.col("side") == "reference", F.col("dev_id"))).alias("reference"))
    return LvsResult("Match", findings, single.where("n = 1").select("dev_id", "reference"))

"""Netlists from layouts: nets, transistors, reduction, checks and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stage import staged
from .graph import connected_components, refine
from .spatial import candidates, overlap


def contacts(nodes: DataFrame, joins: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between nodes ``(id, layer, x0, y0, x1, y1)``.

    Boxes of one layer join where they touch; those of two layers where the pair
    is in ``joins(la, lb)`` and they overlap in area.
    """
    pairs = candidates(nodes)
    # a row for each pair of layers a cut joins: small by construction
    both = joins.union(joins.select(F.col("lb"), F.col("la"))).distinct().withColumn("hit", F.lit(True))
    pairs = pairs.join(F.broadcast(both), (F.col("a_layer") == F.col("la")) & (F.col("b_layer") == F.col("lb")), "left")
    area = (overlap("x") > 0) & (overlap("y") > 0)
    return pairs.where((F.col("a_layer") == F.col("b_layer")) | (F.coalesce("hit", F.lit(False)) & area)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def nets(nodes: DataFrame, joins: DataFrame, same_net: DataFrame | None = None) -> DataFrame:
    """``nodes`` with ``net``: the smallest node id that each is connected to. ``same_net(a, b)``: further edges, as of global names."""
    edges = contacts(nodes, joins)
    if same_net is not None:
        edges = edges.union(same_net.select("a", "b"))
    roots = connected_components(edges)
    return nodes.join(roots, nodes["id"] == roots["node"], "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("root", nodes["id"]).alias("net"))


def compact_nets(found: DataFrame) -> DataFrame:
    """``(net, net_id)``: nets numbered from 0 in order of their smallest node, by prefix sums over ranges."""
    ids = found.select("net").distinct().repartitionByRange("net").sortWithinPartitions("net").withColumn("part", F.spark_partition_id())
    ids = staged(ids.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("net")) - 1), "net-ids")
    base = ids.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return ids.join(F.broadcast(base.select("part", "base")), "part").select("net", (F.col("base") + F.col("at")).cast("long").alias("net_id"))


def global_net_edges(labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Edges that join all nodes of ``labels(id, text)`` with one of the global names."""
    own = labels.where(F.col("text").isin(*names))
    first = own.groupBy("text").agg(F.min("id").alias("b"))
    return own.join(first, "text").where("id <> b").select(F.col("id").alias("a"), "b")


def bind_texts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(text_id, text, id)``: each text's node, the lowest one whose closed box holds its point."""
    points = texts.select(F.col("text_id").alias("id"), "text", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return candidates(points, nodes).groupBy(F.col("a_id").alias("text_id"), F.col("a_text").alias("text")).agg(F.min("b_id").alias("id"))


def net_names(found: DataFrame, bound: DataFrame) -> DataFrame:
    """``(net, name, names)``: the name of the net's first text, and how many different ones it has."""
    on = bound.join(found.select(F.col("id"), "net"), "id")
    return on.groupBy("net").agg(F.min_by("text", "text_id").alias("name"), F.count_distinct("text").alias("names"))


def label_conflicts(found: DataFrame, bound: DataFrame) -> DataFrame:
    return net_names(found, bound).where("names > 1").select("net", "name", "names")


# --- transistors ----------------------------------------------------------------


def gates(poly: DataFrame, diff: DataFrame) -> DataFrame:
    """``dev_id.. : poly_id, diff_id, x0, y0, x1, y1``: every positive overlap of a gate box with a channel box."""
    lo, hi = lambda c: F.greatest(f"a_{c}", f"b_{c}"), lambda c: F.least(f"a_{c}", f"b_{c}")
    hit = candidates(poly, diff).where((overlap("x") > 0) & (overlap("y") > 0))
    return hit.select(
        F.col("a_id").alias("poly_id"), F.col("b_id").alias("diff_id"), lo("x0").alias("x0"), lo("y0").alias("y0"), hi("x1").alias("x1"), hi("y1").alias("y1"),
        *[F.col(f"b_{c}").alias(f"d{c}") for c in ("x0", "y0", "x1", "y1")],
    )


def transistors(found: DataFrame) -> DataFrame:
    """``poly_id, diff_id, w, l, source, drain`` of :func:`gates`.

    A channel is cut along x where most of its gates, by number, cross it from
    top to bottom, else along y. Its segments are numbered from 0 between the
    merged spans of the gates; a transistor's source is the segment before its
    gate and its drain the one after.
    """
    tall = (F.col("y0") <= F.col("dy0")) & (F.col("y1") >= F.col("dy1"))
    axis = found.groupBy("diff_id").agg((2 * F.count_if(tall) >= F.count(F.lit(1))).alias("along_x")).withColumnRenamed("diff_id", "d")
    g = found.join(axis, F.col("diff_id") == F.col("d")).withColumns({
        "lo": F.when(F.col("along_x"), F.col("x0")).otherwise(F.col("y0")), "hi": F.when(F.col("along_x"), F.col("x1")).otherwise(F.col("y1")),
        "w": F.when(F.col("along_x"), F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0")),
    })
    order = W.partitionBy("diff_id").orderBy("lo", "hi", "poly_id")
    top = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    g = g.withColumn("opens", F.coalesce((F.col("lo") > top).cast("int"), F.lit(0)))
    g = g.withColumn("span", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return g.select("poly_id", "diff_id", F.col("w").cast("long").alias("w"), (F.col("hi") - F.col("lo")).cast("long").alias("l"), F.col("span").cast("long").alias("source"), (F.col("span") + 1).cast("long").alias("drain"))


def device_counts(devices: DataFrame) -> DataFrame:
    return devices.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def parallel_reduce(devices: DataFrame) -> DataFrame:
    """Devices ``(dev_id, kind, g, s, d, w, l)`` with equal kind, gate, source/drain set and length as one; widths add."""
    key = [F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")]
    return devices.groupBy("kind", "g", *key, "l").agg(F.min("dev_id").alias("dev_id"), F.sum("w").cast("long").alias("w"), F.count(F.lit(1)).alias("merged"))


def series_reduce(devices: DataFrame, protected: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """Chains of devices with equal kind, gate and width over nets that only two source/drain pins meet: lengths add.

    Alternates with the parallel step until neither finds a device. A chain's
    inner net must be no gate and not in ``protected(net)``. In each round,
    every second link of a chain is joined at least: a device joins over the
    least of its inner nets that is least for both of its devices.
    """
    cols = ["dev_id", "kind", "g", "s", "d", "w", "l"]
    now = staged(parallel_reduce(devices).select(*cols), "series")
    count = now.count()
    for _ in range(max_rounds):
        ends = now.select("dev_id", F.explode(F.array("s", "d")).alias("net"), "kind", "g", "w")
        inner = ends.groupBy("net").agg(F.count(F.lit(1)).alias("n"), F.min("dev_id").alias("a"), F.max("dev_id").alias("b"), F.count_distinct("kind", "g", "w").alias("sorts"))
        inner = inner.where("n = 2 and a <> b and sorts = 1").join(now.select(F.col("g").alias("net")).distinct(), "net", "left_anti")
        if protected is not None:
            inner = inner.join(protected.select("net"), "net", "left_anti")
        each = inner.select("net", F.explode(F.array("a", "b")).alias("dev"))
        least = each.groupBy("dev").agg(F.min("net").alias("low"))
        la, lb = least.select(F.col("dev").alias("a"), F.col("low").alias("la")), least.select(F.col("dev").alias("b"), F.col("low").alias("lb"))
        chosen = staged(inner.join(la, "a").join(lb, "b").where("net = la and net = lb").select("net", "a", "b"), "series-links")
        if chosen.head(1):
            a = now.select(*[F.col(c).alias(f"a_{c}") for c in cols])
            b = now.select(*[F.col(c).alias(f"b_{c}") for c in cols])
            far = lambda s: F.when(F.col(f"{s}_s") == F.col("net"), F.col(f"{s}_d")).otherwise(F.col(f"{s}_s"))
            joined = chosen.join(a, F.col("a") == F.col("a_dev_id")).join(b, F.col("b") == F.col("b_dev_id")).select(
                F.col("a").alias("dev_id"), F.col("a_kind").alias("kind"), F.col("a_g").alias("g"), far("a").alias("s"), far("b").alias("d"), F.col("a_w").alias("w"), (F.col("a_l") + F.col("b_l")).alias("l")
            )
            gone = chosen.select(F.explode(F.array("a", "b")).alias("dev_id"))
            now = now.join(gone, "dev_id", "left_anti").select(*cols).union(joined.select(*cols))
        now = staged(parallel_reduce(now).select(*cols), "series")
        if (n := now.count()) == count:
            return now
        count = n
    raise RuntimeError("series reduction did not converge")


def device_pins(devices: DataFrame, side: str, strict: bool = False) -> DataFrame:
    """``(side, dev_id, kind, role, net)``: three pins of each transistor; source and drain share a role unless ``strict``."""
    role = lambda r: F.lit(r if strict else "sd")
    pins = F.array(F.struct(F.lit("g").alias("role"), F.col("g").cast("long").alias("net")), F.struct(role("s").alias("role"), F.col("s").cast("long").alias("net")), F.struct(role("d").alias("role"), F.col("d").cast("long").alias("net")))
    return devices.select(F.lit(side).alias("side"), "dev_id", "kind", F.explode(pins).alias("p")).select("side", "dev_id", "kind", "p.role", "p.net")


def floating_nets(found: DataFrame, terminals: DataFrame) -> DataFrame:
    """``(net, boxes)``: nets with boxes but without any of ``terminals(net)``."""
    return found.groupBy("net").agg(F.count(F.lit(1)).alias("boxes")).join(terminals.select("net").distinct(), "net", "left_anti")


def compare(layout: DataFrame, reference: DataFrame, absolute: float = 0.0, relative: float = 0.0, strict: bool = False) -> DataFrame:
    """``check, detail`` rows where two netlists of devices differ; none if they match.

    Device counts first; if they agree, classes of the joint refinement are
    compared as multisets, then sorted sizes within classes, within the larger
    of both tolerances and only where the reference gives sizes.
    """
    c = layout.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(reference.groupBy("kind").agg(F.count(F.lit(1)).alias("m")), "kind", "full")
    counts = c.where("coalesce(n, 0) <> coalesce(m, 0)").select(F.lit("device_count").alias("check"), F.format_string("%s: %d in layout, %d in reference", "kind", F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("detail"))
    if counts.head(1):
        return counts
    devices, found = refine(device_pins(layout, "layout", strict).union(device_pins(reference, "reference", strict)))
    rows = None
    for what, t in (("device", devices), ("net", found)):
        own = t.groupBy("cls").agg(F.count_if(F.col("side") == "layout").alias("n"), F.count_if(F.col("side") == "reference").alias("m"))
        bad = own.where("n <> m").select(F.lit("topology").alias("check"), F.format_string("%s class of %d in layout and %d in reference", F.lit(what), "n", "m").alias("detail"))
        rows = bad if rows is None else rows.union(bad)
    if rows.head(1):
        return rows
    sizes = layout.select(F.lit("layout").alias("side"), "dev_id", "w", "l").union(reference.select(F.lit("reference").alias("side"), "dev_id", "w", "l"))
    ranked = devices.join(sizes, ["side", "dev_id"]).withColumn("k", F.row_number().over(W.partitionBy("side", "cls").orderBy("w", "l")))
    a, b = (ranked.where(F.col("side") == s).select("cls", "k", *[F.col(x).alias(f"{s[0]}_{x}") for x in ("w", "l", "dev_id")]) for s in ("layout", "reference"))
    off = lambda x: F.abs(F.col(f"l_{x}") - F.col(f"r_{x}")) > F.greatest(F.lit(absolute), F.lit(relative) * F.col(f"r_{x}"))
    bad = a.join(b, ["cls", "k"]).where((F.col("r_w") > 0) & (F.col("r_l") > 0) & (off("w") | off("l")))
    return bad.select(F.lit("parametric").alias("check"), F.format_string("device %d: %d x %d, reference %d x %d", "l_dev_id", "l_w", "l_l", "r_w", "r_l").alias("detail"))


# --- antenna ---------------------------------------------------------------------


def antenna(found: DataFrame, gate_areas: DataFrame, metal: int, ratio: int) -> DataFrame:
    """``net, metal, gate, milli``: nets whose area on ``metal`` is over ``ratio`` times that of their gates; milli: 1000 times the ratio.

    ``gate_areas(id, gate)``: the gate area of each node.
    """
    size = F.when(F.col("layer") == metal, (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))).otherwise(0)
    by = found.join(gate_areas.withColumnRenamed("id", "gid"), F.col("id") == F.col("gid"), "left").groupBy("net").agg(F.sum(size).cast("long").alias("metal"), F.sum(F.coalesce("gate", F.lit(0))).cast("long").alias("gate"))
    return by.where((F.col("gate") > 0) & (F.col("metal") > ratio * F.col("gate"))).withColumn("milli", F.expr("metal * 1000 div gate"))


def antenna_stages(nodes: DataFrame, joins: DataFrame, gate_areas: DataFrame, metals: Sequence[int], base: Sequence[int], ratio: int, diode: int | None = None) -> DataFrame:
    """``id, milli``: gates whose worst ratio over the stages of fabrication is over ``ratio``.

    Stage k has the first k metals and the ``base`` layers (gates and cuts); all
    stages are one connected-components run, each on nodes of its own. A
    component that a box of layer ``diode`` is part of is waived.
    """
    stages = [(k, la) for k in range(len(metals)) for la in [*metals[: k + 1], *base, *([diode] if diode is not None else [])]]
    spark = nodes.sparkSession
    of = F.broadcast(spark.createDataFrame(stages, "stage long, on_layer long"))
    copies = nodes.join(of, F.col("layer") == F.col("on_layer")).drop("on_layer")
    copies = staged(copies.withColumn("node", F.col("id") * len(metals) + F.col("stage")), "stages")
    edges = contacts(nodes, joins)
    pairs = edges.join(copies.select(F.col("id").alias("a"), F.col("stage").alias("sa"), F.col("node").alias("na")), "a")
    pairs = pairs.join(copies.select(F.col("id").alias("b"), F.col("stage").alias("sb"), F.col("node").alias("nb")), "b").where("sa = sb").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    roots = connected_components(pairs)
    on = copies.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").withColumn("comp", F.coalesce("root", "node"))
    on = on.join(gate_areas.withColumnRenamed("id", "gid"), F.col("id") == F.col("gid"), "left")
    size = F.when(F.col("layer").isin(*metals), (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))).otherwise(0)
    waived = F.max((F.col("layer") == F.lit(diode)).cast("int")) if diode is not None else F.lit(0)
    comp = on.groupBy("comp").agg(F.sum(size).alias("metal"), F.sum(F.coalesce("gate", F.lit(0))).alias("gate_sum"), waived.alias("waived"))
    worst = on.where("gate > 0").select("id", "comp").join(comp, "comp").where("waived = 0").groupBy("id").agg(F.max(F.expr("cast(metal * 1000 div gate_sum as bigint)")).alias("milli"))
    return worst.where(F.col("milli") > 1000 * ratio)

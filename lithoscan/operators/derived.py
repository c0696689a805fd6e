"""Derived layers: exact region algebra on boxes, and the tree of operators compiled to it.

A region is a table of boxes ``(grp, x0, y0, x1, y1)``; boxes of one group may
overlap on the way in and are disjoint on the way out. Groups are independent
(components, tiles or cells), so the algebra is windows by group and slab.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stage import staged
from .graph import labelled
from .spatial import candidates, overlap, tiled

BOX = ["x0", "y0", "x1", "y1"]
OPS = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "subtraction": lambda a, b: a & ~b,
    "xor": lambda a, b: (a & ~b) | (b & ~a),
}


def boolean(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Disjoint boxes of ``a op b``, group by group, cut at the borders of tiles.

    Boxes are cut into tiles first, so the work is by (group, tile) and a
    chip-wide group is many tasks' work. Between successive x of a tile's sides
    lies a slab; within it, running counts of opened and closed boxes over y
    tell where each side covers.
    """
    both = a.select("grp", *BOX, F.lit(1).alias("da"), F.lit(0).alias("db")).union(b.select("grp", *BOX, F.lit(0), F.lit(1)))
    both = tiled(both.where("x1 > x0 and y1 > y0"))
    keys = ["grp", "tx", "ty"]
    xs = both.select(*keys, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slabs = xs.withColumn("nx", F.lead("x").over(W.partitionBy(*keys).orderBy("x"))).where("nx is not null").withColumnsRenamed({k: f"s_{k}" for k in keys})
    same = (F.col("grp") == F.col("s_grp")) & (F.col("tx") == F.col("s_tx")) & (F.col("ty") == F.col("s_ty"))
    cut = both.join(slabs, same & (F.col("x0") <= F.col("x")) & (F.col("nx") <= F.col("x1")))
    events = cut.select(*keys, "x", "nx", F.explode(F.array(F.struct(F.col("y0").alias("y"), F.col("da").alias("da"), F.col("db").alias("db")), F.struct(F.col("y1").alias("y"), (-F.col("da")).alias("da"), (-F.col("db")).alias("db")))).alias("e"))
    events = events.groupBy(*keys, "x", "nx", F.col("e.y").alias("y")).agg(F.sum("e.da").alias("da"), F.sum("e.db").alias("db"))
    order = W.partitionBy(*keys, "x").orderBy("y")
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    state = events.select(*keys, "x", "nx", "y", F.lead("y").over(order).alias("ny"), (F.sum("da").over(run) > 0).alias("in_a"), (F.sum("db").over(run) > 0).alias("in_b"))
    kept = state.withColumn("keep", OPS[op](F.col("in_a"), F.col("in_b")))
    # successive intervals of a slab that are kept are one box
    opens = F.col("keep") & ~F.coalesce(F.lag("keep").over(order), F.lit(False))
    runs = kept.withColumn("part", F.sum(opens.cast("int")).over(run)).where("keep and ny is not null")
    return runs.groupBy(*keys, F.col("x").alias("x0"), F.col("nx").alias("x1"), "part").agg(F.min("y").alias("y0"), F.max("ny").alias("y1")).select("grp", *BOX)


def grouped(*layers: DataFrame, margin: int = 0) -> list[DataFrame]:
    """The layers' boxes with ``grp``: components of what touches, or comes within ``margin``, over all of them."""
    tagged = [t.select((F.col("id") * len(layers) + i).alias("id"), *BOX) for i, t in enumerate(layers)]
    nodes = tagged[0]
    for t in tagged[1:]:
        nodes = nodes.union(t)
    edges = candidates(nodes, None, margin).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    out = labelled(nodes, edges)
    return [out.where(F.col("id") % len(layers) == i).select((F.expr(f"id div {len(layers)}")).alias("id"), "grp", *BOX) for i in range(len(layers))]


def grow(a: DataFrame, by: int) -> DataFrame:
    """Boxes grown by a square of half side ``by``; their union is the grown region."""
    return a.select("grp", (F.col("x0") - by).alias("x0"), (F.col("y0") - by).alias("y0"), (F.col("x1") + by).alias("x1"), (F.col("y1") + by).alias("y1"))


def shrink(a: DataFrame, by: int) -> DataFrame:
    """What stays of each group's region at least ``by`` from its outside, in a square's sense."""
    frame = a.groupBy("grp").agg(*[(F.min(c) - 2 * by).alias(c) for c in ("x0", "y0")], *[(F.max(c) + 2 * by).alias(c) for c in ("x1", "y1")]).select("grp", *BOX)
    return boolean(a, grow(boolean(frame, a, "subtraction"), by), "subtraction")


def areas(region: DataFrame) -> DataFrame:
    """``(grp, area)`` of a region of disjoint boxes."""
    return region.groupBy("grp").agg(F.sum((F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))).cast("long").alias("area"))


def component_count(region: DataFrame) -> DataFrame:
    """``(grp, components)``: parts of each group's region that share no edge; boxes that meet in a corner only are apart."""
    boxes = region.withColumn("id", F.monotonically_increasing_id())
    boxes = staged(boxes, "region")
    edges = candidates(boxes, None, 0, ["grp"]).where(F.greatest(overlap("x"), overlap("y")) > 0)
    parts = labelled(boxes, edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), label="part")
    return parts.groupBy("grp").agg(F.count_distinct("part").alias("components"))


def interacting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Boxes of ``a(id, ...)`` of whose merged shape some part overlaps a box of ``b`` in area."""
    edges = candidates(a).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    shapes = labelled(a, edges)
    hit = candidates(shapes, b).where((overlap("x") > 0) & (overlap("y") > 0)).select(F.col("a_grp").alias("g")).distinct()
    return shapes.join(hit, F.col("grp") == F.col("g"), "left_semi").select(*a.columns)


def edge_filter(edges: DataFrame, orientation: str | None = None, shortest: int | None = None, longest: int | None = None) -> DataFrame:
    """Edges by orientation (``horizontal``, ``vertical``, ``diagonal``) and length, bounds included."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind: dict[str | None, Column] = {None: F.lit(True), "horizontal": (dy == 0) & (dx != 0), "vertical": (dx == 0) & (dy != 0), "diagonal": (dx != 0) & (dy != 0)}
    d2 = dx.cast("long") * dx + dy.cast("long") * dy
    out = edges.where(kind[orientation])
    out = out if shortest is None else out.where(d2 >= shortest * shortest)
    return out if longest is None else out.where(d2 <= longest * longest)


@dataclass(frozen=True)
class Node:
    """A node of a derived-layer tree: ``op`` with its inputs, a layer's name or an amount."""

    op: str
    inputs: tuple[Node, ...] = ()
    layer: str | None = None
    amount: int = 0


BINARY = {"union": "union", "intersection": "intersection", "subtraction": "subtraction", "xor": "xor", "inside": "intersection", "outside": "subtraction"}


def compile_layer(node: Node | str, layers: dict[str, DataFrame], named: dict[str, Node] | None = None, _open: tuple[str, ...] = ()) -> DataFrame:
    """The region ``(grp, box)`` of a tree over ``layers``; names may also be other trees' (``named``), without cycles.

    ``inside`` is the intersection and ``outside`` the subtraction, both clipped;
    ``interacting`` keeps whole merged shapes; ``not_within`` subtracts from its
    first input as the universe. All layers must carry the same groups.
    """
    if isinstance(node, str):
        node = Node("layer", layer=node)
    if node.op == "layer":
        if node.layer in layers:
            return layers[node.layer].select("grp", *BOX)
        if named is None or node.layer not in named:
            raise KeyError(f"no layer {node.layer}")
        if node.layer in _open:
            raise ValueError("cycle in derived layers: " + " -> ".join([*_open, node.layer]))
        return compile_layer(named[node.layer], layers, named, (*_open, node.layer))
    found = [compile_layer(n, layers, named, _open) for n in node.inputs]
    if node.op in BINARY:
        return boolean(found[0], found[1], BINARY[node.op])
    if node.op == "not_within":
        return boolean(found[0], found[1], "subtraction")
    if node.op == "grow":
        return boolean(grow(found[0], node.amount), found[0], "union")
    if node.op == "shrink":
        return shrink(found[0], node.amount)
    if node.op == "interacting":
        a, b = (t.withColumn("id", F.xxhash64("grp", *BOX)) for t in found)
        return interacting(a.select("id", "grp", *BOX).withColumnRenamed("grp", "own"), b).select(F.col("own").alias("grp"), *BOX)
    raise ValueError(f"no operator {node.op}")

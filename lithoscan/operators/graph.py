"""Graph operators: connected components, dependency closure and partition refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import discard, staged


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``edges(a, b)``; the root is its component's smallest node.

    Each round hooks every node's larger neighbours to its least one and then
    shortens what hangs on leaves, two min-aggregations and joins by node. Rounds
    grow with the logarithm of the longest path and are staged, so lineage stays
    flat. Self loops and nulls are ignored; no edge gives an empty result. Eager:
    runs the rounds.
    """
    e = staged(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    seen = _digest(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        near = large.join(low, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = staged(near.union(low.select("k", "m")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
        discard(e)
        e, now = step, _digest(step)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not converge")
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(leaves.select("root", "root").distinct())


def _digest(e: DataFrame) -> tuple[int, int | None]:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def labelled(nodes: DataFrame, edges: DataFrame, node: str = "id", label: str = "grp") -> DataFrame:
    """``nodes`` with their component's smallest node; a node without an edge is its own."""
    roots = connected_components(edges)
    return nodes.join(roots, nodes[node] == roots["node"], "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("root", nodes[node]).alias(label))


def closure(start: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """All ``(item)`` reachable from ``start(item)`` over ``edges(src, dst)``, the start included; semi-naive."""
    known = staged(start.select("item").distinct(), "closure")
    new = known
    for _ in range(max_rounds):
        found = edges.join(new, edges["src"] == new["item"]).select(F.col("dst").alias("item")).distinct()
        new = staged(found.join(known, "item", "left_anti"), "closure")
        if not new.head(1):
            return known
        known = staged(known.union(new), "closure")
    raise RuntimeError("closure did not converge")


def _multiset() -> list[Column]:
    """Aggregates that tell multisets of (role, cls) apart: their number, and sums of two hashes of each."""
    each = F.xxhash64("role", "cls")
    other = F.xxhash64(F.lit("second"), "cls", "role")
    return [F.count(F.lit(1)), *(F.sum(h.cast("decimal(20,0)")) for h in (each, other))]


def refine(pins: DataFrame, seeds: DataFrame | None = None, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Joint partition refinement of ``pins(side, dev_id, kind, role, net)`` of two netlists.

    Devices and nets get classes by their neighbours' classes until the number
    of classes stays; a class is a hash of the kind and, over the neighbours, of
    the number and two sums of hashes of (role, neighbour's class), so equal
    classes on both sides correspond, and a net of any size is a partial
    aggregation, never one row's list.
    ``seeds(side, net, name)`` gives nets a name of their own to begin with.
    Returns ``devices(side, dev_id, cls)`` and ``nets(side, net, cls)``. Classes
    travel one device a round; every round but the last adds a class, so there
    are no more rounds than devices and nets, ``max_rounds`` unless given.
    Classes that have not settled by then raise.
    """
    pins = staged(pins, "pins")
    nets = pins.select("side", "net").distinct()
    if seeds is not None:
        nets = nets.join(seeds, ["side", "net"], "left").select("side", "net", F.xxhash64(F.coalesce("name", F.lit(""))).alias("cls"))
    else:
        nets = nets.withColumn("cls", F.lit(0).cast("long"))
    nets, count, devices = staged(nets, "nets"), -1, None
    if max_rounds is None:
        max_rounds = pins.select("side", "dev_id").distinct().count() + nets.count() + 2
    for _ in range(max_rounds):
        with_net = pins.join(nets, ["side", "net"])
        devices = with_net.groupBy("side", "dev_id").agg(
            F.xxhash64(F.first("kind"), *_multiset()).alias("cls")
        )
        devices = staged(devices, "devices")
        seen = pins.join(devices, ["side", "dev_id"]).groupBy("side", "net").agg(F.xxhash64(*_multiset()).alias("around"))
        nets = staged(nets.join(seen, ["side", "net"]).select("side", "net", F.xxhash64("cls", "around").alias("cls")), "nets")
        now = devices.select("cls").union(nets.select("cls")).distinct().count()
        if now == count:
            break
        count = now
    else:
        raise RuntimeError("refinement did not settle")
    return devices, nets

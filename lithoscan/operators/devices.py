"""Devices from layouts: transistors by rules, resistors, diodes, capacitors and bipolar devices.

Shapes are boxes ``(id, layer, x0, y0, x1, y1)``; ``nets(id, net)`` gives the
net of each. A rule names layers, so rules are as many as a deck has and are
looped over on the driver; each is one plan of spatial joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import staged
from .spatial import candidates, overlap

BOX = ["x0", "y0", "x1", "y1"]


@dataclass(frozen=True)
class MosRule:
    """A gate over a channel under an implant; ``flavors``: (marker layer, hvt or lvt); ``well``: the layer whose net is the body."""

    name: str
    kind: str
    gate: int
    channel: int
    implant: int
    flavors: tuple[tuple[int, str], ...] = ()
    well: int | None = None


@dataclass(frozen=True)
class ResistorRule:
    name: str
    body: int
    marker: int
    terminal: int
    sheet: float = 0.0


@dataclass(frozen=True)
class DiodeRule:
    name: str
    anode: int
    cathode: int
    implant: int


@dataclass(frozen=True)
class CapacitorRule:
    """``per_um2``: attofarads a square micrometre of common area."""

    name: str
    top: int
    bottom: int
    marker: int | None = None
    per_um2: float = 0.0


@dataclass(frozen=True)
class BjtRule:
    name: str
    kind: str
    emitter: int
    base: int
    collector: int
    marker: int


def _area() -> Column:
    return (overlap("x") > 0) & (overlap("y") > 0)


def on(shapes: DataFrame, layer: int) -> DataFrame:
    return shapes.where(F.col("layer") == layer).select("id", *BOX)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, a, b, box``: the common box of each two shapes that overlap in area."""
    lo, hi = (lambda c: F.greatest(f"a_{c}", f"b_{c}").alias(c)), (lambda c: F.least(f"a_{c}", f"b_{c}").alias(c))
    hit = candidates(a, b).where(_area())
    return hit.select(F.xxhash64("a_id", "b_id").alias("id"), F.col("a_id").alias("a"), F.col("b_id").alias("b"), lo("x0"), lo("y0"), hi("x1"), hi("y1"))


def _over(found: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of ``found(id, box)`` that a mark overlaps in area, with the least such mark: ``id, mark``."""
    return candidates(found.select("id", *BOX), marks).where(_area()).groupBy(F.col("a_id").alias("id")).agg(F.min("b_id").alias("mark"))


def mos_rules(shapes: DataFrame, rules: Sequence[MosRule], bases: Sequence[int] = ()) -> DataFrame:
    """``poly_id, diff_id, status, rule, kind, flavor, well``: every crossing of a gate and a channel, and the rule that it meets.

    ``status``: ``ok``; ``base`` for a gate that a marker of a bipolar device
    (layers ``bases``) overlaps and no rule meets; ``no implant``;
    ``ambiguous rule``; ``ambiguous flavor``. A crossing that isn't ``ok`` has a
    null rule, and no device is made of it.
    """
    found = None
    for gate, channel in sorted({(r.gate, r.channel) for r in rules}):
        own = common(on(shapes, gate), on(shapes, channel)).withColumns({"gate": F.lit(gate), "channel": F.lit(channel)})
        found = own if found is None else found.union(own)
    found = staged(found, "crossings")
    matches = None
    for r in rules:
        own = found.where((F.col("gate") == r.gate) & (F.col("channel") == r.channel))
        own = own.join(_over(own, on(shapes, r.implant)).select("id"), "id", "left_semi")
        own = own.select("id", *BOX, F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"))
        flavors = F.array().cast("array<string>")
        for k, (layer, name) in enumerate(r.flavors):
            own = own.join(_over(own, on(shapes, layer)).select(F.col("id").alias(f"f{k}"), F.lit(name).alias(f"n{k}")), F.col("id") == F.col(f"f{k}"), "left")
            flavors = F.concat(flavors, F.array_compact(F.array(F.col(f"n{k}"))))
        own = own.withColumn("flavors", F.array_distinct(flavors))
        if r.well is not None:
            own = own.join(_over(own, on(shapes, r.well)).withColumnsRenamed({"id": "w", "mark": "well"}), F.col("id") == F.col("w"), "left")
        else:
            own = own.withColumn("well", F.lit(None).cast("long"))
        own = own.select("id", "rule", "kind", "flavors", "well")
        matches = own if matches is None else matches.union(own)
    by = matches.groupBy(F.col("id").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("flavors")).alias("most"), F.min_by(F.struct("rule", "kind", "flavors", "well"), "rule").alias("r"))
    marked = None
    for layer in bases:
        own = candidates(found.select(F.col("a").alias("id"), *BOX).join(shapes.select("id", *[F.col(c).alias(f"s{c}") for c in BOX]), "id").select("id", *[F.col(f"s{c}").alias(c) for c in BOX]).distinct(), on(shapes, layer)).where(_area())
        own = own.select(F.col("a_id").alias("base")).distinct()
        marked = own if marked is None else marked.union(own).distinct()
    all_ = found.join(by, F.col("id") == F.col("m"), "left")
    all_ = all_.join(marked, F.col("a") == F.col("base"), "left") if marked is not None else all_.withColumn("base", F.lit(None).cast("long"))
    status = (
        F.when(F.col("n").isNull() & F.col("base").isNotNull(), "base").when(F.col("n").isNull(), "no implant")
        .when(F.col("most") > 1, "ambiguous flavor").when(F.col("n") > 1, "ambiguous rule").otherwise("ok")
    )
    ok = F.col("status") == "ok"
    return all_.withColumn("status", status).select(
        F.col("a").alias("poly_id"), F.col("b").alias("diff_id"), "status", F.when(ok, F.col("r.rule")).alias("rule"), F.when(ok, F.col("r.kind")).alias("kind"),
        F.when(ok, F.coalesce(F.get("r.flavors", F.lit(0)), F.lit("standard"))).alias("flavor"), F.when(ok, F.col("r.well")).alias("well"),
    )


def diffusion(devices: DataFrame, channels: DataFrame, nets: DataFrame) -> DataFrame:
    """``devices(dev_id, s, d)`` with ``as_, ps, ad, pd``: the boxes' areas and perimeters of all channel shapes on the source's and the drain's net."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    by = channels.join(nets.select("id", "net"), "id").groupBy("net").agg(F.sum(w * h).cast("long").alias("area"), F.sum(2 * (w + h)).cast("long").alias("round"))
    by = staged(by, "diffusion")
    out = devices
    for pin, area, edge in (("s", "as_", "ps"), ("d", "ad", "pd")):
        own = by.select(F.col("net").alias(f"n_{pin}"), F.col("area").alias(area), F.col("round").alias(edge))
        out = out.join(own, F.col(pin) == F.col(f"n_{pin}"), "left").drop(f"n_{pin}")
    return out.fillna(0, ["as_", "ps", "ad", "pd"])


def resistors(shapes: DataFrame, nets: DataFrame, rules: Sequence[ResistorRule], gates: Sequence[int] = ()) -> DataFrame:
    """``rule, body, a, b, length, width, ohm``: marked bodies that no gate overlaps, between the nets of their two extreme terminals along the longer side."""
    out = None
    for r in rules:
        body = on(shapes, r.body)
        body = body.join(_over(body, on(shapes, r.marker)).select("id"), "id", "left_semi")
        for g in gates:
            body = body.join(_over(body, on(shapes, g)).select("id"), "id", "left_anti")
        hit = candidates(body, on(shapes, r.terminal)).where(_area()).join(nets.select(F.col("id").alias("tid"), "net"), F.col("b_id") == F.col("tid"))
        along_x = (F.col("a_x1") - F.col("a_x0")) >= (F.col("a_y1") - F.col("a_y0"))
        at = F.when(along_x, F.expr("(b_x0 + b_x1) div 2")).otherwise(F.expr("(b_y0 + b_y1) div 2"))
        hit = hit.withColumn("at", at)
        ends = hit.groupBy(F.col("a_id").alias("body"), *[F.col(f"a_{c}").alias(c) for c in BOX]).agg(
            F.count(F.lit(1)).alias("n"), F.min_by("net", F.struct("at", "b_id")).alias("a"), F.max_by("net", F.struct("at", "b_id")).alias("b")
        )
        w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        own = ends.where("n >= 2").select(F.lit(r.name).alias("rule"), "body", "a", "b", F.greatest(w, h).alias("length"), F.least(w, h).alias("width"))
        own = own.withColumn("ohm", F.when(F.col("width") > 0, F.lit(float(r.sheet)) * F.col("length") / F.col("width")).otherwise(0.0))
        out = own if out is None else out.union(own)
    return out


def diodes(shapes: DataFrame, nets: DataFrame, rules: Sequence[DiodeRule]) -> DataFrame:
    """``rule, anode, cathode, a, c, area, perimeter``: anodes over cathodes under an implant, with their nets and the common box's measures."""
    out = None
    for r in rules:
        pair = common(on(shapes, r.anode), on(shapes, r.cathode))
        pair = pair.join(_over(pair, on(shapes, r.implant)).select("id"), "id", "left_semi")
        own = _with_nets(pair, nets, "a", "c")
        w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        own = own.select(F.lit(r.name).alias("rule"), F.col("top").alias("anode"), F.col("bottom").alias("cathode"), "a", "c", (w * h).cast("long").alias("area"), (2 * (w + h)).cast("long").alias("perimeter"))
        out = own if out is None else out.union(own)
    return out


def _with_nets(pairs: DataFrame, nets: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs ``(a, b, box)`` with both shapes' nets as ``a`` and ``b``, and the shapes as ``top`` and ``bottom``; shapes without a net make no device."""
    na, nb = nets.select(F.col("id").alias("ia"), F.col("net").alias("na")), nets.select(F.col("id").alias("ib"), F.col("net").alias("nb"))
    t = pairs.withColumnsRenamed({"a": "top", "b": "bottom"}).join(na, F.col("top") == F.col("ia")).join(nb, F.col("bottom") == F.col("ib"))
    return t.withColumnsRenamed({"na": a, "nb": b})


def capacitors(shapes: DataFrame, nets: DataFrame, rules: Sequence[CapacitorRule], dbu_nm: float = 1.0) -> DataFrame:
    """``rule, top, bottom, a, b, area, perimeter, af``: plates that overlap, under a marker where the rule has one."""
    out = None
    for r in rules:
        pair = common(on(shapes, r.top), on(shapes, r.bottom))
        if r.marker is not None:
            pair = pair.join(_over(pair, on(shapes, r.marker)).select("id"), "id", "left_semi")
        w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        own = _with_nets(pair, nets, "a", "b").select(F.lit(r.name).alias("rule"), "top", "bottom", "a", "b", (w * h).cast("long").alias("area"), (2 * (w + h)).cast("long").alias("perimeter"))
        own = own.withColumn("af", F.col("area") * F.lit((dbu_nm / 1000.0) ** 2 * r.per_um2))
        out = own if out is None else out.union(own)
    return out


def bipolars(shapes: DataFrame, nets: DataFrame, rules: Sequence[BjtRule]) -> DataFrame:
    """``rule, kind, marker, emitter, base, collector``: nets of emitter over base over collector under a marker; one device a marker.

    The marker must cover some of the emitter within the base; a collector on
    the emitter's net is part of the emitter. Of several triples of a marker the
    one of the least shapes counts.
    """
    out = None
    net = lambda c: nets.select(F.col("id").alias(f"i_{c}"), F.col("net").alias(f"n_{c}"))
    for r in rules:
        eb = common(on(shapes, r.emitter), on(shapes, r.base))
        marked = eb.join(_over(eb, on(shapes, r.marker)), "id").select(F.col("a").alias("e"), F.col("b").alias("base"), "mark")
        bc = candidates(on(shapes, r.base), on(shapes, r.collector)).where(_area()).select(F.col("a_id").alias("bb"), F.col("b_id").alias("c"))
        t = marked.join(bc, F.col("base") == F.col("bb")).where("c <> e")
        for c in ("e", "base", "c"):
            t = t.join(net(c), F.col(c) == F.col(f"i_{c}"))
        first = t.where("n_c <> n_e").groupBy("mark").agg(F.min(F.struct("e", "base", "c", "n_e", "n_base", "n_c")).alias("t"))
        own = first.select(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.col("mark").alias("marker"), F.col("t.n_e").alias("emitter"), F.col("t.n_base").alias("base"), F.col("t.n_c").alias("collector"))
        out = own if out is None else out.union(own)
    return out


# --- layers derived by boxes -------------------------------------------------------


def box_and(layers: Sequence[DataFrame]) -> DataFrame:
    """Boxes of the first layer tightened, layer by layer, to the first box of each other layer that they meet; those that meet none, or keep no area, go."""
    out = layers[0].select("id", *BOX)
    for other in layers[1:]:
        first = candidates(out, other.select("id", *BOX)).groupBy(F.col("a_id").alias("id"), *[F.col(f"a_{c}").alias(c) for c in BOX]).agg(F.min(F.struct("b_id", *[f"b_{c}" for c in BOX])).alias("m"))
        low, high = (lambda c: F.greatest(F.col(c), F.col(f"m.b_{c}")).alias(c)), (lambda c: F.least(F.col(c), F.col(f"m.b_{c}")).alias(c))
        out = first.select("id", low("x0"), low("y0"), high("x1"), high("y1"))
    return out.where("x1 > x0 and y1 > y0")


def box_or(layers: Sequence[DataFrame]) -> DataFrame:
    """All boxes of the layers."""
    out = layers[0].select(*BOX)
    for other in layers[1:]:
        out = out.union(other.select(*BOX))
    return out


def box_subtract(base: DataFrame, minus: DataFrame) -> DataFrame:
    """What stays of each box of ``base`` outside ``minus``, as disjoint boxes ``id, x0, y0, x1, y1``."""
    from .derived import boolean

    own = base.select(F.col("id").alias("grp"), *BOX)
    met = candidates(base.select("id", *BOX), minus.select("id", *BOX)).where(_area()).select(F.col("a_id").alias("grp"), *[F.col(f"b_{c}").alias(c) for c in BOX])
    return boolean(own, met, "subtraction").withColumnRenamed("grp", "id")

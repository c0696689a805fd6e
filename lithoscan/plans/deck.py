"""Rule decks: strict JSON to rules, scalar expressions, and a checked run with a status for every rule."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drc, kernel_ops, lvs, polygons
from ..operators.drc import COLUMNS

Layers = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Context:
    """What rules may need beside layers' boxes: ``rings`` (layer: ``id, layer, ring``), the nets' nodes and gate areas, the
    layer pairs that cuts join, and the process and corner that are run."""

    rings: Layers = field(default_factory=dict)
    nets: DataFrame | None = None
    nodes: DataFrame | None = None
    gate_areas: DataFrame | None = None
    joins: DataFrame | None = None
    process: str | None = None
    corner: str | None = None


class Lacking(Exception):
    """A rule needs evidence that the run doesn't have."""


def _rects(f: Callable[..., DataFrame], *names: str, inputs: tuple[str, ...] = ("layer",)):
    return inputs, names, lambda layers, p, _: f(*[layers[p[i]] for i in inputs], *[p[n] for n in names])


def ring_edges(layers: Layers, name: str, context: Context) -> DataFrame:
    """A layer's edges: of its rings, or of its boxes where it has none."""
    if name in context.rings:
        return polygons.edges_of(context.rings[name])
    return polygons.edges_of(box_rings(layers[name]))


def box_rings(rects: DataFrame) -> DataFrame:
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return rects.select("id", "layer", F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1")).alias("ring"))


def _edges(f: Callable[..., DataFrame], *names: str, inputs: tuple[str, ...] = ("layer",)):
    return inputs, names, lambda layers, p, c: f(*[ring_edges(layers, p[i], c) for i in inputs], *[p[n] for n in names])


def _either(on_rects: Callable[..., DataFrame], on_edges: Callable[..., DataFrame], *names: str, inputs: tuple[str, ...] = ("layer",)):
    """By edges where a layer has rings, else by its boxes."""

    def build(layers: Layers, p: dict, c: Context) -> DataFrame:
        if any(p[i] in c.rings for i in inputs):
            return on_edges(*[ring_edges(layers, p[i], c) for i in inputs], *[p[n] for n in names])
        return on_rects(*[layers[p[i]] for i in inputs], *[p[n] for n in names])

    return inputs, names, build


def _rings(f: Callable[..., DataFrame], *names: str):
    def build(layers: Layers, p: dict, c: Context) -> DataFrame:
        own = c.rings[p["layer"]] if p["layer"] in c.rings else box_rings(layers[p["layer"]])
        return f(own, *[p[n] for n in names])

    return ("layer",), names, build


def _off_grid(edges: DataFrame, grid: int) -> DataFrame:
    return drc.off_grid(edges.select("id", "layer", F.col("x0").alias("x"), F.col("y0").alias("y")), grid)


def _antenna(layers: Layers, p: dict, c: Context) -> DataFrame:
    if c.nets is None or c.gate_areas is None:
        raise Lacking("connectivity")
    found = lvs.antenna(c.nets, c.gate_areas, p["metal"], p["ratio"])
    at = c.nets.groupBy("net").agg(F.min(F.struct("id", "x0", "y0")).alias("m"))
    return drc.violations(found.join(at, "net"), "antenna", F.lit(p["ratio"]) * 1000, F.col("milli"), F.col("m.x0"), F.col("m.y0"), F.lit(p["metal"]))


def _antenna_car(layers: Layers, p: dict, c: Context) -> DataFrame:
    if c.nodes is None or c.gate_areas is None or c.joins is None:
        raise Lacking("connectivity")
    found = lvs.antenna_stages(c.nodes, c.joins, c.gate_areas, p["metals"], p["base"], p["ratio"], p.get("diode"))
    on = found.join(c.nodes.select("id", "layer", "x0", "y0"), "id")
    return drc.violations(on, "antenna_car", F.lit(p["ratio"]) * 1000, F.col("milli"), "x0", "y0")


def _multi_patterning(layers: Layers, p: dict, c: Context) -> DataFrame:
    found = kernel_ops.multi_patterning(layers[p["layer"]], p["colors"], p["spacing"]).where("status <> 'coloured'")
    on = found.join(layers[p["layer"]], F.col("comp") == F.col("id"))
    return drc.violations(on, "multi_patterning", p["colors"], F.col("boxes"), "x0", "y0")


def _density(low: bool):
    def build(layers: Layers, p: dict, c: Context) -> DataFrame:
        limit = round(p["min" if low else "max"] * 1e6)
        return drc.density(layers[p["layer"]], p["window"], limit if low else None, None if low else limit, p.get("step"))

    return ("layer",), ("window", "min" if low else "max"), build


#: kind: (layer parameters, other parameters, plan)
KINDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], Callable[[Layers, dict, Context], DataFrame]]] = {
    "min_width": _either(drc.min_width_rect, polygons.min_width, "min"),
    "max_width": _rects(drc.max_width, "max"),
    "min_area": _rects(drc.min_area, "min"),
    "min_enclosed_area": _rings(polygons.min_enclosed_area, "min"),
    "cheesing": _rings(polygons.cheesing, "max"),
    "min_edge_length": _edges(drc.min_edge_length, "min"),
    "notch": _edges(polygons.notch, "min"),
    "off_grid": _edges(_off_grid, "grid"),
    "angle": _edges(drc.angle, "allowed"),
    "min_spacing": _either(drc.min_spacing, polygons.min_spacing, "min"),
    "min_spacing_diff": _either(drc.min_spacing_diff, polygons.min_spacing_diff, "min", inputs=("a", "b")),
    "corner_to_corner": _either(drc.corner_to_corner, polygons.corner_to_corner, "min"),
    "prl_spacing": _either(drc.prl_spacing, polygons.prl_spacing, "threshold", "spacing"),
    "wide_dependent_spacing": _either(drc.wide_spacing, polygons.wide_spacing, "width", "spacing"),
    "eol_spacing": _either(drc.eol_spacing, polygons.eol_spacing, "eol_width", "eol_spacing"),
    "min_enclosure": _either(drc.min_enclosure, polygons.min_enclosure, "min", inputs=("inner", "outer")),
    "well_enclosure": _either(drc.min_enclosure, polygons.min_enclosure, "min", inputs=("inner", "outer")),
    "asymmetric_enclosure": _either(drc.asymmetric_enclosure, polygons.asymmetric_enclosure, "min", inputs=("inner", "outer")),
    "min_extension": _rects(drc.min_extension, "min", inputs=("layer", "ref")),
    "overlap": _rects(drc.overlap_rect, "min", inputs=("a", "b")),
    "redundant_via": _rects(drc.redundant_via, "min_count", "within"),
    "via_array_spacing": _rects(drc.via_array, "threshold", "spacing"),
    "max_distance_to_tap": _rects(drc.max_distance_to_tap, "max", inputs=("diff", "tap")),
    "min_density": _density(True),
    "max_density": _density(False),
    "density_gradient": (("layer",), ("window", "max"), lambda la, p, _: drc.density_gradient(la[p["layer"]], p["window"], round(p["max"] * 1e6))),
    "cut_class": (("layer",), ("classes",), lambda la, p, _: cut_class(la[p["layer"]], [tuple(c) for c in p["classes"]])),
    "multi_patterning": (("layer",), ("colors", "spacing"), _multi_patterning),
    "antenna": ((), ("metal", "ratio"), _antenna),
    "antenna_car": ((), ("metals", "base", "ratio"), _antenna_car),
}
#: Parameters that a rule may have beside its own.
OPTIONAL = {"step", "diode", "when"}


def cut_class(cuts: DataFrame, classes: list[tuple[int, int]]) -> DataFrame:
    """Cuts whose sides, in any order, are none of the ``(width, length)`` classes; measured is the shorter side."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fits = F.lit(False)
    for a, b in classes:
        fits = fits | ((F.least(w, h) == min(a, b)) & (F.greatest(w, h) == max(a, b)))
    return drc.violations(cuts.where(~fits), "cut_class", 0, F.least(w, h), "x0", "y0")


# --- scalars ------------------------------------------------------------------------

# Nanometres a unit, and the power of length that it stands for.
UNITS = {"nm": (1.0, 1), "um": (1e3, 1), "mm": (1e6, 1), "nm2": (1.0, 2), "um2": (1e6, 2), "mm2": (1e12, 2), "ratio": (1.0, 0)}


@dataclass(frozen=True)
class Quantity:
    """A value in nanometres to a ``power``; plain numbers of a deck have None and go with any."""

    value: float
    power: int | None = None

    def same(self, other: Quantity) -> int | None:
        if self.power is not None and other.power is not None and self.power != other.power:
            raise ValueError(f"length to the power {self.power} and {other.power} don't add up")
        return self.power if self.power is not None else other.power


def _combined(op: str, args: list[Quantity]) -> Quantity:
    if op in ("add", "sub", "min", "max"):
        power = args[0].power
        for a in args[1:]:
            power = Quantity(0, power).same(a)
        values = [a.value for a in args]
        out = {"add": sum(values), "sub": values[0] - sum(values[1:]), "min": min(values), "max": max(values)}[op]
        return Quantity(out, power)
    if op not in ("mul", "div"):
        raise ValueError(f"no operation {op}")
    a, b = args
    power = None if a.power is None and b.power is None else (a.power or 0) + (b.power or 0) * (1 if op == "mul" else -1)
    return Quantity(a.value * b.value if op == "mul" else a.value / b.value, power)


@dataclass(frozen=True)
class RuleSpec:
    id: str
    kind: str
    params: Mapping[str, object]


@dataclass(frozen=True)
class Table:
    """Lookup by one input, clamped at both ends; stepwise (the point before; at a breakpoint, the one before it) or linear."""

    points: tuple[tuple[float, float], ...]
    linear: bool = False

    def at(self, x: float) -> float:
        xs = [p[0] for p in self.points]
        if x <= xs[0]:
            return self.points[0][1]
        if x >= xs[-1] and self.linear or x > xs[-1]:
            return self.points[-1][1]
        if not self.linear:
            return self.points[max(bisect_right(xs, x) - 1 - (x in xs), 0)][1]
        k = bisect_right(xs, x)
        (x0, y0), (x1, y1) = self.points[k - 1], self.points[k]
        return y0 + (y1 - y0) * (x - x0) / (x1 - x0)


@dataclass(frozen=True)
class Deck:
    rules: tuple[RuleSpec, ...]
    variables: Mapping[str, object] = field(default_factory=dict)
    tables: Mapping[str, Table] = field(default_factory=dict)

    def value(self, e: object, _open: tuple[str, ...] = ()) -> object:
        """A scalar of the deck, folded before planning: a literal, ``{"value", "unit"}``, ``{"var"}``, ``{"op", "args"}``, ``{"lookup", "at"}`` or
        ``{"if", "then", "else"}``; lists and others stay. Sums of different powers of length, and cycles of variables, raise."""
        found = self.quantity(e, _open)
        return found.value if isinstance(found, Quantity) else found

    def quantity(self, e: object, _open: tuple[str, ...] = ()) -> object:
        if isinstance(e, bool) or not isinstance(e, (int, float, dict)):
            return e
        if not isinstance(e, dict):
            return Quantity(e)
        if "unit" in e:
            if e["unit"] not in UNITS:
                raise ValueError(f"no unit {e['unit']}")
            scale, power = UNITS[e["unit"]]
            value = e["value"] * scale
            return Quantity(int(value) if float(value).is_integer() else value, power)
        if "var" in e:
            if e["var"] in _open:
                raise ValueError("cycle of variables: " + " -> ".join([*_open, e["var"]]))
            if e["var"] not in self.variables:
                raise ValueError(f"no variable {e['var']}")
            return self.quantity(self.variables[e["var"]], (*_open, e["var"]))
        if "lookup" in e:
            return Quantity(self.tables[e["lookup"]].at(self.value(e["at"], _open)))
        if "if" in e:
            return self.quantity(e["then"] if self.value(e["if"], _open) else e["else"], _open)
        if "op" not in e:
            return e
        return _combined(e["op"], [self.quantity(a, _open) for a in e["args"]])

    @staticmethod
    def from_json(text: str) -> Deck:
        """A deck from JSON; unknown kinds, missing and unknown parameters and repeated ids raise."""
        raw = json.loads(text)
        tables = {k: Table(tuple(map(tuple, v["points"])), v.get("linear", False)) for k, v in raw.get("tables", {}).items()}
        deck = Deck((), raw.get("variables", {}), tables)
        rules, seen = [], set()
        for r in raw["rules"]:
            kind = r["kind"]
            if kind not in KINDS:
                raise ValueError(f"no rule kind {kind}")
            inputs, names, _ = KINDS[kind]
            params = {k: v if k == "when" else deck.value(v) for k, v in r.items() if k not in ("id", "kind")}
            missing, unknown = {*inputs, *names} - params.keys(), params.keys() - {*inputs, *names} - OPTIONAL
            if missing or unknown:
                raise ValueError(f"rule {r.get('id', kind)}: missing {sorted(missing)}, unknown {sorted(unknown)}")
            if (name := r.get("id", kind)) in seen:
                raise ValueError(f"second rule {name}")
            seen.add(name)
            rules.append(RuleSpec(name, kind, params))
        return Deck(tuple(rules), deck.variables, tables)


#: Fields of a rule's ``when``, and what of the input each needs.
SELECTORS = {"region": ("x0", "y0", "x1", "y1"), "cells": ("cell",), "prefix": ("path",), "nets": ("net",), "min_volts": ("volts",), "domains": ("domain",)}


def selected(t: DataFrame, when: Mapping[str, object]) -> DataFrame:
    """The shapes that a rule's selector names: in a region, of cells, below a path, on nets, at least so many volts, of domains. Without the column it needs, :class:`Lacking`."""
    for key, value in when.items():
        if key in ("process", "corner"):
            continue
        if key not in SELECTORS:
            raise ValueError(f"no selector {key}")
        lost = [c for c in SELECTORS[key] if c not in t.columns]
        if lost:
            raise Lacking(f"column {lost[0]}")
        if key == "region":
            x0, y0, x1, y1 = value  # type: ignore[misc]
            t = t.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
        elif key == "prefix":
            t = t.where(F.col("path").startswith(str(value)))
        elif key == "min_volts":
            t = t.where(F.col("volts") >= value)
        else:
            t = t.where(F.col(SELECTORS[key][0]).isin(list(value)))  # type: ignore[call-overload]
    return t


def plan(rule: RuleSpec, layers: Layers, context: Context | None = None) -> DataFrame:
    """The rule's violations, lazily, under its id, over the shapes that its ``when`` selects."""
    context = context or Context()
    inputs, _, build = KINDS[rule.kind]
    when = dict(rule.params.get("when") or {})
    if when:
        on = {rule.params[i] for i in inputs}
        layers = {k: selected(t, when) if k in on else t for k, t in layers.items()}
    return build(layers, dict(rule.params), context).withColumn("rule_id", F.lit(rule.id)).select(*COLUMNS)


def geometry_faults(layers: Layers, context: Context | None = None) -> DataFrame | None:
    """What of the rings no rule is defined over: checked before any rule."""
    out = None
    for rings in (context or Context()).rings.values():
        own = polygons.validity(rings).select(*COLUMNS)
        out = own if out is None else out.unionByName(own)
    return out


def run(deck: Deck, layers: Layers, density: bool = True, context: Context | None = None) -> DataFrame:
    """All violations of a deck, each once, those of rings' validity first. ``density=False`` leaves those rules out of the plan."""
    rules = [r for r in deck.rules if density or "density" not in r.kind]
    faults = geometry_faults(layers, context)
    return drc.report([*([faults] if faults is not None else []), *[plan(r, layers, context) for r in rules]])


def run_checked(spark: SparkSession, deck: Deck, layers: Layers, context: Context | None = None) -> tuple[DataFrame, DataFrame]:
    """``(violations, statuses(rule_id, status, detail))`` of every rule. Eager.

    Clean, Violations; NotRun for an absent layer, missing connectivity or
    another process or corner; Error for a selector without evidence and any
    failure: a failure is never clean. Rings that span too much end the run
    before the first rule, each rule with an Error.
    """
    context = context or Context()
    found, rows = None, []
    faults = geometry_faults(layers, context)
    if faults is not None and faults.head(1):
        found = faults
        if faults.where("kind = 'geometry_capacity'").head(1):
            rows = [(r.id, "Error", "geometry beyond the rules' arithmetic") for r in deck.rules]
            return faults.dropDuplicates(), spark.createDataFrame(rows, "rule_id string, status string, detail string")
    for r in deck.rules:
        absent = [str(r.params[i]) for i in KINDS[r.kind][0] if r.params[i] not in layers and r.params[i] not in context.rings]
        if absent:
            rows.append((r.id, "NotRun", "no layer " + ", ".join(absent)))
            continue
        when = dict(r.params.get("when") or {})
        other = [k for k in ("process", "corner") if k in when and when[k] != getattr(context, k)]
        if other:
            rows.append((r.id, "NotRun", f"{other[0]} is {getattr(context, other[0])}"))
            continue
        try:
            own = plan(r, layers, context)
            hit = bool(own.head(1))
        except Lacking as e:
            rows.append((r.id, "Error" if when else "NotRun", f"no {e}"))
            continue
        except Exception as e:  # noqa: BLE001  a rule's failure is its status
            rows.append((r.id, "Error", str(e)[:300]))
            continue
        rows.append((r.id, "Violations" if hit else "Clean", ""))
        if hit:
            found = own if found is None else found.unionByName(own)
    statuses = spark.createDataFrame(rows, "rule_id string, status string, detail string")
    if found is None:
        found = spark.createDataFrame([], "rule_id string, kind string, layer string, measured long, `limit` long, x long, y long")
    return found.dropDuplicates(), statuses


def is_clean(statuses: DataFrame) -> bool:
    """At least one rule, and all Clean."""
    r = statuses.selectExpr("count(*) AS n", "coalesce(bool_and(status = 'Clean'), false) AS ok").first()
    return r["n"] > 0 and r["ok"]

"""Parasitics beyond closed formulas: RC graphs, the process stack, and the field solvers over layouts.

A field solution couples all conductors that are near, so nets are solved in
clusters: components of boxes within a reach of each other, one task each; what
is farther apart than the reach has no coupling in the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from . import pex
from .graph import labelled
from .spatial import candidates, overlap

#: What a layer without an entry in the stack has: thickness, gap below it (nm) and relative permittivity.
THICKNESS, GAP, PERMITTIVITY = 200.0, 100.0, 3.9
#: Most panels of one cluster; larger ones are reported, not solved.
PANELS = 20_000


@dataclass(frozen=True)
class Film:
    """A conducting layer of the stack: heights in nanometres."""

    layer: int
    bottom: float
    thickness: float
    permittivity: float = PERMITTIVITY

    @property
    def top(self) -> float:
        return self.bottom + self.thickness


def process_stack(layers: Sequence[int], given: Mapping[int, tuple[float, float]] | None = None, permittivity: float = PERMITTIVITY) -> dict[int, Film]:
    """The films of the layers, lowest first: ``given`` (bottom, thickness) by layer, the others on top of each other with the usual thickness and gap."""
    out, at = {}, GAP
    for layer in layers:
        bottom, thick = (given or {}).get(layer, (at, THICKNESS))
        out[layer] = Film(layer, bottom, thick, permittivity)
        at = bottom + thick + GAP
    return out


def film_distance(stack: Mapping[int, Film], a: int, b: int) -> float:
    """Dielectric between two layers, nanometres; 0 where they overlap in height."""
    x, y = stack[a], stack[b]
    return max(max(x.bottom, y.bottom) - min(x.top, y.top), 0.0)


def rc_graph(rects: DataFrame, parasitics: DataFrame, nets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)``: a node for each box with its ground capacitance, and edges ``kind, a, b, ohm, af``.

    Boxes of one net that touch are joined by half of each one's resistance, a
    cut by its own resistance to each box that it meets; couplings join boxes of
    different nets. So a net is one resistor network.
    """
    ground = parasitics.where("kind = 'ground_cap'").groupBy(F.col("poly_a").alias("g")).agg(F.sum("af").alias("af"))
    own = parasitics.where("kind in ('resistance', 'via_resistance')").groupBy(F.col("poly_a").alias("r")).agg(F.sum("ohm").alias("ohm"))
    nodes = rects.join(nets.select(F.col("id").alias("nid"), "net"), F.col("id") == F.col("nid"), "left").drop("nid")
    nodes = nodes.join(ground, F.col("id") == F.col("g"), "left").join(own, F.col("id") == F.col("r"), "left").select("id", "layer", "net", F.coalesce("af", F.lit(0.0)).alias("af"), F.coalesce("ohm", F.lit(0.0)).alias("ohm"), "x0", "y0", "x1", "y1")
    touch = candidates(nodes.select("id", "net", "layer", "ohm", "x0", "y0", "x1", "y1"), None, 0, ["net"])
    joined = touch.where((F.col("a_layer") == F.col("b_layer")) | ((overlap("x") > 0) & (overlap("y") > 0)))
    none = F.lit(None).cast("double")
    wires = joined.select(F.lit("resistance").alias("kind"), F.col("a_id").alias("a"), F.col("b_id").alias("b"), ((F.col("a_ohm") + F.col("b_ohm")) / 2).alias("ohm"), none.alias("af"))
    at = nodes.select("id", "net")
    pair = parasitics.where("kind in ('coupling_cap', 'interlayer_cap')")
    pair = pair.join(at.withColumnsRenamed({"id": "ia", "net": "na"}), F.col("poly_a") == F.col("ia")).join(at.withColumnsRenamed({"id": "ib", "net": "nb"}), F.col("poly_b") == F.col("ib")).where("na <> nb")
    caps = pair.groupBy(F.least("poly_a", "poly_b").alias("a"), F.greatest("poly_a", "poly_b").alias("b")).agg(F.sum("af").alias("af")).select(F.lit("coupling").alias("kind"), "a", "b", none.alias("ohm"), "af")
    return nodes.select("id", "layer", "net", "af"), wires.unionByName(caps)


def clusters(rects: DataFrame, reach: int) -> DataFrame:
    """``rects`` with ``cluster``: the least id of the boxes, of any layer, within ``reach`` of each other, directly or not."""
    near = candidates(rects, None, reach).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return labelled(rects, near, label="cluster")


def field_capacitance(rects: DataFrame, stack: Mapping[int, Film], reach: int, dbu_nm: float = 1.0, most_panels: int = PANELS, panel_nm: float = 200.0) -> DataFrame:
    """``cluster, a, b, af, status``: the Maxwell capacitances between nets ``rects(id, layer, box, net)`` of each cluster, by panels of their boxes' sides.

    ``af`` of a = b is a net's own, of others the mutual one, negative. Boxes of
    one net that share a side lose no panel; their inner panels carry no charge.
    A cluster of more than ``most_panels`` panels has one row, ``status`` ``capacity``.
    """
    films = dict(stack)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {n: k for k, n in enumerate(sorted(pdf["net"].unique()))}
        panels: list[np.ndarray] = []
        owner: list[int] = []
        for r in pdf.itertuples():
            film = films[int(r.layer)]
            nm = 1e-9
            lo, hi = (r.x0 * dbu_nm * nm, r.y0 * dbu_nm * nm, film.bottom * nm), (r.x1 * dbu_nm * nm, r.y1 * dbu_nm * nm, film.top * nm)
            own = fields.box_panels(lo, hi, panel_nm * nm)
            panels += own
            owner += [names[r.net]] * len(own)
            if len(panels) > most_panels:
                return pd.DataFrame([(int(pdf["cluster"].iloc[0]), None, None, None, "capacity")], columns=["cluster", "a", "b", "af", "status"])
        eps = films[int(pdf["layer"].iloc[0])].permittivity
        c = fields.capacitance(panels, owner, eps) * 1e18
        ids = list(names)
        rows = [(int(pdf["cluster"].iloc[0]), int(ids[i]), int(ids[j]), float(c[i, j]), "solved") for i in range(len(ids)) for j in range(i, len(ids))]
        return pd.DataFrame(rows, columns=["cluster", "a", "b", "af", "status"])

    known = clusters(rects.where(F.col("layer").isin(list(films))), reach)
    return known.select("cluster", "layer", "net", "x0", "y0", "x1", "y1").groupBy("cluster").applyInPandas(solve, "cluster long, a long, b long, af double, status string")


def field_inductance(segments: DataFrame, ports: DataFrame, frequencies: Sequence[float], nw: int = 1, nh: int = 1) -> DataFrame:
    """``net, port, other, hertz, ohm, henry`` of the conductors ``segments(net, a, b, x0..z1, width, height, sigma)`` (metres) between ``ports(net, port, a, b)``; each net by itself, each segment as ``nw`` by ``nh`` filaments."""
    every = list(frequencies)
    none = F.lit(None).cast("double")
    shape = ["x0", "y0", "z0", "x1", "y1", "z1", "width", "height", "sigma"]
    rows = segments.select("net", F.lit(None).cast("string").alias("port"), "a", "b", *shape).union(ports.select("net", F.col("port").cast("string"), "a", "b", *[none.alias(c) for c in shape]))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        net = int(pdf["net"].iloc[0])
        wires, ends = pdf[pdf["port"].isna()], pdf[pdf["port"].notna()].sort_values("port")
        at = {n: k for k, n in enumerate(sorted(set(pdf["a"]) | set(pdf["b"])))}
        branches, bars = [], []
        for r in wires.itertuples():
            whole = fields.bar((r.x0, r.y0, r.z0), (r.x1, r.y1, r.z1), r.width, r.height, r.sigma)
            for part in whole.filaments(nw, nh):
                branches.append((at[r.a], at[r.b]))
                bars.append(part)
        z = fields.port_impedance(len(at), branches, bars, [(at[r.a], at[r.b]) for r in ends.itertuples()], every)
        names = list(ends["port"])
        out = [(net, names[i], names[j], f, float(z[k, i, j].real), float(z[k, i, j].imag / (2 * np.pi * f)) if f else 0.0) for k, f in enumerate(every) for i in range(len(names)) for j in range(len(names))]
        return pd.DataFrame(out, columns=["net", "port", "other", "hertz", "ohm", "henry"])

    return rows.groupBy("net").applyInPandas(solve, "net long, port string, other string, hertz double, ohm double, henry double")


def extract(rects: DataFrame, layers: Sequence[pex.Layer], nets: DataFrame, method: str = "analytical", stack: Mapping[int, Film] | None = None, reach: int = 2000, dbu_nm: float = 1.0, checked: bool = True) -> DataFrame:
    """``net, ohm, ground_af, coupling_af`` by the deck's method: ``analytical`` formulas or the ``field`` solver.

    ``field`` takes resistances from the formulas and capacitances from the
    panels: a net's own less what it has to others is its ground capacitance. A
    method that isn't known, or a cluster beyond the capacity, raises where
    ``checked``, and else falls back to the formulas.
    """
    table = pex.layer_table(rects.sparkSession, list(layers))
    plain = pex.by_net(pex.extract(rects, table, dbu_nm), nets)
    if method == "analytical":
        return plain
    if method != "field" or stack is None:
        if checked:
            raise ValueError(f"no method {method}" if method != "field" else "the field solver needs a process stack")
        return plain
    on = rects.join(nets.select(F.col("id").alias("nid"), "net"), F.col("id") == F.col("nid")).drop("nid")
    solved = field_capacitance(on, stack, reach, dbu_nm)
    if solved.where("status <> 'solved'").head(1):
        if checked:
            raise ValueError("a cluster has more panels than the solver takes")
        return plain
    own = solved.where("a = b").select(F.col("a").alias("net"), F.col("af").alias("own"))
    mutual = solved.where("a <> b").select(F.explode(F.array("a", "b")).alias("net"), (-F.col("af")).alias("m"))
    caps = own.groupBy("net").agg(F.sum("own").alias("own")).join(mutual.groupBy("net").agg(F.sum("m").alias("coupling_af")), "net", "left").fillna(0.0, ["coupling_af"])
    return plain.select("net", "ohm").join(caps, "net", "left").select("net", "ohm", (F.coalesce("own", F.lit(0.0)) - F.coalesce("coupling_af", F.lit(0.0))).alias("ground_af"), F.coalesce("coupling_af", F.lit(0.0)).alias("coupling_af"))


def report(parasitics: DataFrame, rects: DataFrame) -> DataFrame:
    """``measure, value``: totals of a report: resistance, ground, coupling and interlayer capacitance, the coupling's share, coupled pairs, and shapes ten times longer than wide."""
    total = parasitics.agg(
        F.sum("ohm").alias("ohm"), *[F.sum(F.when(F.col("kind") == k, F.col("af"))).alias(k) for k in ("ground_cap", "coupling_cap", "interlayer_cap")],
        F.count_if(F.col("kind") == "coupling_cap").cast("double").alias("pairs"),
    )
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long = rects.agg(F.count_if(F.greatest(w, h) >= 10 * F.least(w, h)).cast("double").alias("slender"))
    both = total.crossJoin(F.broadcast(long))  # one row each
    caps = sum((F.coalesce(k, F.lit(0.0)) for k in ("coupling_cap", "interlayer_cap")), F.coalesce("ground_cap", F.lit(0.0)))
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.coalesce(F.col(k), F.lit(0.0)).alias("value")) for k in ("ohm", "ground_cap", "coupling_cap", "interlayer_cap", "pairs", "slender")], F.struct(F.lit("coupling_share").alias("measure"), F.when(caps > 0, F.coalesce("coupling_cap", F.lit(0.0)) / caps).otherwise(0.0).alias("value")))
    return both.select(F.explode(rows).alias("r")).select("r.measure", "r.value")

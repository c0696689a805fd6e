"""Operators whose verdict needs an algorithm per component: one Arrow group per component, never a whole layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import solvers
from .graph import connected_components
from .spatial import candidates, distance2


def _with_component(edges: DataFrame) -> DataFrame:
    """``edges(a, b, ...)`` with ``comp``."""
    roots = connected_components(edges.select("a", "b"))
    return edges.join(roots, edges["a"] == roots["node"]).drop("node").withColumnRenamed("root", "comp")


def conflict_edges(rects: DataFrame, spacing: int) -> DataFrame:
    d2 = distance2()
    return candidates(rects, None, spacing, ["layer"]).where((d2 > 0) & (d2 < spacing * spacing)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def multi_patterning(rects: DataFrame, colours: int, spacing: int, states: int = 1_000_000) -> DataFrame:
    """``comp, status, boxes``: each component of the conflict graph and whether so many masks can hold it."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
        status, _ = solvers.colour(edges, colours, states)
        return pd.DataFrame({"comp": [pdf["comp"].iloc[0]], "status": [status], "boxes": [len({n for e in edges for n in e})]})

    return _with_component(conflict_edges(rects, spacing)).groupBy("comp").applyInPandas(solve, "comp long, status string, boxes long")


def power_solve(edges: DataFrame, fixed: DataFrame, loads: DataFrame) -> DataFrame:
    """``id, volts`` of the resistor networks ``edges(a, b, ohm)``, each component solved by itself; one without a ``fixed(id, volts)`` node has null volts. ``loads(id, amps)`` are drawn."""
    on = _with_component(edges)
    nodes = on.select("comp", F.explode(F.array("a", "b")).alias("id")).distinct()
    at = nodes.join(fixed.withColumnRenamed("volts", "own"), "id", "left").join(loads, "id", "left")
    rows = on.select("comp", "a", "b", "ohm", F.lit(None).cast("double").alias("own"), F.lit(None).cast("double").alias("amps")).union(at.select("comp", F.col("id"), F.col("id"), F.lit(None).cast("double"), "own", "amps"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wires, points = pdf[pdf["ohm"].notna()], pdf[pdf["ohm"].isna()]
        own = {int(r.a): float(r.own) for r in points.itertuples() if not pd.isna(r.own)}
        amps = {int(r.a): float(r.amps) for r in points.itertuples() if not pd.isna(r.amps)}
        edges_ = [(int(r.a), int(r.b), float(r.ohm)) for r in wires.itertuples()]
        volts = solvers.solve_grid(edges_, own, amps) if own else {}
        ids = [int(v) for v in points["a"]]
        return pd.DataFrame({"id": ids, "volts": [volts.get(i) for i in ids]})

    return rows.groupBy("comp").applyInPandas(solve, "id long, volts double")


def p2p_resistance(edges: DataFrame, terminals: DataFrame, most: float) -> DataFrame:
    """``net, a, b, ohm``: the pair of terminals with the largest resistance between them, where over ``most``. ``edges(net, a, b, ohm)``, ``terminals(net, node)``."""
    none = F.lit(None).cast("double")
    rows = edges.select("net", "a", "b", "ohm").union(terminals.select("net", F.col("node"), F.col("node"), none))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wires = [(int(r.a), int(r.b), float(r.ohm)) for r in pdf[pdf["ohm"].notna()].itertuples()]
        ends = sorted({int(v) for v in pdf[pdf["ohm"].isna()]["a"]})
        pairs = [(solvers.effective_resistance(wires, x, y), -x, -y) for i, x in enumerate(ends) for y in ends[i + 1 :]]
        worst = max(pairs, default=None)
        rows_ = [] if worst is None or worst[0] <= most else [(pdf["net"].iloc[0], -worst[1], -worst[2], worst[0])]
        return pd.DataFrame(rows_, columns=["net", "a", "b", "ohm"])

    return rows.groupBy("net").applyInPandas(solve, "net long, a long, b long, ohm double")


def elmore_delays(edges: DataFrame, caps: DataFrame, roots: DataFrame) -> DataFrame:
    """``net, node, delay`` of the trees ``edges(net, a, b, ohm)`` with ``caps(net, node, farad)`` from ``roots(net, node)``."""
    none = F.lit(None).cast("double")
    rows = edges.select("net", "a", "b", "ohm", none.alias("c")).union(caps.select("net", "node", "node", none, "farad")).union(roots.select("net", "node", "node", none, none))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wires = [(int(r.a), int(r.b), float(r.ohm)) for r in pdf[pdf["ohm"].notna()].itertuples()]
        c = {int(r.a): float(r.c) for r in pdf[pdf["c"].notna()].itertuples()}
        root = int(pdf[pdf["ohm"].isna() & pdf["c"].isna()]["a"].iloc[0])
        d = solvers.elmore(wires, c, root)
        return pd.DataFrame({"net": pdf["net"].iloc[0], "node": list(d), "delay": list(d.values())})

    return rows.groupBy("net").applyInPandas(solve, "net long, node long, delay double")

"""Derived-layer, electrical and parasitic queries over the layout views, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..views import BRANCHES, CHANGES, DEVICES, RECTS, VIAS, spark_view
from . import derived, erc, lvs, pex
from .lvs_queries import _GATES, _N, NODES, _gates, _nets, _nodes

#: A large well around every twentieth box.
WELLS = f"SELECT id, 10 AS layer, x0 - 300 AS x0, y0 - 300 AS y0, x1 + 300 AS x1, y1 + 300 AS y1 FROM ({RECTS}) w WHERE id % 20 = 0"
LAYERS = [pex.Layer(0, 0.1, 25.0, 40.0, 100.0, 200.0), pex.Layer(1, 0.08, 15.0, 30.0, 80.0, 200.0, 10.0), pex.Layer(9, via_r=5.0)]
FAST = {"typical": {}, "slow": {0: {"rs": 0.13, "ck": 120.0}, 1: {"rs": 0.1, "ca": 18.0}}}


def _rects(s, d, n=None):
    r = spark_view(s, d, RECTS)
    return r if n is None else r.where(F.col("layer") == n)


def _wells(s, d):
    return spark_view(s, d, WELLS)


def _devices(s, d):
    return spark_view(s, d, DEVICES)


def _ab(s, d, margin=0):
    return derived.grouped(_rects(s, d, 0), _rects(s, d, 1), margin=margin)


def _region(op):
    def run(s, d):
        a, b = _ab(s, d)
        return derived.areas(derived.boolean(a, b, op))
    return run


def _grown(s, d):
    (a,) = derived.grouped(_rects(s, d, 0), margin=40)
    return derived.areas(derived.boolean(derived.grow(a, 20), a, "union"))


def _shrunk(s, d):
    (a,) = derived.grouped(_rects(s, d, 0))
    return derived.areas(derived.shrink(a, 20))


def _tree(s, d):
    a, b = _ab(s, d)
    node = derived.Node("outside", (derived.Node("union", ("A", "B")), derived.Node("inside", ("A", "B"))))
    return derived.areas(derived.compile_layer(node, {"A": a, "B": b}))


def _gate_nets(s, d):
    n = _nets(s, d)
    g = _gates(s, d)
    return n, n.join(g.select(F.col("poly_id").alias("id")).distinct(), "id").select("net"), n.join(g.select(F.col("diff_id").alias("id")).distinct(), "id").select("net")


def _erc(f):
    def run(s, d):
        n, gates, driven = _gate_nets(s, d)
        return f(s, d, n, gates, driven)
    return run


def _parasitics(s, d):
    return pex.extract(_nodes(s, d).where("layer in (0, 1, 9)"), pex.layer_table(s, LAYERS))


def _by_net(s, d):
    return pex.extract_by_net(_nets(s, d).where("layer in (0, 1, 9)"), pex.layer_table(s, LAYERS))


def _rounded(t, *cols):
    return t.withColumns({c: F.round(c, 6) for c in cols})


def _parts(s, d):
    return spark_view(s, d, BRANCHES).select(F.col("branch_id").alias("id"), (F.lit(0.9) + F.col("width") / 1000.0).alias("volts"), "temp_c")


def _stages(s, d):
    return spark_view(s, d, f"SELECT id % 97 AS net, layer AS stage, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS collector, 400000 AS gate FROM ({RECTS}) r GROUP BY id % 97, layer")


def _status(s, d):
    return erc.suite_status(spark_view(s, d, "SELECT CAST(n_nationkey AS STRING) AS check, CASE WHEN n_regionkey >= 0 THEN 'Clean' ELSE 'NotRun' END AS status FROM nation"), 25)


#: Devices on so few nets that N and P devices share both ends and the gate.
DENSE = "SELECT p_partkey AS dev_id, CASE WHEN p_partkey % 2 = 0 THEN 'nmos' ELSE 'pmos' END AS kind, 1000 + p_partkey % 7 AS g, p_partkey % 3 AS s, 10 + p_partkey % 5 AS d, 100 AS w, 20 AS l FROM part WHERE p_partkey > 11"


def _floating(s, d):
    """Gates on a layer of their own: only those that a channel's net is tied to by a box of layer 1 are driven."""
    n = lvs.nets(_nodes(s, d).where("layer in (1, 2, 3)"), s.createDataFrame([(1, 2), (1, 3)], "la int, lb int"))
    g = _gates(s, d)
    gate, channel = (n.join(g.select(F.col(c).alias("id")).distinct(), "id").select("net") for c in ("poly_id", "diff_id"))
    return erc.floating_gate(n, gate, channel, [2, 3])


QUERIES = {
    "derived_and": _region("intersection"),
    "derived_minus": _region("subtraction"),
    "derived_or": _region("union"),
    "derived_xor": _region("xor"),
    "derived_grow": _grown,
    "derived_shrink": _shrunk,
    "derived_tree": _tree,
    "derived_interacting": lambda s, d: derived.interacting(_rects(s, d, 0), _rects(s, d, 1)).select("id"),
    "derived_edges": lambda s, d: derived.edge_filter(_rects(s, d).select("id", "x0", "y0", "x1", F.col("y0").alias("y1")), "horizontal", 100, 150),
    "floating_gate": _floating,
    "floating_well": lambda s, d: erc.floating_well(_wells(s, d), _rects(s, d, 3), _rects(s, d, 1)),
    "missing_tie": lambda s, d: erc.missing_tie(_rects(s, d, 3), _rects(s, d, 0), 120),
    "multiple_drivers": lambda s, d: erc.multiple_drivers(_devices(s, d)),
    "supply_short": lambda s, d: erc.supply_short(spark_view(s, d, DENSE)),
    "tie_high_low": lambda s, d: erc.tie_high_low(_devices(s, d)),
    "soft_connection": lambda s, d: erc.soft_connection(_rects(s, d, 0), _wells(s, d), _rects(s, d, 1)),
    "unconnected_pin": _erc(lambda s, d, n, g, v: erc.unconnected_pin(n, g.union(v), [0, 1])),
    "esd_missing": _erc(lambda s, d, n, g, v: erc.esd_missing(n, g.union(v), [0, 1])),
    "hv_domain_crossing": _erc(lambda s, d, n, g, v: erc.hv_crossing(n, _wells(s, d), g.union(v), [0, 1])),
    "em_current_density": _erc(lambda s, d, n, g, v: erc.em_width(n, v.union(g), [0, 1], 100)),
    "antenna_cumulative": lambda s, d: erc.antenna_cumulative(_stages(s, d), 4000),
    "em_limits": lambda s, d: _rounded(erc.electromigration(spark_view(s, d, BRANCHES), 1500.0, blech=1_000_000.0), "density", "allowed"),
    "aging_lifetime": lambda s, d: _rounded(erc.lifetime(_parts(s, d), 100_000.0, 3.0, 0.7, 1.1, 378.15, 200_000.0), "hours"),
    "ir_drop_check": lambda s, d: erc.ir_drop(_parts(s, d).select("id", "volts"), 1.2, 0.1, 10.0, 0.05),
    "suite_status": _status,
    "pex_metrics": lambda s, d: _rounded(pex.metrics(_rects(s, d)).select("id", "area_um2", "perimeter_um", "len_um", "wid_um"), "area_um2", "perimeter_um", "len_um", "wid_um"),
    "pex_resistance": lambda s, d: _rounded(pex.resistance(_rects(s, d), pex.layer_table(s, LAYERS)).select("poly_a", "layer", "ohm"), "ohm"),
    "pex_via_resistance": lambda s, d: pex.via_resistance(spark_view(s, d, VIAS), pex.layer_table(s, LAYERS)).select("poly_a", "ohm"),
    "pex_area_cap": lambda s, d: _rounded(pex.ground_cap(_rects(s, d), pex.layer_table(s, LAYERS)).select("poly_a", "layer", "af"), "af"),
    "pex_coupling": lambda s, d: pex.coupling_cap(_rects(s, d, 0), pex.layer_table(s, LAYERS)).select("poly_a", "poly_b", F.floor(F.col("af") * 1e6 + 0.5).alias("micro_af")),
    "pex_interlayer": lambda s, d: _rounded(pex.interlayer_cap(_rects(s, d), pex.layer_table(s, LAYERS)).select("layer", "poly_a", "poly_b", "af"), "af"),
    "pex_by_net": lambda s, d: _rounded(_by_net(s, d), "ohm", "ground_af", "coupling_af"),
    "pex_totals": lambda s, d: _rounded(pex.totals(_parasitics(s, d)).select("kind", "n", F.coalesce("ohm", F.lit(0.0)).alias("ohm"), F.coalesce("af", F.lit(0.0)).alias("af")), "ohm", "af").withColumns({"ohm": F.round("ohm", 3), "af": F.round("af", 3)}),
    "pex_corners": lambda s, d: pex.totals(pex.corners(_rects(s, d), LAYERS, FAST, cutoff=500).withColumn("kind", F.concat_ws("/", "corner", "kind"))).select("kind", "n", F.round(F.coalesce("ohm", F.lit(0.0)), 3).alias("ohm"), F.round(F.coalesce("af", F.lit(0.0)), 3).alias("af")),
    "pex_pi_model": lambda s, d: _rounded(pex.pi_model(_by_net(s, d)), "c_near", "ohm", "c_far"),
    "pex_inductance": lambda s, d: _rounded(pex.metrics(_rects(s, d)).select("id", pex.wire_inductance(F.col("len_um"), F.col("wid_um"), F.lit(0.2)).alias("ph")), "ph"),
}

_R = f"WITH RECURSIVE r AS MATERIALIZED ({RECTS}), w AS ({WELLS}) "
_TOUCH = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_OVER = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


def _cells(layers: str, margin: int = 0, by: int = 0, shift: str = "id * 2 + layer") -> str:
    """Compressed cells of the components of layers 0 (and 1), with what covers each."""
    grown = f"x0 - {margin} <= b.x1 AND b.x0 - {margin} <= a.x1 AND a.y0 - {margin} <= b.y1 AND b.y0 - {margin} <= a.y1"
    return f"""k AS MATERIALIZED (SELECT {shift} AS node, layer, x0, y0, x1, y1 FROM r WHERE layer IN ({layers})),
t AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM k a JOIN k b ON a.node <> b.node AND a.{grown}),
reach AS (SELECT node, node AS other FROM k UNION SELECT reach.node, t.b FROM reach JOIN t ON reach.other = t.a),
g AS MATERIALIZED (SELECT node, min(other) AS grp FROM reach GROUP BY node),
c AS MATERIALIZED (SELECT g.grp, k.layer, x0 - {by} AS x0, y0 - {by} AS y0, x1 + {by} AS x1, y1 + {by} AS y1 FROM k JOIN g USING (node)),
xs AS (SELECT grp, x, lead(x) OVER (PARTITION BY grp ORDER BY x) AS nx FROM (SELECT grp, x0 AS x FROM c UNION SELECT grp, x1 FROM c) q),
ys AS (SELECT grp, y, lead(y) OVER (PARTITION BY grp ORDER BY y) AS ny FROM (SELECT grp, y0 AS y FROM c UNION SELECT grp, y1 FROM c) q),
ce AS (SELECT xs.grp, (nx - x) * (ny - y) AS size, EXISTS (SELECT 1 FROM c WHERE c.grp = xs.grp AND layer = 0 AND x0 <= x AND x1 >= nx AND y0 <= y AND y1 >= ny) AS ina,
  EXISTS (SELECT 1 FROM c WHERE c.grp = xs.grp AND layer = 1 AND x0 <= x AND x1 >= nx AND y0 <= y AND y1 >= ny) AS inb FROM xs JOIN ys USING (grp) WHERE nx IS NOT NULL AND ny IS NOT NULL)"""


def _area(where: str, cells: str = "") -> str:
    return f"{_R}, {cells or _cells('0, 1')} SELECT grp, CAST(sum(size) AS BIGINT) AS area FROM ce WHERE {where} GROUP BY grp"


_NETS = f"{_N}, {_GATES}, w AS ({WELLS}), gn AS (SELECT DISTINCT g.net FROM g JOIN gt ON g.id = gt.poly_id), dn AS (SELECT DISTINCT g.net FROM g JOIN gt ON g.id = gt.diff_id), dev AS (SELECT net FROM gn UNION SELECT net FROM dn), m AS (SELECT n.*, g.net FROM n JOIN g USING (id))"
_FIRST = "f AS (SELECT net, arg_min(x0, id) AS x0, arg_min(y0, id) AS y0 FROM {0} GROUP BY net)"


def _find(check: str, detail: str, x: str = "x0", y: str = "y0") -> str:
    return f"SELECT '{check}' AS \"check\", CAST({detail} AS VARCHAR) AS detail, CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y"


_DEV = f"d AS ({DEVICES})"
_PX = "VALUES (9, 0, 0, 0, 0, 1, 0), (0, 0.1, 25.0, 40.0, 100.0, 200.0, 0.0), (1, 0.08, 15.0, 30.0, 80.0, 200.0, 10.0)"
_MET = "q AS (SELECT *, (x1 - x0) / 1000.0 AS w, (y1 - y0) / 1000.0 AS h FROM {0})"
_P = f"p AS (SELECT * FROM ({_PX}) v(layer, rs, ca, cf, ck, gap, il))"


def _coupling(src: str, limit: str = "") -> str:
    ox, oy = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))", "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"
    run, apart = f"CASE WHEN {oy} > 0 THEN {oy} ELSE {ox} END", f"CASE WHEN {oy} > 0 THEN -{ox} ELSE -{oy} END"
    return f"SELECT a.layer, a.id AS poly_a, b.id AS poly_b, ck * (({run}) * 0.001::DOUBLE) * (gap / ({apart})) AS af FROM {src} a JOIN {src} b ON a.layer = b.layer AND a.id < b.id AND ({oy} > 0 OR {ox} > 0) AND ({run}) > 0 AND ({apart}) > 0 {limit.format(apart=apart)} JOIN p ON p.layer = a.layer"


def _inter(src: str) -> str:
    return f"SELECT a.layer || ':' || b.layer AS layer, a.id AS poly_a, b.id AS poly_b, CASE WHEN pa.il > 0 AND pb.il > 0 THEN (pa.il + pb.il) / 2 ELSE greatest(pa.il, pb.il) END * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 1000000.0 AS af FROM {src} a JOIN {src} b ON a.layer < b.layer AND {_OVER} JOIN p pa ON pa.layer = a.layer JOIN p pb ON pb.layer = b.layer WHERE greatest(pa.il, pb.il) > 0"


def _all(src: str, limit: str = "") -> str:
    return f"""SELECT 'resistance' AS kind, id AS poly_a, NULL AS poly_b, rs * greatest(w, h) / least(w, h) AS ohm, NULL AS af FROM q JOIN p USING (layer)
UNION ALL SELECT 'ground_cap', id, NULL, NULL, ca * w * h + cf * 2 * (w + h) FROM q JOIN p USING (layer)
UNION ALL SELECT 'coupling_cap', poly_a, poly_b, NULL, af FROM ({_coupling(src, limit)}) UNION ALL SELECT 'interlayer_cap', poly_a, poly_b, NULL, af FROM ({_inter('zz')})"""


_SRC = "z AS (SELECT * FROM n WHERE layer IN (0, 1)), zz AS (SELECT * FROM n WHERE layer IN (0, 1, 9))"
_ALL = f"al AS (SELECT * FROM ({_all('z')}) u UNION ALL SELECT 'via_resistance', id, NULL, 5.0, NULL FROM n WHERE layer = 9 UNION ALL SELECT 'ground_cap', id, NULL, NULL, 0.0 FROM n WHERE layer = 9)"
_PNET = f"{_N}, {_P}, {_SRC}, {_MET.format('z')}, {_ALL}, aw AS (SELECT al.*, ga.net AS na, gb.net AS nb FROM al JOIN g ga ON ga.id = poly_a LEFT JOIN g gb ON gb.id = poly_b), e AS (SELECT na AS net, * FROM aw WHERE poly_b IS NULL OR na <> nb UNION ALL SELECT nb AS net, * FROM aw WHERE poly_b IS NOT NULL AND na <> nb), pn AS (SELECT net, coalesce(sum(ohm), 0) AS ohm, coalesce(sum(CASE WHEN poly_b IS NULL THEN af END), 0) AS ground_af, coalesce(sum(CASE WHEN poly_b IS NOT NULL THEN af END), 0) AS coupling_af FROM e GROUP BY net)"
_B = f"b AS ({BRANCHES})"

ORACLES = {
    "derived_and": _area("ina AND inb"),
    "derived_minus": _area("ina AND NOT inb"),
    "derived_or": _area("ina OR inb"),
    "derived_xor": _area("ina <> inb"),
    "derived_tree": _area("ina <> inb"),
    "derived_grow": _area("ina", _cells("0", 40, 20, "id")),
    "derived_interacting": f"{_R}, k AS (SELECT * FROM r WHERE layer = 0), t AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.id <> b.id AND {_TOUCH}), reach AS (SELECT id, id AS other FROM k UNION SELECT reach.id, t.b FROM reach JOIN t ON reach.other = t.a), hit AS (SELECT DISTINCT a.id FROM k a JOIN r b ON b.layer = 1 AND {_OVER}) SELECT DISTINCT reach.id FROM reach JOIN hit ON hit.id = reach.other",
    "derived_edges": f"{_R} SELECT id, x0, y0, x1, y0 AS y1 FROM r WHERE x1 - x0 BETWEEN 100 AND 150",
    "floating_gate": f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM ({NODES}) z WHERE layer IN (1, 2, 3)), t AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND a.layer = b.layer AND {_TOUCH} UNION ALL SELECT a.id, b.id FROM n a JOIN n b ON {_OVER} AND ((a.layer = 1 AND b.layer IN (2, 3)) OR (b.layer = 1 AND a.layer IN (2, 3)))),
rc AS (SELECT id, id AS other FROM n UNION SELECT rc.id, t.b FROM rc JOIN t ON rc.other = t.a), g AS (SELECT id, min(other) AS net FROM rc GROUP BY id), {_GATES}, m AS (SELECT n.*, g.net FROM n JOIN g USING (id)), {_FIRST.format('m')}
{_find('floating_gate', 'net')} FROM f WHERE net IN (SELECT net FROM g JOIN gt ON g.id = gt.poly_id) AND net NOT IN (SELECT net FROM g JOIN gt ON g.id = gt.diff_id) AND net NOT IN (SELECT net FROM m WHERE layer NOT IN (2, 3))""",
    "floating_well": f"{_R}, td AS (SELECT DISTINCT a.* FROM r a JOIN r b ON a.layer = 3 AND b.layer = 1 AND {_TOUCH}) {_find('floating_well', 'a.id', 'a.x0', 'a.y0')} FROM w a WHERE NOT EXISTS (SELECT 1 FROM td b WHERE {_TOUCH})",
    "missing_tie": f"""{_R}, c AS (SELECT *, 0 AS k, x0 AS x, y0 AS y FROM r UNION ALL SELECT *, 1, x1, y0 FROM r UNION ALL SELECT *, 2, x1, y1 FROM r UNION ALL SELECT *, 3, x0, y1 FROM r),
f AS (SELECT a.id, a.k, a.x, a.y FROM c a WHERE a.layer = 3 AND (a.x1 - a.x0) * (a.y1 - a.y0) >= 14400 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.layer = 0 AND {_TOUCH} AND ((b.x0 + b.x1) // 2 - a.x) * ((b.x0 + b.x1) // 2 - a.x) + ((b.y0 + b.y1) // 2 - a.y) * ((b.y0 + b.y1) // 2 - a.y) <= 14400))
{_find('missing_tie', 'id', 'arg_min(x, k)', 'arg_min(y, k)')} FROM f GROUP BY id""",
    "multiple_drivers": f"WITH {_DEV} SELECT d AS net, count(DISTINCT g) AS gates FROM d WHERE d NOT IN (SELECT g FROM d) GROUP BY d HAVING count(DISTINCT g) > 1",
    "supply_short": f"WITH d AS ({DENSE}), e AS (SELECT dev_id, kind, g, s AS net FROM d UNION SELECT dev_id, kind, g, d FROM d), f AS (SELECT * FROM e WHERE net NOT IN (SELECT g FROM d)) SELECT a.dev_id AS n_dev, b.dev_id AS p_dev FROM f a JOIN f b ON a.kind = 'nmos' AND b.kind = 'pmos' AND a.g = b.g AND a.net = b.net GROUP BY ALL HAVING count(*) >= 2 ORDER BY 1, 2 LIMIT 1",
    "tie_high_low": f"WITH {_DEV} SELECT DISTINCT g AS net FROM d WHERE g IN (SELECT s FROM d) AND g NOT IN (SELECT d FROM d)",
    "soft_connection": f"{_R}, i AS (SELECT a.id AS pad, b.id AS well, a.x0, a.y0, a.x1, a.y1 FROM r a JOIN w b ON a.layer = 0 AND {_TOUCH}), o AS (SELECT a.id AS pad, b.id AS metal FROM r a JOIN r b ON a.layer = 0 AND b.layer = 1 AND {_TOUCH}) SELECT a.pad AS pa, b.pad AS pb, a.well FROM i a JOIN i b ON a.well = b.well AND a.pad < b.pad AND NOT ({_TOUCH}) WHERE NOT EXISTS (SELECT 1 FROM o u JOIN o v USING (metal) WHERE u.pad = a.pad AND v.pad = b.pad) ORDER BY 1, 2, 3 LIMIT 1",
    "unconnected_pin": f"{_NETS} {_find('unconnected_pin', 'id')} FROM m WHERE layer IN (0, 1) AND net NOT IN (SELECT net FROM dev)",
    "esd_missing": f"{_NETS}, bx AS (SELECT min(x0) AS lx, min(y0) AS ly, max(x1) AS hx, max(y1) AS hy FROM n), em AS (SELECT m.* FROM m, bx WHERE layer IN (0, 1) AND (x0 - lx <= 1 OR y0 - ly <= 1 OR hx - x1 <= 1 OR hy - y1 <= 1) AND net NOT IN (SELECT net FROM dev)), {_FIRST.format('em')} {_find('esd_missing', 'net')} FROM f",
    "hv_domain_crossing": f"""{_NETS}, mm AS (SELECT * FROM m WHERE layer IN (0, 1)), {_FIRST.format('mm')} {_find('hv_domain_crossing', 'net')} FROM f WHERE net NOT IN (SELECT net FROM dev)
AND net IN (SELECT a.net FROM mm a JOIN w b ON {_TOUCH}) AND net IN (SELECT a.net FROM mm a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1))""",
    "em_current_density": f"{_NETS} {_find('em_current_density', 'least(x1 - x0, y1 - y0)')} FROM m WHERE layer IN (0, 1) AND least(x1 - x0, y1 - y0) < 100 AND net IN (SELECT net FROM dev)",
    "antenna_cumulative": f"{_R}, st AS (SELECT id % 97 AS net, layer AS stage, sum((x1 - x0) * (y1 - y0)) AS c FROM r GROUP BY ALL), cu AS (SELECT net, stage, CAST(sum(c) OVER (PARTITION BY net ORDER BY stage) * 1000 // 400000 AS BIGINT) AS milli FROM st) SELECT * FROM cu WHERE milli > 4000",
    "em_limits": f"WITH {_B}, j AS (SELECT branch_id, abs(current_ua::DOUBLE / width) AS density, 1500.0 * exp(0.9 / (2.0 * {erc.BOLTZMANN}) * (1 / (temp_c + 273.15) - 1 / 378.15)) AS allowed, length FROM b) SELECT branch_id, round(density, 6) AS density, round(allowed, 6) AS allowed FROM j WHERE density > allowed AND density * length > 1000000",
    "aging_lifetime": f"WITH {_B}, h AS (SELECT branch_id AS id, 100000.0::DOUBLE * pow(1.1::DOUBLE / (0.9::DOUBLE + width / 1000.0::DOUBLE), 3.0) * exp(0.7::DOUBLE / {erc.BOLTZMANN} * (1 / (temp_c + 273.15::DOUBLE) - 1 / 378.15::DOUBLE)) AS hours FROM b) SELECT id, round(hours, 6) AS hours FROM h WHERE hours < 200000",
    "ir_drop_check": f"WITH {_B}, v AS (SELECT branch_id AS id, 0.9::DOUBLE + width / 1000.0::DOUBLE AS volts FROM b) SELECT id, 'ir_drop_volts' AS \"check\", round(volts, 6) AS volts FROM v WHERE 1.2::DOUBLE - volts > 0.1::DOUBLE UNION ALL SELECT id, 'ir_drop_percent', round(volts, 6) FROM v WHERE (1.2::DOUBLE - volts) * 100 > 12.0::DOUBLE UNION ALL SELECT id, 'overvoltage', round(volts, 6) FROM v WHERE volts - 1.2::DOUBLE > 0.05::DOUBLE",
    "suite_status": "SELECT count(*) = 25 AND bool_and(n_regionkey >= 0) AS all_clean FROM nation",
    "pex_metrics": f"{_R}, {_MET.format('r')} SELECT id, round(w * h, 6) AS area_um2, round(2 * (w + h), 6) AS perimeter_um, round(greatest(w, h), 6) AS len_um, round(least(w, h), 6) AS wid_um FROM q",
    "pex_resistance": f"{_R}, {_P}, {_MET.format('r')} SELECT id AS poly_a, CAST(layer AS VARCHAR) AS layer, round(rs * greatest(w, h) / least(w, h), 6) AS ohm FROM q JOIN p USING (layer)",
    "pex_via_resistance": f"SELECT id AS poly_a, 5.0::DOUBLE AS ohm FROM ({VIAS}) v",
    "pex_area_cap": f"{_R}, {_P}, {_MET.format('r')} SELECT id AS poly_a, CAST(layer AS VARCHAR) AS layer, round(ca * w * h + cf * 2 * (w + h), 6) AS af FROM q JOIN p USING (layer)",
    "pex_coupling": f"{_R}, {_P}, z AS (SELECT * FROM r WHERE layer = 0) SELECT poly_a, poly_b, CAST(floor(af * 1e6 + 0.5) AS BIGINT) AS micro_af FROM ({_coupling('z')})",
    "pex_interlayer": f"{_R}, {_P} SELECT layer, poly_a, poly_b, round(af, 6) AS af FROM ({_inter('r')})",
    "pex_by_net": f"{_PNET} SELECT net, round(ohm, 6) AS ohm, round(ground_af, 6) AS ground_af, round(coupling_af, 6) AS coupling_af FROM pn",
    "pex_pi_model": f"{_PNET} SELECT net, round((ground_af + coupling_af) / 2, 6) AS c_near, round(ohm, 6) AS ohm, round((ground_af + coupling_af) / 2, 6) AS c_far FROM pn",
    "pex_totals": f"{_PNET} SELECT kind, count(*) AS n, round(coalesce(sum(ohm), 0), 3) AS ohm, round(coalesce(sum(af), 0), 3) AS af FROM al GROUP BY kind",
    "pex_inductance": f"{_R}, {_MET.format('r')} SELECT id, round(0.2 * greatest(w, h) * (ln(2 * greatest(w, h) / (least(w, h) + 0.2)) + 0.5 + (least(w, h) + 0.2) / (3 * greatest(w, h))), 6) AS ph FROM q",
}
#: What a square of half side 20 fits in: cells between the sides, moved in and out by 20, that no uncovered cell of the framed grid meets when grown.
ORACLES["derived_shrink"] = f"""{_R}, {_cells("0", 0, 0, "id")}, lim AS (SELECT grp, min(x0) AS ax, max(x1) AS bx, min(y0) AS ay, max(y1) AS zy FROM c GROUP BY grp),
fx AS (SELECT grp, x, lead(x) OVER (PARTITION BY grp ORDER BY x) AS nx FROM (SELECT grp, x0 AS x FROM c UNION SELECT grp, x1 FROM c UNION SELECT grp, ax - 60 FROM lim UNION SELECT grp, bx + 60 FROM lim) q),
fy AS (SELECT grp, y, lead(y) OVER (PARTITION BY grp ORDER BY y) AS ny FROM (SELECT grp, y0 AS y FROM c UNION SELECT grp, y1 FROM c UNION SELECT grp, ay - 60 FROM lim UNION SELECT grp, zy + 60 FROM lim) q),
un AS MATERIALIZED (SELECT fx.grp, x, nx, y, ny FROM fx JOIN fy USING (grp) WHERE nx IS NOT NULL AND ny IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.grp = fx.grp AND x0 <= x AND x1 >= nx AND y0 <= y AND y1 >= ny)),
sx AS (SELECT grp, x, lead(x) OVER (PARTITION BY grp ORDER BY x) AS nx FROM (SELECT grp, x + 20 AS x FROM fx UNION SELECT grp, x - 20 FROM fx) q), sy AS (SELECT grp, y, lead(y) OVER (PARTITION BY grp ORDER BY y) AS ny FROM (SELECT grp, y + 20 AS y FROM fy UNION SELECT grp, y - 20 FROM fy) q)
SELECT sx.grp, CAST(sum((nx - x) * (ny - y)) AS BIGINT) AS area FROM sx JOIN sy USING (grp) JOIN lim USING (grp) WHERE x >= ax AND nx <= bx AND y >= ay AND ny <= zy
  AND NOT EXISTS (SELECT 1 FROM un WHERE un.grp = sx.grp AND un.x < sx.nx + 20 AND sx.x - 20 < un.nx AND un.y < sy.ny + 20 AND sy.y - 20 < un.ny) GROUP BY sx.grp"""


def _corner(name: str, params: str) -> str:
    """Totals of one corner, its layers' parameters in ``params``."""
    return f"""SELECT '{name}/' || kind AS kind, count(*) AS n, round(coalesce(sum(ohm), 0), 3) AS ohm, round(coalesce(sum(af), 0), 3) AS af FROM (WITH p AS (SELECT * FROM (VALUES {params}) v(layer, rs, ca, cf, ck, gap, il)),
  q AS (SELECT *, (x1 - x0) / 1000.0 AS w, (y1 - y0) / 1000.0 AS h FROM r), zz AS (SELECT * FROM r) {_all('r', 'AND {apart} <= 500')}) u GROUP BY kind"""


ORACLES["pex_corners"] = f"{_R} {_corner('typical', '(0, 0.1, 25.0, 40.0, 100.0, 200.0, 0.0), (1, 0.08, 15.0, 30.0, 80.0, 200.0, 10.0)')} UNION ALL {_corner('slow', '(0, 0.13, 25.0, 40.0, 120.0, 200.0, 0.0), (1, 0.1, 18.0, 30.0, 80.0, 200.0, 10.0)')}"
# decimal literals as doubles, as Spark has them
ORACLES = {k: v.replace("/ 1000.0", "/ 1000.0::DOUBLE").replace("::DOUBLE::DOUBLE", "::DOUBLE").replace("(0, 0.1,", "(0, 0.1::DOUBLE,").replace("(0, 0.13,", "(0, 0.13::DOUBLE,").replace("/ 1000000.0 AS", "* 1e-6 AS") for k, v in ORACLES.items()}

"""Queries of electrical evidence over the layout views, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..views import DEVICES, RECTS, VIAS, spark_view
from . import evidence
from .lvs_queries import _GATES, _N, _gate_areas, _gates, _nets
from .signoff_queries import WELLS, _find

#: Boxes with nets by remainder, so that the checks alone are compared.
NODES = f"SELECT id * 2 AS id, layer, x0, y0, x1, y1, id % 40 AS net FROM ({RECTS}) er UNION ALL SELECT id * 2 + 1, layer, x0, y0, x1, y1, id % 40 FROM ({VIAS}) ev"
NAMES = "SELECT n_nationkey AS net, CASE n_nationkey % 8 WHEN 0 THEN 'VDD' WHEN 1 THEN 'vss_io' WHEN 2 THEN 'VDDH' WHEN 3 THEN 'sub' WHEN 4 THEN 'vdd_core' WHEN 5 THEN 'agnd' WHEN 6 THEN 'VDDL' ELSE n_name END AS name FROM nation"
#: A device for each part, at a point of a die that grows with their number.
SITES = "SELECT p_partkey AS dev_id, CASE WHEN p_size % 2 = 0 THEN 'nmos' ELSE 'pmos' END AS kind, p_partkey * 7907 % die AS x, p_partkey * p_partkey * 17 % die AS y FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, (SELECT CAST(FLOOR(SQRT(COUNT(*))) AS BIGINT) * 9000 FROM part) AS die FROM part) p"
#: Clamps among the devices, by a class.
CLASSED = f"SELECT dev_id, CASE dev_id % 7 WHEN 0 THEN 'ESD_nmos' WHEN 1 THEN 'rc-clamp' ELSE 'core' END AS class, s % 40 AS s, d % 40 AS d, g % 40 AS g, CASE WHEN dev_id % 2 = 0 THEN dev_id % 40 END AS body FROM ({DEVICES}) dd"
#: Top metal: some boxes are large.
TOP = f"SELECT id, 8 AS layer, x0, y0, x1 + CASE WHEN id % 50 = 0 THEN 30000 ELSE 0 END AS x1, y1 + CASE WHEN id % 50 = 0 THEN 20000 ELSE 0 END AS y1, id % 40 AS net FROM ({RECTS}) tm"
#: Long shapes, of which some are hollow.
RINGS = f"SELECT id, layer, x0, y0, x1 + 800 * (id % 2) AS x1, y1, (x1 - x0 + 800 * (id % 2)) * (y1 - y0) // (1 + id % 3) AS area, id % 40 AS net FROM ({RECTS}) gr".replace(" // ", " DIV ")
NEEDS = "SELECT n_nationkey AS req, n_nationkey AS source, 1.0D + n_nationkey % 3 AS amps, 9.0D AS most_ohm, 4.0D + n_nationkey % 2 AS most_volts FROM nation"
LINKS = "SELECT s_nationkey AS a, (s_suppkey * 7 + 3) % 25 AS b, 1.0D + s_suppkey % 6 AS ohm, 1.0D + s_suppkey % 4 AS amps, 3.0D + s_suppkey % 3 AS volts, s_suppkey % 2 = 0 AS both FROM supplier WHERE s_nationkey <> (s_suppkey * 7 + 3) % 25"


def _view(sql):
    return lambda s, d: spark_view(s, d, sql)


_nodes, _names, _sites, _classed, _top = _view(NODES), _view(NAMES), _view(SITES), _view(CLASSED), _view(TOP)


def _wells(s, d):
    return spark_view(s, d, WELLS)


def _supplies(s, d):
    return evidence.supply_nets(_names(s, d), ["sub"])


def _gate_boxes(s, d):
    n = _nodes(s, d)
    from .devices import common, on

    found = common(on(n, 2), on(n, 3))
    return found.join(n.select(F.col("id").alias("gid"), "net"), F.col("a") == F.col("gid")).select("net", "x0", "y0", "x1", "y1")


def _rounded(t, *cols):
    return t.withColumns({c: F.round(c, 6) for c in cols})


def _egar(s, d):
    found = evidence.effective_antenna(_nodes(s, d), _gate_boxes(s, d), [(0, None), (1, 0.4)], 2.0, evidence.Diode(9, 0.5, 0.25))
    return _rounded(found, "gate_um2", "etched_um2", "diode_um2", "ratio")


def _paths(s, d):
    needs = _view(NEEDS)(s, d)
    targets = needs.select("req", F.explode(F.array(*[F.lit(k).cast("int") for k in (3, 11, 19)])).alias("node"))
    return evidence.discharge_paths(needs, _view(LINKS)(s, d).withColumn("b", F.col("b").cast("int")), targets)


QUERIES = {
    "antenna_electrical": lambda s, d: evidence.antenna_electrical(_nets(s, d), _gate_areas(s, d), [0, 1], 4.0),
    "union_metrics": lambda s, d: evidence.union_metrics(_nodes(s, d).where("layer = 0"), "net"),
    "antenna_effective": _egar,
    "supply_nets": _supplies,
    "supply_points": lambda s, d: evidence.supply_grid(_nodes(s, d), _supplies(s, d), [(9, (0, 1), 4.0)])[0],
    "supply_edges": lambda s, d: _rounded(evidence.supply_grid(_nodes(s, d), _supplies(s, d), [(9, (0, 1), 4.0)])[1], "ohm"),
    "esd_pads": lambda s, d: evidence.pads(_top(s, d), 8, _supplies(s, d)),
    "esd_clamps": lambda s, d: evidence.clamps(_classed(s, d), _supplies(s, d)),
    "esd_clamp_paths": lambda s, d: evidence.clamp_paths(evidence.pads(_top(s, d), 8, _supplies(s, d)), evidence.clamps(_classed(s, d), _supplies(s, d))),
    "guard_rings": lambda s, d: evidence.guard_rings(_view(RINGS)(s, d), _supplies(s, d).where("kind = 'ground'")),
    "discharge_paths": lambda s, d: _paths(s, d).select("req", "status", "ohm"),
    "latchup_checks": lambda s, d: evidence.latchup_checks(spark_view(s, d, "SELECT p_partkey AS site, CASE WHEN p_partkey % 9 > 0 THEN p_size * 0.1D END AS ring_width, p_partkey % 4 > 0 AS continuous, p_partkey % 5 > 0 AS biased, CAST(p_size AS DOUBLE) AS aggressor_um, 50.0D - p_size AS victim_um, p_size * 2.0D AS tap_um FROM part"), 1.0, 30.0, 40.0, 60.0),
    "well_taps": lambda s, d: evidence.well_taps(_wells(s, d), _nodes(s, d).where("layer = 3")),
    "untapped_wells": lambda s, d: evidence.untapped_wells(_wells(s, d), _nodes(s, d).where("layer = 3 and net < 6")).select("id"),
    "latchup_sites": lambda s, d: evidence.latchup_sites(_sites(s, d)),
}

_W = f"WITH RECURSIVE n AS MATERIALIZED ({NODES})"
_MEET = "{0}.x0 <= {1}.x1 AND {1}.x0 <= {0}.x1 AND {0}.y0 <= {1}.y1 AND {1}.y0 <= {0}.y1"


def _union(src: str, name: str) -> str:
    """Area and perimeter of the union of ``src(net, box)``: compressed cells, and the sides of covered cells beside uncovered ones."""
    return f"""{name}x AS (SELECT net, x, lead(x) OVER (PARTITION BY net ORDER BY x) AS nx, row_number() OVER (PARTITION BY net ORDER BY x) AS i FROM (SELECT net, x0 AS x FROM {src} UNION SELECT net, x1 FROM {src}) q),
{name}y AS (SELECT net, y, lead(y) OVER (PARTITION BY net ORDER BY y) AS ny, row_number() OVER (PARTITION BY net ORDER BY y) AS j FROM (SELECT net, y0 AS y FROM {src} UNION SELECT net, y1 FROM {src}) q),
{name}c AS MATERIALIZED (SELECT DISTINCT b.net, i, j, nx - x AS w, ny - y AS h FROM {src} b JOIN {name}x x ON x.net = b.net AND b.x0 <= x AND nx <= b.x1 JOIN {name}y y ON y.net = b.net AND b.y0 <= y AND ny <= b.y1),
{name}p AS (SELECT c.net, w, h, (SELECT count(*) FROM {name}c d WHERE d.net = c.net AND d.j = c.j AND abs(d.i - c.i) = 1) AS beside, (SELECT count(*) FROM {name}c d WHERE d.net = c.net AND d.i = c.i AND abs(d.j - c.j) = 1) AS above FROM {name}c c),
{name} AS MATERIALIZED (SELECT net, CAST(sum(w * h) AS BIGINT) AS area, CAST(sum(h * (2 - beside) + w * (2 - above)) AS BIGINT) AS perimeter FROM {name}p GROUP BY net)"""


_SUP = f"nm AS ({NAMES}), u AS (SELECT net, name, upper(name) AS n FROM nm), sp AS (SELECT net, name, CASE WHEN n IN ('VSS', 'GND', 'VGND', 'GROUND', 'DGND', 'AGND') OR starts_with(n, 'VSS') THEN 'ground' WHEN starts_with(n, 'VDD') OR n IN ('VPWR', 'VCC') THEN 'power' WHEN name = 'sub' THEN 'ground' END AS kind, n FROM u), sup AS (SELECT net, name, kind, CASE WHEN kind = 'ground' THEN 0.0::DOUBLE WHEN n = 'VDDH' THEN 3.3::DOUBLE WHEN n = 'VDDL' THEN 0.9::DOUBLE ELSE 1.8::DOUBLE END AS volts FROM sp WHERE kind IS NOT NULL)"
_PADS = f"t AS ({TOP}), ar AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (ORDER BY (x1 - x0) * (y1 - y0)) - 1 AS k, count(*) OVER () AS n FROM t), md AS (SELECT area AS median FROM ar WHERE k = n // 2), pd AS (SELECT ar.id, ar.net, x0, y0, x1, y1, coalesce(kind, 'unknown') AS direction FROM ar JOIN md ON area >= median * 100 LEFT JOIN sup USING (net))"
_CLAMPS = f"cl AS (SELECT * FROM ({CLASSED}) q WHERE lower(class) LIKE '%esd%' OR lower(class) LIKE '%clamp%'), pn AS (SELECT dev_id, 0 AS k, s AS net FROM cl UNION ALL SELECT dev_id, 1, d FROM cl UNION ALL SELECT dev_id, 2, g FROM cl UNION ALL SELECT dev_id, 3, body FROM cl WHERE body IS NOT NULL), pr AS (SELECT dev_id, arg_min(pn.net, k) FILTER (sup.net IS NULL) AS off_, arg_min(pn.net, k) FILTER (sup.net IS NOT NULL) AS on_ FROM pn LEFT JOIN sup USING (net) GROUP BY dev_id), cp AS (SELECT dev_id, coalesce(off_, s) AS pad_net, coalesce(on_, d) AS rail_net FROM cl JOIN pr USING (dev_id))"
_DUCK = lambda q: q.replace("0D", "0::DOUBLE").replace("1D", "1::DOUBLE").replace(" DIV ", " // ")

ORACLES = {
    "antenna_electrical": f"{_N}, {_GATES}, f AS (SELECT net, sum(CASE WHEN layer IN (0, 1) THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS metal, sum(coalesce(gate, 0)) AS gate, arg_min(x0, id) AS x0, arg_min(y0, id) AS y0 FROM n JOIN g USING (id) LEFT JOIN ga USING (id) GROUP BY net) {_find('antenna_electrical', 'net')} FROM f WHERE gate > 0 AND metal > 4.0 * gate",
    "union_metrics": f"{_W}, m0 AS MATERIALIZED (SELECT * FROM n WHERE layer = 0), {_union('m0', 'ua')} SELECT * FROM ua",
    "antenna_effective": f"""{_W}, m0 AS (SELECT * FROM n WHERE layer = 0), m1 AS (SELECT * FROM n WHERE layer = 1), m9 AS (SELECT * FROM n WHERE layer = 9),
gt AS (SELECT a.net, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM n a JOIN n b ON a.layer = 2 AND b.layer = 3 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
{_union('m0', 'ua')}, {_union('m1', 'ub')}, {_union('m9', 'uc')}, {_union('gt', 'ug')},
v AS (SELECT ug.net, ug.area * 0.001::DOUBLE * 0.001::DOUBLE AS gate, coalesce(ua.area, 0) * 0.001::DOUBLE * 0.001::DOUBLE + coalesce(ub.perimeter, 0) * 0.001::DOUBLE * 0.4::DOUBLE AS etched, coalesce(uc.area, 0) * 0.001::DOUBLE * 0.001::DOUBLE AS diode FROM ug LEFT JOIN ua USING (net) LEFT JOIN ub USING (net) LEFT JOIN uc USING (net)),
r AS (SELECT *, greatest(etched / gate - CASE WHEN diode > 0 THEN diode * 0.5::DOUBLE + 0.25::DOUBLE ELSE 0.0::DOUBLE END, 0) AS ratio FROM v)
SELECT net, round(gate, 6) AS gate_um2, round(etched, 6) AS etched_um2, round(diode, 6) AS diode_um2, round(ratio, 6) AS ratio, FALSE AS waived, ratio > 2.0 AS violates FROM r""",
    "supply_nets": f"WITH {_SUP} SELECT * FROM sup",
    "supply_points": f"{_W}, {_SUP}, f AS (SELECT net, min(id) AS first FROM n GROUP BY net) SELECT n.id, n.net, (x0 + x1) // 2 AS x, (y0 + y1) // 2 AS y, volts, id = first AS fixed FROM n JOIN sup USING (net) JOIN f USING (net)",
    "supply_edges": f"{_W}, {_SUP}, h AS (SELECT c.id AS cut, b.id AS b FROM n c JOIN n b ON c.layer = 9 AND b.layer IN (0, 1) AND {_MEET.format('c', 'b')} JOIN sup ON sup.net = b.net) SELECT p.b AS a, q.b AS b, round(4.0::DOUBLE / count(*), 6) AS ohm FROM h p JOIN h q ON p.cut = q.cut AND p.b < q.b GROUP BY p.b, q.b",
    "esd_pads": f"WITH {_SUP}, {_PADS} SELECT * FROM pd",
    "esd_clamps": f"WITH {_SUP}, {_CLAMPS} SELECT * FROM cp",
    "esd_clamp_paths": f"WITH {_SUP}, {_PADS}, {_CLAMPS} SELECT pd.id AS pad, pd.net, dev_id, rail_net FROM pd JOIN cp ON pad_net = pd.net WHERE direction = 'unknown'",
    "guard_rings": f"WITH {_SUP}, r AS ({_DUCK(RINGS)}) SELECT id, layer, least(x1 - x0, y1 - y0) AS width, net IN (SELECT net FROM sup WHERE kind = 'ground') AS biased FROM r WHERE 4 * (x1 - x0 + y1 - y0) * (x1 - x0 + y1 - y0) >= 50 * greatest(area, 1)",
    "discharge_paths": f"""WITH RECURSIVE nd AS ({_DUCK(NEEDS)}), l AS ({_DUCK(LINKS).replace(" AS both ", chr(32) + "AS two ")}), w AS (SELECT a, b, ohm, amps, volts FROM l UNION ALL SELECT b, a, ohm, amps, volts FROM l WHERE two),
ok AS MATERIALIZED (SELECT req, a, b, min(ohm) AS ohm FROM nd JOIN w ON w.amps >= nd.amps AND w.volts <= nd.most_volts GROUP BY ALL),
go AS (SELECT req, source AS node, 0.0::DOUBLE AS ohm FROM nd UNION SELECT go.req, ok.b, go.ohm + ok.ohm FROM go JOIN ok ON ok.req = go.req AND ok.a = go.node WHERE go.ohm + ok.ohm <= 60),
f AS (SELECT go.req, min(go.ohm) AS ohm FROM go JOIN nd USING (req) WHERE node IN (3, 11, 19) AND node <> source GROUP BY go.req)
SELECT nd.req, CASE WHEN f.ohm IS NULL THEN 'no path' WHEN f.ohm > most_ohm THEN 'too much resistance' ELSE 'ok' END AS status, f.ohm FROM nd LEFT JOIN f USING (req)""",
    "latchup_checks": """WITH p AS (SELECT p_partkey AS site, CASE WHEN p_partkey % 9 > 0 THEN p_size * 0.1::DOUBLE END AS w, p_partkey, p_size FROM part) SELECT site, 'no ring' AS "check" FROM p WHERE w IS NULL UNION ALL SELECT site, 'narrow ring' FROM p WHERE w < 1.0 UNION ALL SELECT site, 'broken ring' FROM p WHERE p_partkey % 4 = 0 UNION ALL SELECT site, 'unbiased ring' FROM p WHERE p_partkey % 5 = 0
UNION ALL SELECT site, 'aggressor too far' FROM p WHERE p_size > 30 UNION ALL SELECT site, 'victim too far' FROM p WHERE 50 - p_size > 40 UNION ALL SELECT site, 'tap too far' FROM p WHERE p_size * 2 > 60""",
    "well_taps": f"{_W}, w AS ({WELLS}), t AS (SELECT w.id AS well, n.id AS tap, n.net, (n.x0 + n.x1) // 2 AS x, (n.y0 + n.y1) // 2 AS y, w.x0 AS wx0, w.y0 AS wy0, w.x1 AS wx1, w.y1 AS wy1 FROM w JOIN n ON n.layer = 3 AND {_MEET.format('w', 'n')}) SELECT well, tap, net, x, y, least(greatest(least(x - wx0, wx1 - x), 0), greatest(least(y - wy0, wy1 - y), 0)) AS edge_nm FROM t",
    "untapped_wells": f"{_W}, w AS ({WELLS}) SELECT id FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.layer = 3 AND n.net < 6 AND {_MEET.format('w', 'n')})",
    "latchup_sites": f"WITH s AS ({SITES}), p AS (SELECT a.dev_id AS n_dev, b.dev_id AS p_dev, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM s a JOIN s b ON a.kind = 'nmos' AND b.kind = 'pmos') SELECT n_dev, p_dev, CAST(floor(d) AS BIGINT) AS distance_nm, CASE WHEN d < 5000 THEN 'High' WHEN d < 20000 THEN 'Medium' ELSE 'Low' END AS severity FROM p WHERE d <= 50000",
}

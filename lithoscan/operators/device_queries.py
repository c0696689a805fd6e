"""Queries of device recognition over the layout views, each with the SQL it is held against.

Layers 0 to 3 are the views' boxes, 9 their cuts and 10 wells; the net of a
shape is a remainder of its id, so that the recognition alone is compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..views import DEVICES, RECTS, VIAS, spark_view
from . import devices
from .signoff_queries import WELLS

#: Ids of boxes, cuts and wells don't meet.
SHAPES = f"SELECT id * 3 AS id, layer, x0, y0, x1, y1 FROM ({RECTS}) sr UNION ALL SELECT id * 3 + 1, layer, x0, y0, x1, y1 FROM ({VIAS}) sv UNION ALL SELECT id * 3 + 2, layer, x0, y0, x1, y1 FROM ({WELLS}) sw"
RULES = (devices.MosRule("n", "nmos", 2, 3, 0, ((1, "lvt"), (9, "hvt"))), devices.MosRule("p", "pmos", 2, 3, 10, (), 10))


def _shapes(s, d):
    return spark_view(s, d, SHAPES)


def _nets(s, d):
    return _shapes(s, d).select("id", (F.col("id") % 50).alias("net"))


QUERIES = {
    "mos_rules": lambda s, d: devices.mos_rules(_shapes(s, d), RULES, [9]),
    "diffusion": lambda s, d: devices.diffusion(spark_view(s, d, DEVICES).select("dev_id", (F.col("s") % 50).alias("s"), (F.col("d") % 50).alias("d")), devices.on(_shapes(s, d), 3), _nets(s, d)),
    "resistors": lambda s, d: devices.resistors(_shapes(s, d), _nets(s, d), [devices.ResistorRule("r", 0, 10, 1, 2.0)], [2]),
    "diodes": lambda s, d: devices.diodes(_shapes(s, d), _nets(s, d), [devices.DiodeRule("d", 0, 1, 10)]),
    "capacitors": lambda s, d: devices.capacitors(_shapes(s, d), _nets(s, d), [devices.CapacitorRule("c", 0, 1, 9, 2.0)]),
    "bipolars": lambda s, d: devices.bipolars(_shapes(s, d), _nets(s, d), [devices.BjtRule("q", "npn", 0, 1, 3, 10)]),
    "box_and": lambda s, d: devices.box_and([devices.on(_shapes(s, d), 0), devices.on(_shapes(s, d), 1), devices.on(_shapes(s, d), 2)]),
    "box_or": lambda s, d: devices.box_or([devices.on(_shapes(s, d), 0), devices.on(_shapes(s, d), 9)]),
    "box_subtract": lambda s, d: devices.box_subtract(devices.on(_shapes(s, d), 0), devices.on(_shapes(s, d), 1)).groupBy("id").agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).cast("long").alias("area")),
}

_S = f"WITH s AS MATERIALIZED ({SHAPES})"
_OV = "{0}.x0 < {1}.x1 AND {1}.x0 < {0}.x1 AND {0}.y0 < {1}.y1 AND {1}.y0 < {0}.y1"


def _common(la: int, lb: int, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.id AS a, b.id AS b, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM s a JOIN s b ON a.layer = {la} AND b.layer = {lb} AND {_OV.format('a', 'b')})"


def _marks(of: str, layer: int, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT k.a, k.b, min(m.id) AS mark FROM {of} k JOIN s m ON m.layer = {layer} AND {_OV.format('k', 'm')} GROUP BY k.a, k.b)"


ORACLES = {
    "mos_rules": f"""{_S}, {_common(2, 3, 'g')}, {_marks('g', 0, 'n')}, {_marks('g', 10, 'p')}, {_marks('g', 1, 'l')}, {_marks('g', 9, 'h')}, bs AS (SELECT DISTINCT a.id FROM s a JOIN s b ON a.layer = 2 AND b.layer = 9 AND {_OV.format('a', 'b')}),
t AS (SELECT g.a AS poly_id, g.b AS diff_id, n.mark IS NOT NULL AS isn, p.mark IS NOT NULL AS isp, p.mark AS w, l.mark IS NOT NULL AS lvt, h.mark IS NOT NULL AS hvt, g.a IN (SELECT id FROM bs) AS base
  FROM g LEFT JOIN n USING (a, b) LEFT JOIN p USING (a, b) LEFT JOIN l USING (a, b) LEFT JOIN h USING (a, b)),
u AS (SELECT *, CASE WHEN NOT isn AND NOT isp THEN CASE WHEN base THEN 'base' ELSE 'no implant' END WHEN isn AND lvt AND hvt THEN 'ambiguous flavor' WHEN isn AND isp THEN 'ambiguous rule' ELSE 'ok' END AS status FROM t)
SELECT poly_id, diff_id, status, CASE WHEN status = 'ok' THEN CASE WHEN isn THEN 'n' ELSE 'p' END END AS rule, CASE WHEN status = 'ok' THEN CASE WHEN isn THEN 'nmos' ELSE 'pmos' END END AS kind,
  CASE WHEN status = 'ok' THEN CASE WHEN isn AND lvt THEN 'lvt' WHEN isn AND hvt THEN 'hvt' ELSE 'standard' END END AS flavor, CASE WHEN status = 'ok' AND NOT isn THEN w END AS well FROM u""",
    "diffusion": f"""{_S}, f AS (SELECT id % 50 AS net, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS a, CAST(sum(2 * (x1 - x0 + y1 - y0)) AS BIGINT) AS p FROM s WHERE layer = 3 GROUP BY id % 50)
SELECT dev_id, v.s % 50 AS s, v.d % 50 AS d, coalesce(fs.a, 0) AS as_, coalesce(fs.p, 0) AS ps, coalesce(fd.a, 0) AS ad, coalesce(fd.p, 0) AS pd FROM ({DEVICES}) v LEFT JOIN f fs ON fs.net = v.s % 50 LEFT JOIN f fd ON fd.net = v.d % 50""",
    "resistors": f"""{_S}, bo AS (SELECT * FROM s WHERE layer = 0 AND EXISTS (SELECT 1 FROM s m WHERE m.layer = 10 AND {_OV.format('s', 'm')}) AND NOT EXISTS (SELECT 1 FROM s m WHERE m.layer = 2 AND {_OV.format('s', 'm')})),
t AS (SELECT bo.id, bo.x1 - bo.x0 AS w, bo.y1 - bo.y0 AS h, m.id AS tid, m.id % 50 AS net, CASE WHEN bo.x1 - bo.x0 >= bo.y1 - bo.y0 THEN (m.x0 + m.x1) // 2 ELSE (m.y0 + m.y1) // 2 END AS pos FROM bo JOIN s m ON m.layer = 1 AND {_OV.format('bo', 'm')})
SELECT 'r' AS rule, id AS body, arg_min(net, (pos, tid)) AS a, arg_max(net, (pos, tid)) AS b, greatest(w, h) AS length, least(w, h) AS width, 2.0::DOUBLE * greatest(w, h) / least(w, h) AS ohm FROM t GROUP BY id, w, h HAVING count(*) >= 2""",
    "diodes": f"{_S}, {_common(0, 1, 'g')}, {_marks('g', 10, 'm')} SELECT 'd' AS rule, g.a AS anode, g.b AS cathode, g.a % 50 AS a, g.b % 50 AS c, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter FROM g JOIN m USING (a, b)",
    "capacitors": f"{_S}, {_common(0, 1, 'g')}, {_marks('g', 9, 'm')} SELECT 'c' AS rule, g.a AS top, g.b AS bottom, g.a % 50 AS a, g.b % 50 AS b, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter, (x1 - x0) * (y1 - y0) * 2e-6::DOUBLE AS af FROM g JOIN m USING (a, b)",
    "bipolars": f"""{_S}, {_common(0, 1, 'g')}, {_marks('g', 10, 'm')}, t AS (SELECT m.mark, m.a AS e, m.b AS bs, c.id AS c FROM m JOIN s x ON x.id = m.b JOIN s c ON c.layer = 3 AND {_OV.format('x', 'c')} WHERE c.id % 50 <> m.a % 50)
SELECT 'q' AS rule, 'npn' AS kind, mark AS marker, arg_min(e % 50, (e, bs, c)) AS emitter, arg_min(bs % 50, (e, bs, c)) AS base, arg_min(c % 50, (e, bs, c)) AS collector FROM t GROUP BY mark""",
    "box_and": f"""{_S}, p AS (SELECT a.id, a.x0, a.y0, a.x1, a.y1, min(b.id) AS f FROM s a JOIN s b ON a.layer = 0 AND b.layer = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY ALL),
q AS (SELECT p.id, greatest(p.x0, b.x0) AS x0, greatest(p.y0, b.y0) AS y0, least(p.x1, b.x1) AS x1, least(p.y1, b.y1) AS y1 FROM p JOIN s b ON b.id = p.f),
r AS (SELECT q.id, q.x0, q.y0, q.x1, q.y1, min(b.id) AS f FROM q JOIN s b ON b.layer = 2 AND q.x0 <= b.x1 AND b.x0 <= q.x1 AND q.y0 <= b.y1 AND b.y0 <= q.y1 GROUP BY ALL),
u AS (SELECT r.id, greatest(r.x0, b.x0) AS x0, greatest(r.y0, b.y0) AS y0, least(r.x1, b.x1) AS x1, least(r.y1, b.y1) AS y1 FROM r JOIN s b ON b.id = r.f) SELECT * FROM u WHERE x1 > x0 AND y1 > y0""",
    "box_or": f"{_S} SELECT x0, y0, x1, y1 FROM s WHERE layer IN (0, 9)",
    "box_subtract": f"""{_S}, k AS (SELECT a.id, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM s a JOIN s b ON a.layer = 0 AND b.layer = 1 AND {_OV.format('a', 'b')}),
xs AS (SELECT id, x, lead(x) OVER (PARTITION BY id ORDER BY x) AS nx FROM (SELECT id, x0 AS x FROM k UNION SELECT id, x1 FROM k) q), ys AS (SELECT id, y, lead(y) OVER (PARTITION BY id ORDER BY y) AS ny FROM (SELECT id, y0 AS y FROM k UNION SELECT id, y1 FROM k) q),
c AS (SELECT xs.id, sum((nx - x) * (ny - y)) AS gone FROM xs JOIN ys USING (id) WHERE EXISTS (SELECT 1 FROM k WHERE k.id = xs.id AND k.x0 <= x AND k.x1 >= nx AND k.y0 <= y AND k.y1 >= ny) GROUP BY xs.id)
SELECT s.id, CAST((x1 - x0) * (y1 - y0) - coalesce(gone, 0) AS BIGINT) AS area FROM s LEFT JOIN c USING (id) WHERE layer = 0 AND (x1 - x0) * (y1 - y0) > coalesce(gone, 0)""",
}

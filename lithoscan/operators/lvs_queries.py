"""Netlist queries over the layout views, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..views import DEVICES, RECTS, TEXTS, VIAS, spark_view
from . import lvs, netlist

#: Boxes with even ids, cuts with odd ones; cuts (layer 9) join layers 0, 1 and 2.
NODES = f"SELECT id * 2 AS id, layer, x0, y0, x1, y1 FROM ({RECTS}) nr UNION ALL SELECT id * 2 + 1, layer, x0, y0, x1, y1 FROM ({VIAS}) nv"
JOINED = (0, 1, 2)
CUT = 9
RATIO = 3


def _nodes(s, d):
    return spark_view(s, d, NODES)


def _joins(s):
    return s.createDataFrame([(CUT, la) for la in JOINED], "la int, lb int")


def _nets(s, d):
    return lvs.nets(_nodes(s, d), _joins(s))


def _gates(s, d):
    n = _nodes(s, d)
    return lvs.gates(n.where("layer = 2"), n.where("layer = 3"))


def _gate_areas(s, d):
    return _gates(s, d).groupBy(F.col("poly_id").alias("id")).agg(F.sum(F.expr("(x1 - x0) * (y1 - y0)")).cast("long").alias("gate"))


def _devices(s, d):
    return spark_view(s, d, DEVICES)


def _verdict(s, d, change):
    """Whether the devices are those of a netlist that ``change`` makes of them: its status, and the first check that differs."""
    found = netlist.run_lvs(s, _devices(s, d), change(_devices(s, d)))
    first = found.findings.select("check").distinct() if found.status == "Mismatch" else s.createDataFrame([("",)], "check string")
    return first.select(F.lit(found.status).alias("status"), "check")


def _renamed(t):
    """The same netlist under other names, sources and drains exchanged."""
    return t.withColumns({"g": F.col("g") * 3 + 1, "s": F.col("d") * 3 + 1, "d": F.col("s") * 3 + 1, "dev_id": F.col("dev_id") + 7})


def _bound(s, d):
    return lvs.bind_texts(spark_view(s, d, TEXTS), _nodes(s, d))


QUERIES = {
    "nets": lambda s, d: _nets(s, d).select("id", "layer", "net"),
    "net_ids": lambda s, d: lvs.compact_nets(_nets(s, d)),
    "text_binding": _bound,
    "net_names": lambda s, d: lvs.net_names(_nets(s, d), _bound(s, d)),
    "label_conflicts": lambda s, d: lvs.label_conflicts(_nets(s, d), _bound(s, d)),
    "global_nets": lambda s, d: lvs.nets(_nodes(s, d), _joins(s), lvs.global_net_edges(_bound(s, d).select("id", "text"), ["BUILDING"])).select("id", "net"),
    "mos_gates": _gates,
    "mos_devices": lambda s, d: lvs.transistors(_gates(s, d)),
    "device_counts": lambda s, d: lvs.device_counts(_devices(s, d)),
    "parallel_reduce": lambda s, d: lvs.parallel_reduce(_devices(s, d)),
    "series_reduce": lambda s, d: lvs.series_reduce(_devices(s, d)),
    "floating_nets": lambda s, d: lvs.floating_nets(_nets(s, d), _nets(s, d).join(_gate_areas(s, d), "id").select("net")),
    "antenna": lambda s, d: lvs.antenna(_nets(s, d), _gate_areas(s, d), 0, RATIO),
    "antenna_car": lambda s, d: lvs.antenna_stages(_nodes(s, d), _joins(s), _gate_areas(s, d), [0, 1], [2, CUT], RATIO),
    "lvs_match": lambda s, d: _verdict(s, d, _renamed),
    "lvs_mismatch": lambda s, d: _verdict(s, d, lambda t: _renamed(t).withColumn("g", F.when(F.col("dev_id") % 97 == 0, F.col("g") + 3).otherwise(F.col("g")))),
    "lvs_counts": lambda s, d: lvs.compare(_devices(s, d), _renamed(_devices(s, d)).where("dev_id % 50 <> 0")),
    "lvs_sizes": lambda s, d: _verdict(s, d, lambda t: _renamed(t).withColumn("w", F.col("w") + 1)),
    "lvs_refine": lambda s, d: lvs.refine(lvs.device_pins(_devices(s, d), "layout"))[0].groupBy("cls").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("classes")),
}

_TOUCH = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_OVER = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


def _reach(src: str, edges: str, name: str = "g") -> str:
    """Smallest reachable node by shrinking labels: each round takes the least label of a node's neighbours."""
    return f"""{name}_reach AS (SELECT id, id AS other FROM {src} UNION SELECT {name}_reach.id, e.b FROM {name}_reach JOIN {edges} e ON {name}_reach.other = e.a),
{name} AS (SELECT id, min(other) AS net FROM {name}_reach GROUP BY id)"""


_EDGES = f"t AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND a.layer = b.layer AND {_TOUCH} UNION ALL SELECT a.id, b.id FROM n a JOIN n b ON {_OVER} AND ((a.layer = {CUT} AND b.layer IN {JOINED}) OR (b.layer = {CUT} AND a.layer IN {JOINED})))"
_N = f"WITH RECURSIVE n AS MATERIALIZED ({NODES}), {_EDGES.replace('t AS (', 't AS MATERIALIZED (')}, {_reach('n', 't')}"
_GATES = """gt AS (SELECT a.id AS poly_id, b.id AS diff_id, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, b.x0 AS dx0, b.y0 AS dy0, b.x1 AS dx1, b.y1 AS dy1
FROM n a JOIN n b ON a.layer = 2 AND b.layer = 3 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
ga AS (SELECT poly_id AS id, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS gate FROM gt GROUP BY poly_id)"""
_BOUND = f"bt AS (SELECT t.text_id, t.text, min(n.id) AS id FROM ({TEXTS}) t JOIN n ON n.x0 <= t.x AND t.x <= n.x1 AND n.y0 <= t.y AND t.y <= n.y1 GROUP BY ALL)"
_NAMES = "nm AS (SELECT net, arg_min(text, text_id) AS name, count(DISTINCT text) AS names FROM bt JOIN g USING (id) GROUP BY net)"
_STAGED = f"""st AS (SELECT n.*, s.k, n.id * 2 + s.k AS node FROM n JOIN (SELECT 0 AS k UNION ALL SELECT 1) s ON n.layer = 2 OR n.layer = {CUT} OR (n.layer <= s.k)),
e2 AS MATERIALIZED (SELECT t.a * 2 + s.k AS a, t.b * 2 + s.k AS b FROM t JOIN st s ON s.id = t.a JOIN st u ON u.id = t.b AND u.k = s.k), sn AS (SELECT node AS id FROM st), {_reach('sn', 'e2', 'h')},
cs AS (SELECT h.net, sum(CASE WHEN layer IN (0, 1) THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS metal, sum(coalesce(gate, 0)) AS gate FROM st JOIN h ON h.id = st.node LEFT JOIN ga ON ga.id = st.id GROUP BY h.net)"""

ORACLES = {
    "nets": f"{_N} SELECT n.id, n.layer, g.net FROM n JOIN g USING (id)",
    "net_ids": f"{_N} SELECT net, CAST(row_number() OVER (ORDER BY net) - 1 AS BIGINT) AS net_id FROM (SELECT DISTINCT net FROM g) q",
    "text_binding": f"WITH n AS ({NODES}), {_BOUND} SELECT text_id, text, id FROM bt",
    "net_names": f"{_N}, {_BOUND}, {_NAMES} SELECT net, name, names FROM nm",
    "label_conflicts": f"{_N}, {_BOUND}, {_NAMES} SELECT net, name, names FROM nm WHERE names > 1",
    "global_nets": f"{_N}, {_BOUND}, gm AS (SELECT min(g.net) AS top FROM bt JOIN g USING (id) WHERE text = 'BUILDING') SELECT n.id, CASE WHEN g.net IN (SELECT g2.net FROM bt JOIN g g2 USING (id) WHERE text = 'BUILDING') THEN gm.top ELSE g.net END AS net FROM n JOIN g USING (id), gm",
    "mos_gates": f"WITH n AS ({NODES}), {_GATES} SELECT * FROM gt",
    "mos_devices": f"""WITH n AS ({NODES}), {_GATES}, ax AS (SELECT diff_id, 2 * count(*) FILTER (y0 <= dy0 AND y1 >= dy1) >= count(*) AS along FROM gt GROUP BY diff_id),
s AS (SELECT poly_id, diff_id, CASE WHEN along THEN x0 ELSE y0 END AS lo, CASE WHEN along THEN x1 ELSE y1 END AS hi, CASE WHEN along THEN y1 - y0 ELSE x1 - x0 END AS w FROM gt JOIN ax USING (diff_id)),
o AS (SELECT *, max(hi) OVER (PARTITION BY diff_id ORDER BY lo, hi, poly_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s),
k AS (SELECT *, sum(CASE WHEN lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY lo, hi, poly_id ROWS UNBOUNDED PRECEDING) AS span FROM o)
SELECT poly_id, diff_id, CAST(w AS BIGINT) AS w, CAST(hi - lo AS BIGINT) AS l, CAST(span AS BIGINT) AS source, CAST(span + 1 AS BIGINT) AS drain FROM k""",
    "device_counts": f"SELECT kind, count(*) AS n FROM ({DEVICES}) d GROUP BY kind",
    "parallel_reduce": f"SELECT kind, g, least(s, d) AS s, greatest(s, d) AS d, l, min(dev_id) AS dev_id, CAST(sum(w) AS BIGINT) AS w, count(*) AS merged FROM ({DEVICES}) d GROUP BY kind, g, least(s, d), greatest(s, d), l",
    "floating_nets": f"{_N}, {_GATES} SELECT net, count(*) AS boxes FROM g GROUP BY net HAVING net NOT IN (SELECT net FROM g JOIN ga USING (id))",
    "antenna": f"{_N}, {_GATES}, m AS (SELECT net, CAST(sum(CASE WHEN layer = 0 THEN (x1 - x0) * (y1 - y0) ELSE 0 END) AS BIGINT) AS metal, CAST(sum(coalesce(gate, 0)) AS BIGINT) AS gate FROM n JOIN g USING (id) LEFT JOIN ga USING (id) GROUP BY net) SELECT net, metal, gate, metal * 1000 // gate AS milli FROM m WHERE gate > 0 AND metal > {RATIO} * gate",
    "antenna_car": f"{_N}, {_GATES}, {_STAGED}, w AS (SELECT st.id, max(CAST(cs.metal * 1000 // cs.gate AS BIGINT)) AS milli FROM st JOIN h ON h.id = st.node JOIN cs ON cs.net = h.net JOIN ga ON ga.id = st.id WHERE cs.gate > 0 GROUP BY st.id) SELECT id, milli FROM w WHERE milli > {1000 * RATIO}",
    "lvs_match": f"SELECT 'Match' AS status, '' AS \"check\" FROM (SELECT count(*) AS n FROM ({DEVICES}) d) q WHERE n > 0",
    "lvs_mismatch": f"SELECT 'Mismatch' AS status, 'topology' AS \"check\" FROM (SELECT count(*) AS n FROM ({DEVICES}) d WHERE (dev_id + 7) % 97 = 0) q WHERE n > 0",
    "lvs_counts": f"SELECT 'device_count' AS \"check\", kind || ': ' || count(*) || ' in layout, ' || count(*) FILTER ((dev_id + 7) % 50 <> 0) || ' in reference' AS detail FROM ({DEVICES}) d GROUP BY kind HAVING count(*) <> count(*) FILTER ((dev_id + 7) % 50 <> 0)",
    "lvs_sizes": f"SELECT 'Mismatch' AS status, 'parametric' AS \"check\" FROM (SELECT count(*) AS n FROM ({DEVICES}) d) q WHERE n > 0",
}

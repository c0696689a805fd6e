"""Queries of the result tables, the deck runner and the per-component kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import deck as decks
from ..plans import results
from ..views import CHANGES, RECTS, spark_view
from . import kernel_ops

DECK = """{"variables": {"gap": 100, "wide": {"op": "add", "args": [{"var": "gap"}, 20]}},
"rules": [{"kind": "min_width", "id": "w", "layer": "m1", "min": 90}, {"kind": "wide_dependent_spacing", "layer": "m1", "width": {"var": "wide"}, "spacing": {"var": "gap"}},
 {"kind": "min_spacing_diff", "a": "m1", "b": "m2", "min": {"var": "gap"}}, {"kind": "max_width", "id": "x", "layer": "m2", "max": 1000}, {"kind": "min_width", "id": "none", "layer": "m9", "min": 1}]}"""


def _layers(s, d):
    r = spark_view(s, d, RECTS)
    return {"m1": r.where("layer = 0"), "m2": r.where("layer = 1")}


def _narrow(s, d):
    from . import drc

    return drc.min_width_rect(spark_view(s, d, RECTS), 65)


def _waivers(s, d):
    """A waiver for every third finding by x, ended for every second of those."""
    return _narrow(s, d).withColumn("fingerprint", results.fingerprint()).where("x % 3 = 0").select("fingerprint", F.expr("if(x % 2 = 0, date'2020-01-01', date'2030-01-01')").alias("expires_on")).distinct()


def _invalid(s, d):
    changes = spark_view(s, d, CHANGES).select("layer", "tx", "ty").distinct().select("layer", F.lit("top/a").alias("path"), (F.col("tx") * 100).alias("x0"), (F.col("ty") * 100).alias("y0"), (F.col("tx") * 100 + 100).alias("x1"), (F.col("ty") * 100 + 100).alias("y1"))
    rules = spark_view(s, d, "SELECT p_partkey AS rule, CASE p_size % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'purchase' END AS layer, CASE WHEN p_partkey % 2 = 0 THEN 'top' ELSE 'other' END AS prefix, p_partkey * 37 % 5000 AS x0, p_partkey * 53 % 4000 AS y0, p_partkey * 37 % 5000 + 300 AS x1, p_partkey * 53 % 4000 + 300 AS y1 FROM part")
    depends = spark_view(s, d, "SELECT p_partkey AS src, p_partkey + 500 AS dst FROM part")
    return results.invalidated(changes, rules, depends)


def _power(s, d):
    edges = spark_view(s, d, "SELECT s_suppkey AS a, s_suppkey - 1 - s_suppkey % 3 AS b, 1.0D + s_suppkey % 5 AS ohm FROM supplier WHERE s_suppkey - 1 - s_suppkey % 3 > 0")
    fixed = edges.agg(F.min("b").alias("id")).withColumn("volts", F.lit(1.2))
    return kernel_ops.power_solve(edges, fixed, edges.select(F.col("a").alias("id"), F.lit(0.001).alias("amps"))).select("id", F.round("volts", 6).alias("volts"))


QUERIES = {
    "deck_run": lambda s, d: decks.run(decks.Deck(decks.Deck.from_json(DECK).rules[:4]), _layers(s, d)),
    "deck_statuses": lambda s, d: decks.run_checked(s, decks.Deck.from_json(DECK), _layers(s, d))[1].select("rule_id", "status"),
    "waivers": lambda s, d: results.apply_waivers(_narrow(s, d).withColumn("fingerprint", results.fingerprint()), _waivers(s, d), "2026-01-01").groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    "tile_merge": lambda s, d: results.merge_tiles(_narrow(s, d).withColumn("tile", F.explode(F.array(F.expr("x div 1000"), F.expr("(x + 60) div 1000"))))).select("tile", "layer", "x", "y"),
    "invalidated_rules": _invalid,
    "multi_patterning": lambda s, d: kernel_ops.multi_patterning(spark_view(s, d, RECTS), 2, 100),
    "power_solve": _power,
}

_BAD = f"b AS (SELECT DISTINCT layer, least(x1 - x0, y1 - y0) AS m, x0 AS x, y0 AS y FROM ({RECTS}) r WHERE least(x1 - x0, y1 - y0) < 65)"
_GX, _GY = "greatest(a.x0 - b.x1, b.x0 - a.x1, 0)", "greatest(a.y0 - b.y1, b.y0 - a.y1, 0)"
_D2 = f"({_GX} * {_GX} + {_GY} * {_GY})"


def _out(rule: str, kind: str, layer: str, measured: str, limit: int, x: str, y: str) -> str:
    return f"SELECT '{rule}' AS rule_id, '{kind}' AS kind, {layer} AS layer, CAST({measured} AS BIGINT) AS measured, CAST({limit} AS BIGINT) AS \"limit\", {x} AS x, {y} AS y"


#: The deck's rules one by one.
_RULES = f"""r AS MATERIALIZED ({RECTS}), vw AS (SELECT DISTINCT * FROM ({_out('w', 'min_width', "'0'", 'least(x1 - x0, y1 - y0)', 90, 'x0', 'y0')} FROM r WHERE layer = 0 AND least(x1 - x0, y1 - y0) < 90) q),
vs AS (SELECT DISTINCT * FROM ({_out('wide_dependent_spacing', 'wide_dependent_spacing', "'0'", f'floor(sqrt({_D2}))', 100, 'a.x1', 'a.y0')} FROM r a JOIN r b ON a.layer = 0 AND b.layer = 0 AND a.id < b.id AND {_D2} > 0 AND {_D2} < 10000 AND greatest(least(a.x1 - a.x0, a.y1 - a.y0), least(b.x1 - b.x0, b.y1 - b.y0)) >= 120) q),
vd AS (SELECT DISTINCT * FROM ({_out('min_spacing_diff', 'min_spacing_diff', "'0:1'", f'floor(sqrt({_D2}))', 100, 'a.x1', 'a.y0')} FROM r a JOIN r b ON a.layer = 0 AND b.layer = 1 AND {_D2} > 0 AND {_D2} < 10000) q),
vx AS (SELECT DISTINCT * FROM ({_out('x', 'max_width', "'1'", 'least(x1 - x0, y1 - y0)', 1000, 'x0', 'y0')} FROM r WHERE layer = 1 AND least(x1 - x0, y1 - y0) > 1000) q)"""

ORACLES = {
    "waivers": f"WITH {_BAD} SELECT CASE WHEN x % 3 <> 0 THEN 'Open' WHEN x % 2 = 0 THEN 'Expired' ELSE 'Waived' END AS status, count(*) AS n FROM b GROUP BY 1",
    "tile_merge": f"WITH {_BAD} SELECT x // 1000 AS tile, CAST(layer AS VARCHAR) AS layer, x, y FROM b",
    "deck_statuses": f"WITH {_RULES} SELECT 'none' AS rule_id, 'NotRun' AS status UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', CASE WHEN EXISTS (SELECT 1 FROM {t}) THEN 'Violations' ELSE 'Clean' END" for n, t in (("w", "vw"), ("wide_dependent_spacing", "vs"), ("min_spacing_diff", "vd"), ("x", "vx"))),
    "deck_run": f"WITH {_RULES} SELECT * FROM vw UNION SELECT * FROM vs UNION SELECT * FROM vd UNION SELECT * FROM vx",
    "invalidated_rules": f"""WITH RECURSIVE c AS (SELECT DISTINCT layer, tx * 100 AS x, ty * 100 AS y FROM ({CHANGES}) q),
r AS (SELECT p_partkey AS rule, CASE p_size % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'purchase' END AS layer, p_partkey * 37 % 5000 AS x, p_partkey * 53 % 4000 AS y FROM part WHERE p_partkey % 2 = 0),
hit AS (SELECT DISTINCT rule AS item FROM r JOIN c USING (layer) WHERE c.x <= r.x + 300 AND r.x <= c.x + 100 AND c.y <= r.y + 300 AND r.y <= c.y + 100),
go AS (SELECT item FROM hit UNION SELECT go.item + 500 FROM go JOIN part ON p_partkey = go.item) SELECT item FROM go""",
    "multi_patterning": f"""WITH RECURSIVE r AS MATERIALIZED ({RECTS}), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.layer = b.layer AND a.id <> b.id AND {_D2} > 0 AND {_D2} < 10000),
go AS (SELECT DISTINCT a AS root, a AS node, 0 AS side FROM e UNION SELECT root, e.b, 1 - side FROM go JOIN e ON e.a = go.node), c AS (SELECT node, min(root) AS comp FROM go GROUP BY node)
SELECT comp, CASE WHEN comp IN (SELECT DISTINCT x.root FROM go x JOIN go y ON x.root = y.root AND x.node = y.node AND x.side <> y.side) THEN 'conflict' ELSE 'coloured' END AS status, count(*) AS boxes FROM c GROUP BY comp""",
    # a tree: each branch carries what all nodes beyond it draw
    "power_solve": """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey - 1 - s_suppkey % 3 AS b, 1.0::DOUBLE + s_suppkey % 5 AS ohm FROM supplier WHERE s_suppkey - 1 - s_suppkey % 3 > 0), root AS (SELECT min(b) AS id FROM e),
up AS (SELECT a AS node, a AS edge, b AS at FROM e UNION SELECT up.node, e.a, e.b FROM up JOIN e ON e.a = up.at), load AS (SELECT edge, count(*) * 0.001::DOUBLE AS amps FROM up GROUP BY edge),
n AS (SELECT a AS id FROM e UNION SELECT b FROM e), v AS (SELECT up.node AS id, sum(e.ohm * load.amps) AS drop, bool_or(up.at = root.id) AS tied FROM up JOIN e ON e.a = up.edge JOIN load ON load.edge = up.edge, root GROUP BY up.node)
SELECT n.id, CASE WHEN n.id = (SELECT id FROM root) THEN 1.2::DOUBLE WHEN tied THEN round(1.2::DOUBLE - drop, 6) END AS volts FROM n LEFT JOIN v USING (id)""",
}

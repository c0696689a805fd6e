"""Queries of the rules over rings, each with the SQL it is held against.

The rings are boxes, L and U shapes around the layout views' boxes, and boxes
with keyhole holes; the SQL knows that all their edges are axis-parallel.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..views import EDGES, KEYHOLES, RECTS, spark_view
from . import polygons
from .drc_queries import NARROW, PRL, SPACE, WIDE, WIDTH, _root, _row, edges

EDGE = 40
#: Cuts in the middle of some boxes, as rings to be enclosed.
CUTS = f"SELECT id, 9 AS layer, x0 + 8 + id % 20 AS x0, y0 + 7 + id % 14 AS y0, x0 + 20 + id % 20 AS x1, y0 + 19 + id % 14 AS y1 FROM ({RECTS}) b"


def _ring_view(sql: str):
    """Boxes as rings."""

    def view(spark, sf_dir):
        point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        return spark_view(spark, sf_dir, sql).select("id", "layer", F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1")).alias("ring"))

    return view


def _keyholes(spark, sf_dir):
    walk = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("mx", "y1"), ("mx", "hy1"), ("hx1", "hy1"), ("hx1", "hy0"), ("hx0", "hy0"), ("hx0", "hy1"), ("mx", "hy1"), ("mx", "y1"), ("x0", "y1")]
    ring = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in walk])
    return spark_view(spark, sf_dir, KEYHOLES).select("id", "layer", ring.alias("ring"))


def _plates(spark, sf_dir):
    """Boxes, of which every sixth has a hole."""
    whole = _ring_view(f"SELECT id, layer, x0, y0, x1, y1 FROM ({RECTS}) b WHERE id % 6 <> 0")(spark, sf_dir)
    return whole.select("id", "layer", "ring").unionByName(_keyholes(spark, sf_dir))


def _odd(spark, sf_dir):
    """Rings of which some have no area, cross themselves or span too much."""
    ring = F.expr(
        "transform(CASE id % 9 WHEN 0 THEN array(x0, y0, x1, y0, x0, y0) WHEN 1 THEN array(x0, y0, x1, y1, x1, y0, x0, y1 + 1) WHEN 2 THEN array(x0, y0, x0 + 2000000000, y0, x0, y1)"
        " ELSE array(x0, y0, x1, y0, x1, y1, x0, y1) END, v -> v)"
    )
    flat = spark_view(spark, sf_dir, RECTS).select("id", "layer", ring.alias("flat"))
    points = F.transform(F.sequence(F.lit(0), F.expr("size(flat) div 2 - 1").cast("int")), lambda k: F.struct(F.get("flat", 2 * k).alias("x"), F.get("flat", 2 * k + 1).alias("y")))
    return flat.select("id", "layer", points.alias("ring"))


def _cuts(spark, sf_dir):
    return polygons.edges_of(_ring_view(CUTS)(spark, sf_dir))


def _on(n: int):
    return lambda s, d: edges(s, d).where(f"layer = {n}")


QUERIES = {
    "min_width": lambda s, d: polygons.min_width(edges(s, d), NARROW),
    "notch": lambda s, d: polygons.notch(edges(s, d), WIDE),
    "poly_spacing": lambda s, d: polygons.min_spacing(edges(s, d), SPACE),
    "poly_spacing_diff": lambda s, d: polygons.min_spacing_diff(_on(0)(s, d), _on(1)(s, d), SPACE),
    "poly_prl_spacing": lambda s, d: polygons.prl_spacing(edges(s, d), PRL, SPACE),
    "poly_wide_spacing": lambda s, d: polygons.wide_spacing(edges(s, d), WIDTH, SPACE),
    "poly_corner": lambda s, d: polygons.corner_to_corner(edges(s, d), SPACE),
    "poly_eol": lambda s, d: polygons.eol_spacing(edges(s, d), NARROW, SPACE),
    "poly_enclosure": lambda s, d: polygons.min_enclosure(_cuts(s, d), edges(s, d), 12),
    "poly_asymmetric_enclosure": lambda s, d: polygons.asymmetric_enclosure(_cuts(s, d), edges(s, d), 70),
    "gap_fills": lambda s, d: polygons.gap_fills(edges(s, d), SPACE),
    "poly_cheesing": lambda s, d: polygons.cheesing(_plates(s, d), 15_000),
    "min_enclosed_area": lambda s, d: polygons.min_enclosed_area(_keyholes(s, d), 500),
    "polygon_validity": lambda s, d: polygons.validity(_odd(s, d)),
}

_E = f"WITH RECURSIVE e AS MATERIALIZED ({EDGES}), o AS MATERIALIZED (SELECT id, layer, ei, least(x0, x1) AS lx, least(y0, y1) AS ly, greatest(x0, x1) AS hx, greatest(y0, y1) AS hy, x0, y0, x1, y1 FROM e)"
_BOX = ", bx AS MATERIALIZED (SELECT id, layer, min(lx) AS x0, min(ly) AS y0, max(hx) AS x1, max(hy) AS y1, count(*) AS n, arg_min(x0, ei) AS sx, arg_min(y0, ei) AS sy FROM o GROUP BY id, layer)"
_G = "greatest({0}.lx - {1}.hx, {1}.lx - {0}.hx, 0)"
_H = "greatest({0}.ly - {1}.hy, {1}.ly - {0}.hy, 0)"
_ED2 = f"({_G.format('p', 'q')} * {_G.format('p', 'q')} + {_H.format('p', 'q')} * {_H.format('p', 'q')})"


def _near(margin: int, layers: str = "a.layer = b.layer AND a.id < b.id") -> str:
    """Rings whose boxes are near, and the least squared distance of their edges."""
    return f""", nb AS MATERIALIZED (SELECT a.id AS ia, b.id AS ib FROM bx a JOIN bx b ON {layers} AND a.x0 - {margin} <= b.x1 AND b.x0 - {margin} <= a.x1 AND a.y0 - {margin} <= b.y1 AND b.y0 - {margin} <= a.y1),
near AS MATERIALIZED (SELECT ia, ib, min({_ED2}) AS d2 FROM nb JOIN o p ON p.id = ia JOIN o q ON q.id = ib GROUP BY ia, ib)"""


def _parity(x: str, y: str, ring: str) -> str:
    """Whether a point is strictly inside a ring of axis-parallel edges."""
    on = f"EXISTS (SELECT 1 FROM o WHERE o.id = {ring} AND o.lx <= {x} AND {x} <= o.hx AND o.ly <= {y} AND {y} <= o.hy)"
    return f"(NOT {on} AND (SELECT count(*) FROM o WHERE o.id = {ring} AND o.lx = o.hx AND o.lx > {x} AND (o.y0 > {y}) <> (o.y1 > {y})) % 2 = 1)"


_GROUPS = """, touch AS (SELECT ia AS a, ib AS b FROM near WHERE d2 = 0 UNION ALL SELECT ib, ia FROM near WHERE d2 = 0),
reach AS (SELECT DISTINCT id, id AS other FROM bx UNION SELECT reach.id, touch.b FROM reach JOIN touch ON reach.other = touch.a),
g AS MATERIALIZED (SELECT id, min(other) AS grp FROM reach GROUP BY id)"""
_OX, _OY = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))", "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_FULL = f", f AS MATERIALIZED (SELECT near.*, {_OX} AS ox, {_OY} AS oy, a.layer, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, a.sx, a.sy, b.sx AS tx, b.sy AS ty, b.layer AS blayer FROM near JOIN bx a ON a.id = ia JOIN bx b ON b.id = ib WHERE d2 > 0 AND d2 < {{0}})"
_INSIDE = f"(bx0 < ax0 AND by0 < ay0 AND ax1 < bx1 AND ay1 < by1 AND {_parity('sx', 'sy', 'ib')}) OR (ax0 < bx0 AND ay0 < by0 AND bx1 < ax1 AND by1 < ay1 AND {_parity('tx', 'ty', 'ia')})"
_GAP = """SELECT f.*, ga.grp = gb.grp AS same, CASE WHEN ox > 0 THEN greatest(ax0, bx0) ELSE least(ax1, bx1) END AS gx0, CASE WHEN ox > 0 THEN least(ax1, bx1) ELSE greatest(ax0, bx0) END AS gx1,
  CASE WHEN ox > 0 OR oy <= 0 THEN least(ay1, by1) ELSE greatest(ay0, by0) END AS gy0, CASE WHEN ox > 0 OR oy <= 0 THEN greatest(ay0, by0) ELSE least(ay1, by1) END AS gy1
  FROM f JOIN g ga ON ga.id = ia JOIN g gb ON gb.id = ib"""
_SOLID = "EXISTS (SELECT 1 FROM bx c WHERE c.layer = k.layer AND c.n = 4 AND c.id <> ia AND c.id <> ib AND c.x0 <= gx0 AND c.y0 <= gy0 AND c.x1 >= gx1 AND c.y1 >= gy1)"
_SPACED = f"{_E}{_BOX}{_near(SPACE)}{_GROUPS}{_FULL.format(SPACE * SPACE)}, k AS ({_GAP}), kept AS (SELECT * FROM k WHERE NOT ({_INSIDE}) AND NOT (same AND {_SOLID}))"


def _facing(inside: bool, most: int, rings: str = "TRUE") -> str:
    """Parallel edges of a ring with a common span, and whether the middle of their gap is strictly inside."""
    pair = "FROM o p JOIN o q ON p.id = q.id AND p.ei < q.ei"
    return f"""m AS (SELECT p.id, p.layer, abs(p.lx - q.lx) AS gap, (p.lx + q.lx) // 2 AS x, (greatest(p.ly, q.ly) + least(p.hy, q.hy)) // 2 AS y {pair} AND p.lx = p.hx AND q.lx = q.hx AND greatest(p.ly, q.ly) < least(p.hy, q.hy)
UNION ALL SELECT p.id, p.layer, abs(p.ly - q.ly), (greatest(p.lx, q.lx) + least(p.hx, q.hx)) // 2, (p.ly + q.ly) // 2 {pair} AND p.ly = p.hy AND q.ly = q.hy AND greatest(p.lx, q.lx) < least(p.hx, q.hx)),
w AS (SELECT * FROM m WHERE gap > 0 AND gap < {most} AND {rings} AND {'' if inside else 'NOT '}{_parity('m.x', 'm.y', 'm.id')})"""


_CUT = f", c AS ({CUTS})"
#: Hosts that have a cut strictly inside, and the least distance of their edges to it.
_HOSTS = f"""{_CUT}, h AS MATERIALIZED (SELECT c.id AS ci, b.id AS ib, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, min(greatest(c.x0 - o.hx, o.lx - c.x1, 0) * greatest(c.x0 - o.hx, o.lx - c.x1, 0) + greatest(c.y0 - o.hy, o.ly - c.y1, 0) * greatest(c.y0 - o.hy, o.ly - c.y1, 0)) AS d2
  FROM c JOIN bx b ON b.x0 < c.x0 AND b.y0 < c.y0 AND c.x1 < b.x1 AND c.y1 < b.y1 JOIN o ON o.id = b.id WHERE {_parity('c.x0', 'c.y0', 'b.id')} GROUP BY ALL)"""

ORACLES = {
    "min_width": f"{_E}{_BOX}, {_facing(True, NARROW, 'm.id % 3 <> 2')} {_row('min_width', 'layer', 'gap', NARROW, 'x', 'y')} FROM w UNION ALL {_row('min_width', 'layer', 'least(x1 - x0, y1 - y0)', NARROW, 'x0', 'y0')} FROM bx WHERE id % 3 = 2 AND least(x1 - x0, y1 - y0) < {NARROW}",
    "notch": f"{_E}, {_facing(False, WIDE)} {_row('notch', 'layer', 'gap', WIDE, 'x', 'y')} FROM w",
    "poly_spacing": f"{_SPACED} {_row(chr(67) + 'ASE WHEN same THEN ' + chr(39) + 'notch' + chr(39) + ' ELSE ' + chr(39) + 'min_spacing' + chr(39) + ' END', 'layer', _root('d2'), SPACE, 'ax1', 'ay0', 'min_spacing')} FROM kept",
    "poly_spacing_diff": f"{_E}{_BOX}{_near(SPACE, 'a.layer = 0 AND b.layer = 1')}{_FULL.format(SPACE * SPACE)} {_row('min_spacing_diff', chr(39) + '0:1' + chr(39), _root('d2'), SPACE, 'ax1', 'ay0')} FROM f WHERE NOT ({_INSIDE})",
    "poly_prl_spacing": f"{_E}{_BOX}{_near(SPACE)}{_FULL.format(SPACE * SPACE)} {_row('prl_spacing', 'layer', _root('d2'), SPACE, 'ax1', 'ay0')} FROM f WHERE CASE WHEN ox > 0 AND oy < 0 THEN ox WHEN oy > 0 AND ox < 0 THEN oy ELSE 0 END >= {PRL}",
    "poly_wide_spacing": f"{_E}{_BOX}{_near(SPACE)}{_FULL.format(SPACE * SPACE)} {_row('wide_dependent_spacing', 'layer', _root('d2'), SPACE, 'ax1', 'ay0')} FROM f WHERE (least(ax1 - ax0, ay1 - ay0) >= {WIDTH} OR least(bx1 - bx0, by1 - by0) >= {WIDTH}) AND NOT ({_INSIDE})",
    "poly_corner": f"""{_E}{_BOX}{_near(SPACE)}{_GROUPS}{_FULL.format(SPACE * SPACE)},
v AS (SELECT f.*, p.x0 AS px, p.y0 AS py, (p.x0 - q.x0) * (p.x0 - q.x0) + (p.y0 - q.y0) * (p.y0 - q.y0) AS v2, p.ei AS pe, q.ei AS qe FROM f JOIN g ga ON ga.id = ia JOIN g gb ON gb.id = ib JOIN o p ON p.id = ia JOIN o q ON q.id = ib WHERE ox <= 0 AND oy <= 0 AND ga.grp <> gb.grp),
u AS (SELECT *, row_number() OVER (PARTITION BY ia, ib ORDER BY v2, pe, qe) AS rn FROM v) {_row('corner_to_corner', 'layer', _root('v2'), SPACE, 'px', 'py')} FROM u WHERE rn = 1 AND v2 < {SPACE * SPACE}""",
    # all rings of the view run counter-clockwise, so outward is to the right of an edge
    "poly_eol": f"""{_E}{_BOX}{_near(SPACE)}{_GROUPS}{_FULL.format(SPACE * SPACE)}, pr AS (SELECT ia, ib, f.layer FROM f JOIN g ga ON ga.id = ia JOIN g gb ON gb.id = ib WHERE ga.grp <> gb.grp),
z AS (SELECT 0 AS turn, ia AS s, ib AS t, * FROM pr UNION ALL SELECT 1, ib, ia, * FROM pr),
h AS (SELECT ia, ib, z.layer, turn, p.ei AS pe, q.ei AS qe, p.x0 AS px, p.y0 AS py, {_ED2} AS v2 FROM z JOIN o p ON p.id = s JOIN o q ON q.id = t
  WHERE p.hx - p.lx + p.hy - p.ly < {NARROW} AND p.lx - CASE WHEN p.y1 < p.y0 THEN {SPACE} ELSE 0 END <= q.hx AND q.lx <= p.hx + CASE WHEN p.y1 > p.y0 THEN {SPACE} ELSE 0 END
    AND p.ly - CASE WHEN p.x1 > p.x0 THEN {SPACE} ELSE 0 END <= q.hy AND q.ly <= p.hy + CASE WHEN p.x1 < p.x0 THEN {SPACE} ELSE 0 END),
u AS (SELECT *, row_number() OVER (PARTITION BY ia, ib ORDER BY turn, v2, pe, qe) AS rn FROM h WHERE v2 > 0 AND v2 < {SPACE * SPACE}) {_row('eol_spacing', 'layer', _root('v2'), SPACE, 'px', 'py')} FROM u WHERE rn = 1""",
    "poly_enclosure": f"{_E}{_BOX}{_HOSTS}, b AS (SELECT c.*, coalesce(max(least(floor(sqrt(d2)), 13)) FILTER (d2 > 0), 0) AS best FROM c LEFT JOIN h ON h.ci = c.id GROUP BY ALL) {_row('min_enclosure', 'layer', 'best', 12, 'x0', 'y0')} FROM b WHERE best < 12",
    "poly_asymmetric_enclosure": f"{_E}{_BOX}{_HOSTS}, b AS (SELECT c.*, coalesce(max(least(greatest(c.x0 - bx0, bx1 - c.x1), greatest(c.y0 - by0, by1 - c.y1))) FILTER (d2 > 0), 0) AS best FROM c LEFT JOIN h ON h.ci = c.id GROUP BY ALL) {_row('asymmetric_enclosure', 'layer', 'best', 70, 'x0', 'y0')} FROM b WHERE best < 70",
    "gap_fills": f"{_SPACED} SELECT layer, CAST(gx0 - {SPACE // 2} AS BIGINT) AS x0, CAST(gy0 - {SPACE // 2} AS BIGINT) AS y0, CAST(gx1 + {SPACE // 2} AS BIGINT) AS x1, CAST(gy1 + {SPACE // 2} AS BIGINT) AS y1 FROM kept WHERE same AND gx1 > gx0 AND gy1 > gy0",
    "poly_cheesing": f"WITH r AS ({RECTS}) {_row('cheesing', 'layer', '(x1 - x0) * (y1 - y0)', 15_000, 'x0', 'y0')} FROM r WHERE id % 6 <> 0 AND (x1 - x0) * (y1 - y0) > 15000",
    "min_enclosed_area": f"WITH k AS ({KEYHOLES}) {_row('min_enclosed_area', 'layer', '(hx1 - hx0) * (hy1 - hy0)', 500, 'hx0', 'hy0')} FROM k WHERE (hx1 - hx0) * (hy1 - hy0) < 500",
    "polygon_validity": f"""WITH r AS ({RECTS}) SELECT '__geometry__' AS rule_id, CASE WHEN id % 9 = 2 THEN 'geometry_capacity' ELSE 'polygon_validity' END AS kind, CAST(layer AS VARCHAR) AS layer, CAST(CASE id % 9 WHEN 0 THEN 0 ELSE 1 END AS BIGINT) AS measured, CAST(0 AS BIGINT) AS "limit", x0 AS x, y0 AS y FROM r WHERE id % 9 < 3""",
}

"""Design-rule queries over the layout views, each with the SQL it is held against."""

from __future__ import annotations

from ..views import EDGES, RECTS, VERTICES, VIAS, spark_view
from . import drc

GX = "greatest(a.x0 - b.x1, b.x0 - a.x1, 0)"
GY = "greatest(a.y0 - b.y1, b.y0 - a.y1, 0)"
D2 = f"({GX} * {GX} + {GY} * {GY})"
OX = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))"
OY = "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def _row(kind: str, layer: str, measured: str, limit: int, x: str, y: str, rule: str | None = None) -> str:
    quoted = kind if kind.startswith("CASE") else f"'{kind}'"
    return f"SELECT '{rule or kind}' AS rule_id, {quoted} AS kind, CAST({layer} AS VARCHAR) AS layer, CAST({measured} AS BIGINT) AS measured, CAST({limit} AS BIGINT) AS \"limit\", CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y"


def _root(v: str) -> str:
    return f"floor(sqrt({v}))"


def _pairs(margin: int, where: str) -> str:
    return f"""(SELECT a.id AS a_id, b.id AS b_id, a.layer AS layer, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, {D2} AS d2
FROM r a JOIN r b ON a.layer = b.layer AND a.id < b.id AND a.x0 - {margin} <= b.x1 AND b.x0 - {margin} <= a.x1 AND a.y0 - {margin} <= b.y1 AND b.y0 - {margin} <= a.y1 WHERE {where}) p"""


WITH = f"WITH RECURSIVE r AS ({RECTS}), v AS ({VIAS}) "
#: Smallest id that a box touches, directly or not, on its layer.
GROUPS = f"""t AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.layer = b.layer AND a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
reach AS (SELECT id, id AS other FROM r UNION SELECT reach.id, t.b FROM reach JOIN t ON reach.other = t.a),
g AS (SELECT id, min(other) AS grp FROM reach GROUP BY id) """

#: Corners of a box in their order, and its edges as boxes with the corner that each starts at.
CORNERS = "corner AS (SELECT id, 0 AS k, x0 AS x, y0 AS y FROM r UNION ALL SELECT id, 1, x1, y0 FROM r UNION ALL SELECT id, 2, x1, y1 FROM r UNION ALL SELECT id, 3, x0, y1 FROM r), "
SIDES = "side AS (SELECT id, 0 AS k, x0, y0, x1, y0 AS y1, x0 AS sx, y0 AS sy FROM r UNION ALL SELECT id, 1, x1, y0, x1, y1, x1, y0 FROM r UNION ALL SELECT id, 2, x0, y1, x1, y1, x1, y1 FROM r UNION ALL SELECT id, 3, x0, y0, x0, y1, x0, y1 FROM r), "

GRID, EDGE, WIDE, NARROW, SPACE, PRL, WIDTH = 5, 40, 150, 90, 100, 100, 120
WINDOW, STEP, LOW, HIGH, STEEP = 2000, 1000, 30_000, 120_000, 60_000


def _windows(step: int) -> str:
    return f"""box AS (SELECT layer, min(x0) AS lx, min(y0) AS ly, greatest(ceil((max(x1) - min(x0)) / {step}.0), 1) AS nx, greatest(ceil((max(y1) - min(y0)) / {step}.0), 1) AS ny FROM r GROUP BY layer),
w AS (SELECT layer, wx, wy, lx + wx * {step} AS x, ly + wy * {step} AS y FROM (SELECT *, unnest(range(CAST(nx AS BIGINT))) AS wx FROM box) z, LATERAL (SELECT unnest(range(CAST(ny AS BIGINT))) AS wy) u),
d AS (SELECT w.layer, wx, wy, x, y, CAST(coalesce(sum(CASE WHEN r.id IS NULL THEN 0 ELSE greatest(least(r.x1, x + {WINDOW}) - greatest(r.x0, x), 0) * greatest(least(r.y1, y + {WINDOW}) - greatest(r.y0, y), 0) END), 0) AS BIGINT) * 1000000 // {WINDOW * WINDOW} AS ppm
FROM w LEFT JOIN r ON r.layer = w.layer AND r.x0 < x + {WINDOW} AND r.x1 > x AND r.y0 < y + {WINDOW} AND r.y1 > y GROUP BY ALL)"""


def _view(sql: str):
    return lambda spark, sf_dir: spark_view(spark, sf_dir, sql)


rects, vias, vertices, edges = _view(RECTS), _view(VIAS), _view(VERTICES), _view(EDGES)


def layer(n: int):
    return lambda s, d: rects(s, d).where(f"layer = {n}")


QUERIES = {
    "off_grid": lambda s, d: drc.off_grid(vertices(s, d), GRID),
    "angle": lambda s, d: drc.angle(edges(s, d), [0]),
    "min_edge_length": lambda s, d: drc.min_edge_length(edges(s, d), EDGE),
    "max_width": lambda s, d: drc.max_width(rects(s, d), WIDE),
    "min_width_rect": lambda s, d: drc.min_width_rect(rects(s, d), NARROW),
    "cheesing": lambda s, d: drc.cheesing(rects(s, d), 40_000),
    "bbox": lambda s, d: rects(s, d).groupBy("layer").agg(*[getattr(drc.F, f)(c).alias(n) for f, c, n in (("min", "x0", "xmin"), ("min", "y0", "ymin"), ("max", "x1", "xmax"), ("max", "y1", "ymax"))]),
    "polygon_area": lambda s, d: edges(s, d).groupBy("id").agg(drc.F.expr("CAST(abs(sum(x0 * y1 - x1 * y0)) div 2 AS BIGINT)").alias("area"), drc.F.sum(drc.F.expr("abs(x1 - x0) + abs(y1 - y0)")).cast("long").alias("perimeter")),
    "min_spacing_pairs": lambda s, d: drc.min_spacing_pairs(rects(s, d), SPACE).select("a_id", "b_id", drc.F.col("a_layer").alias("layer"), "d2"),
    "min_spacing_full": lambda s, d: drc.min_spacing(rects(s, d), SPACE),
    "min_spacing_diff": lambda s, d: drc.min_spacing_diff(layer(0)(s, d), layer(1)(s, d), SPACE),
    "corner_to_corner": lambda s, d: drc.corner_to_corner(rects(s, d), SPACE),
    "prl_spacing": lambda s, d: drc.prl_spacing(rects(s, d), PRL, SPACE),
    "wide_spacing": lambda s, d: drc.wide_spacing(rects(s, d), WIDTH, SPACE),
    "eol_spacing": lambda s, d: drc.eol_spacing(rects(s, d), NARROW, SPACE),
    "min_enclosure_rect": lambda s, d: drc.min_enclosure(vias(s, d), rects(s, d), 15),
    "asymmetric_enclosure": lambda s, d: drc.asymmetric_enclosure(vias(s, d), rects(s, d), 60),
    "min_extension": lambda s, d: drc.min_extension(layer(2)(s, d), layer(3)(s, d), 50),
    "overlap_rect": lambda s, d: drc.overlap_rect(layer(0)(s, d), layer(1)(s, d), 50),
    "redundant_via": lambda s, d: drc.redundant_via(vias(s, d), 3, 500),
    "via_array": lambda s, d: drc.via_array(vias(s, d), 3, 200),
    "max_distance_to_tap": lambda s, d: drc.max_distance_to_tap(layer(3)(s, d), layer(2)(s, d), 600),
    "density_tumbling": lambda s, d: drc.density(rects(s, d), WINDOW, LOW, HIGH),
    "density_sliding": lambda s, d: drc.density(rects(s, d), WINDOW, LOW, HIGH, STEP),
    "density_gradient": lambda s, d: drc.density_gradient(rects(s, d), WINDOW, STEEP),
    "cmp_thickness": lambda s, d: drc.cmp_thickness(rects(s, d), WINDOW, 500, 80),
    "merge_groups": lambda s, d: drc.merge_groups(rects(s, d)).select("id", "layer", "grp"),
    "min_area": lambda s, d: drc.min_area(rects(s, d), 6000),
    "union_area": lambda s, d: drc.union_areas(drc.merge_groups(rects(s, d))),
}

_D = WITH + ", " + _windows(WINDOW)
_bad = lambda: f"{_row('min_density', 'layer', 'ppm', LOW, 'x', 'y')} FROM d WHERE ppm < {LOW} UNION {_row('max_density', 'layer', 'ppm', HIGH, 'x', 'y')} FROM d WHERE ppm > {HIGH}"
_IN = "least(a.x0 - b.x0, b.x1 - a.x1, a.y0 - b.y0, b.y1 - a.y1)"
_UNION = f"""x AS (SELECT DISTINCT grp, x0 AS x FROM r JOIN g USING (id) UNION SELECT grp, x1 FROM r JOIN g USING (id)),
s AS (SELECT grp, x, lead(x) OVER (PARTITION BY grp ORDER BY x) AS nx FROM x),
k AS (SELECT s.grp, s.x, s.nx, r.y0, r.y1, max(r.y1) OVER (PARTITION BY s.grp, s.x ORDER BY r.y0, r.y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
FROM s JOIN g ON g.grp = s.grp JOIN r ON r.id = g.id AND r.x0 <= s.x AND s.nx <= r.x1 WHERE nx IS NOT NULL),
area AS (SELECT grp, CAST(sum(greatest(y1 - greatest(y0, coalesce(top, y0)), 0) * (nx - x)) AS BIGINT) AS area FROM k GROUP BY grp)"""

ORACLES = {
    "off_grid": f"WITH v AS ({VERTICES}) {_row('off_grid', 'layer', f'CASE WHEN x % {GRID} <> 0 THEN x ELSE y END', GRID, 'x', 'y')} FROM v WHERE x % {GRID} <> 0 OR y % {GRID} <> 0",
    "angle": f"WITH e AS ({EDGES}) {_row('angle', 'layer', '-1', 0, 'x0', 'y0')} FROM e WHERE x0 = x1 AND y0 <> y1",
    "min_edge_length": f"WITH e AS ({EDGES}) {_row('min_edge_length', 'layer', 'abs(x1 - x0) + abs(y1 - y0)', EDGE, 'x0', 'y0')} FROM e WHERE abs(x1 - x0) + abs(y1 - y0) BETWEEN 1 AND {EDGE - 1}",
    "max_width": f"{WITH} {_row('max_width', 'layer', 'least(x1 - x0, y1 - y0)', WIDE, 'x0', 'y0')} FROM r WHERE least(x1 - x0, y1 - y0) > {WIDE}",
    "min_width_rect": f"{WITH} {_row('min_width', 'layer', 'least(x1 - x0, y1 - y0)', NARROW, 'x0', 'y0')} FROM r WHERE least(x1 - x0, y1 - y0) < {NARROW}",
    "cheesing": f"{WITH} {_row('cheesing', 'layer', '(x1 - x0) * (y1 - y0)', 40000, 'x0', 'y0')} FROM r WHERE (x1 - x0) * (y1 - y0) > 40000",
    "bbox": f"{WITH} SELECT layer, min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM r GROUP BY layer",
    "polygon_area": f"WITH e AS ({EDGES}) SELECT id, CAST(abs(sum(x0 * y1 - x1 * y0)) // 2 AS BIGINT) AS area, CAST(sum(abs(x1 - x0) + abs(y1 - y0)) AS BIGINT) AS perimeter FROM e GROUP BY id",
    "min_spacing_pairs": f"{WITH} SELECT a_id, b_id, layer, CAST(d2 AS BIGINT) AS d2 FROM {_pairs(SPACE, f'{D2} > 0 AND {D2} < {SPACE * SPACE}')}",
    "min_spacing_full": f"""{WITH}, {GROUPS}, p AS (SELECT * FROM {_pairs(SPACE, f'{D2} > 0 AND {D2} < {SPACE * SPACE}')}),
q AS (SELECT p.*, ga.grp = gb.grp AS same,
  CASE WHEN greatest(ax0 - bx1, bx0 - ax1) > 0 THEN least(ax1, bx1) ELSE greatest(ax0, bx0) END AS hx0, CASE WHEN greatest(ax0 - bx1, bx0 - ax1) > 0 THEN greatest(ax0, bx0) ELSE least(ax1, bx1) END AS hx1,
  CASE WHEN greatest(ay0 - by1, by0 - ay1) > 0 THEN least(ay1, by1) ELSE greatest(ay0, by0) END AS hy0, CASE WHEN greatest(ay0 - by1, by0 - ay1) > 0 THEN greatest(ay0, by0) ELSE least(ay1, by1) END AS hy1
  FROM p JOIN g ga ON ga.id = a_id JOIN g gb ON gb.id = b_id)
{_row("CASE WHEN same THEN 'notch' ELSE 'min_spacing' END", 'layer', _root('d2'), SPACE, 'ax1', 'ay0', 'min_spacing')} FROM q
WHERE NOT (same AND EXISTS (SELECT 1 FROM r c WHERE c.layer = q.layer AND c.id <> a_id AND c.id <> b_id AND c.x0 <= hx0 AND c.x1 >= hx1 AND c.y0 <= hy0 AND c.y1 >= hy1))""",
    "min_spacing_diff": f"{WITH} {_row('min_spacing_diff', chr(39) + '0:1' + chr(39), _root(D2), SPACE, 'a.x1', 'a.y0')} FROM r a JOIN r b ON a.layer = 0 AND b.layer = 1 AND {D2} > 0 AND {D2} < {SPACE * SPACE}",
    "corner_to_corner": f"""{WITH}, {GROUPS}, p AS (SELECT * FROM {_pairs(SPACE, f'{D2} > 0 AND {D2} < {SPACE * SPACE}')}),
c AS (SELECT p.*, i.x AS cx, i.y AS cy, (i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y) AS v2, row_number() OVER (PARTITION BY a_id, b_id ORDER BY (i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y), i.k, j.k) AS rn
  FROM p JOIN corner i ON i.id = a_id JOIN corner j ON j.id = b_id JOIN g ga ON ga.id = a_id JOIN g gb ON gb.id = b_id
  WHERE ga.grp <> gb.grp AND NOT least(ax1, bx1) > greatest(ax0, bx0) AND NOT least(ay1, by1) > greatest(ay0, by0))
{_row('corner_to_corner', 'layer', _root('v2'), SPACE, 'cx', 'cy')} FROM c WHERE rn = 1 AND v2 < {SPACE * SPACE}""".replace(GROUPS, CORNERS + GROUPS),
    "prl_spacing": f"{WITH} {_row('prl_spacing', 'layer', _root('d2'), SPACE, 'ax1', 'ay0')} FROM {_pairs(SPACE, f'{D2} > 0 AND {D2} < {SPACE * SPACE} AND greatest({OX}, {OY}) >= {PRL}')}",
    "wide_spacing": f"{WITH} {_row('wide_dependent_spacing', 'layer', _root('d2'), SPACE, 'ax1', 'ay0')} FROM {_pairs(SPACE, f'{D2} > 0 AND {D2} < {SPACE * SPACE} AND (least(a.x1 - a.x0, a.y1 - a.y0) >= {WIDTH} OR least(b.x1 - b.x0, b.y1 - b.y0) >= {WIDTH})')}",
    "eol_spacing": f"""{WITH}, {SIDES}{GROUPS}, p AS (SELECT * FROM {_pairs(SPACE, f'{D2} > 0 AND {D2} < {SPACE * SPACE}')}),
q AS (SELECT a_id, b_id, layer FROM p JOIN g ga ON ga.id = a_id JOIN g gb ON gb.id = b_id WHERE ga.grp <> gb.grp),
z AS (SELECT 0 AS turn, a_id AS e, b_id AS o, * FROM q UNION ALL SELECT 1, b_id, a_id, * FROM q),
h AS (SELECT a_id, b_id, layer, turn, i.k AS ik, j.k AS jk, i.sx, i.sy, power(greatest(i.x0 - j.x1, j.x0 - i.x1, 0), 2) + power(greatest(i.y0 - j.y1, j.y0 - i.y1, 0), 2) AS v2
  FROM z JOIN side i ON i.id = e JOIN side j ON j.id = o
  WHERE i.x1 - i.x0 + i.y1 - i.y0 < {NARROW}
    AND i.x0 + CASE WHEN i.k = 3 THEN -{SPACE} ELSE 0 END <= j.x1 AND j.x0 <= i.x1 + CASE WHEN i.k = 1 THEN {SPACE} ELSE 0 END
    AND i.y0 + CASE WHEN i.k = 0 THEN -{SPACE} ELSE 0 END <= j.y1 AND j.y0 <= i.y1 + CASE WHEN i.k = 2 THEN {SPACE} ELSE 0 END),
m AS (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY turn, v2, ik, jk) AS rn FROM h WHERE v2 > 0 AND v2 < {SPACE * SPACE})
{_row('eol_spacing', 'layer', _root('v2'), SPACE, 'sx', 'sy')} FROM m WHERE rn = 1""",
    "min_enclosure_rect": f"{WITH}, m AS (SELECT a.id, a.layer, a.x0, a.y0, coalesce(max({_IN}), 0) AS best FROM v a LEFT JOIN r b ON b.x0 < a.x0 AND b.x1 > a.x1 AND b.y0 < a.y0 AND b.y1 > a.y1 GROUP BY ALL) {_row('min_enclosure', 'layer', 'best', 15, 'x0', 'y0')} FROM m WHERE best < 15",
    "asymmetric_enclosure": f"{WITH}, m AS (SELECT a.id, a.layer, a.x0, a.y0, coalesce(max(least(greatest(a.x0 - b.x0, b.x1 - a.x1), greatest(a.y0 - b.y0, b.y1 - a.y1))), 0) AS best FROM v a LEFT JOIN r b ON b.x0 < a.x0 AND b.x1 > a.x1 AND b.y0 < a.y0 AND b.y1 > a.y1 GROUP BY ALL) {_row('asymmetric_enclosure', 'layer', 'best', 60, 'x0', 'y0')} FROM m WHERE best < 60",
    "min_extension": f"""{WITH}, c AS (SELECT a.layer, a.y1 - a.y0 >= a.x1 - a.x0 AS tall, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1
  FROM r a JOIN r b ON a.layer = 2 AND b.layer = 3 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1),
m AS (SELECT layer, by0 - ay0 AS ext, ax0 AS x, by0 AS y FROM c WHERE tall UNION ALL SELECT layer, ay1 - by1, ax0, by1 FROM c WHERE tall
  UNION ALL SELECT layer, bx0 - ax0, bx0, ay0 FROM c WHERE NOT tall UNION ALL SELECT layer, ax1 - bx1, bx1, ay0 FROM c WHERE NOT tall)
{_row('min_extension', 'layer', 'ext', 50, 'x', 'y')} FROM m WHERE ext < 50""",
    # what b covers of a box is a set of unit-free strips: slabs of x, merged runs of y, joined along slabs
    "overlap_rect": f"""{WITH}, c AS (SELECT row_number() OVER () AS id, a.id AS own, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1
  FROM r a JOIN r b ON a.layer = 0 AND b.layer = 1 AND {OX} > 0 AND {OY} > 0),
t AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.own = b.own AND a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND ({OX} > 0 OR {OY} > 0)),
reach AS (SELECT id, id AS other FROM c UNION SELECT reach.id, t.b FROM reach JOIN t ON reach.other = t.a),
g AS (SELECT id, min(other) AS grp FROM reach GROUP BY id),
{_UNION.replace('r JOIN g', 'c JOIN g').replace('JOIN r ON', 'JOIN c r ON')},
w AS (SELECT grp, any_value(own) AS own, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c JOIN g USING (id) GROUP BY grp),
m AS (SELECT own, max(least(x1 - x0, y1 - y0)) AS best, bool_or(area <> (x1 - x0) * (y1 - y0)) AS odd FROM w JOIN area USING (grp) GROUP BY own),
f AS (SELECT r.*, CASE WHEN odd THEN -1 ELSE coalesce(best, 0) END AS best, coalesce(odd, FALSE) AS odd FROM r LEFT JOIN m ON r.id = m.own WHERE r.layer = 0)
{_row("CASE WHEN odd THEN 'overlap_geometry_error' ELSE 'overlap' END", chr(39) + '0:1' + chr(39), 'best', 50, 'x0', 'y0', 'overlap')} FROM f WHERE best < 50""",
    "redundant_via": f"{WITH}, c AS (SELECT *, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy FROM v), m AS (SELECT a.id, a.layer, a.x0, a.y0, count(*) AS n FROM c a JOIN c b ON (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 250000 GROUP BY ALL) {_row('redundant_via', 'layer', 'n', 3, 'x0', 'y0')} FROM m WHERE n < 3",
    "via_array": f"""{WITH}, t AS (SELECT a.id AS a, b.id AS b, {D2} AS d2, a.x0, a.y0 FROM v a JOIN v b ON a.id <> b.id AND {D2} > 0 AND {D2} <= 40000),
reach AS (SELECT id, id AS other FROM v UNION SELECT reach.id, t.b FROM reach JOIN t ON reach.other = t.a),
g AS (SELECT id, min(other) AS grp FROM reach GROUP BY id), big AS (SELECT grp FROM g GROUP BY grp HAVING count(*) > 3),
m AS (SELECT grp, arg_min(t.d2, (t.a, t.b)) AS d2, arg_min(t.x0, (t.a, t.b)) AS x, arg_min(t.y0, (t.a, t.b)) AS y FROM t JOIN g ON g.id = t.a JOIN big USING (grp) WHERE t.a < t.b AND t.d2 < 40000 GROUP BY grp)
{_row('via_array_spacing', '9', _root('d2'), 200, 'x', 'y')} FROM m""",
    "max_distance_to_tap": f"""{WITH}, c AS (SELECT id, layer, 0 AS k, x0 AS x, y0 AS y FROM r WHERE layer = 3 UNION ALL SELECT id, layer, 1, x1, y0 FROM r WHERE layer = 3 UNION ALL SELECT id, layer, 2, x1, y1 FROM r WHERE layer = 3 UNION ALL SELECT id, layer, 3, x0, y1 FROM r WHERE layer = 3),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM r t WHERE t.layer = 2 AND (c.x - (t.x0 + t.x1) // 2) * (c.x - (t.x0 + t.x1) // 2) + (c.y - (t.y0 + t.y1) // 2) * (c.y - (t.y0 + t.y1) // 2) <= 360000)),
m AS (SELECT id, layer, arg_min(x, k) AS x, arg_min(y, k) AS y FROM f GROUP BY id, layer) {_row('max_distance_to_tap', 'layer', '0', 600, 'x', 'y')} FROM m""",
    "density_tumbling": f"{_D} {_bad()}",
    "density_sliding": f"{WITH}, {_windows(STEP)} {_bad()}",
    "density_gradient": f"{_D} {_row('density_gradient', 'layer', 'abs(a.ppm - b.ppm)', STEEP, 'a.x', 'a.y').replace('CAST(layer', 'CAST(a.layer')} FROM d a JOIN d b ON a.layer = b.layer AND ((b.wx = a.wx + 1 AND b.wy = a.wy) OR (b.wx = a.wx AND b.wy = a.wy + 1)) WHERE abs(a.ppm - b.ppm) > {STEEP}",
    "cmp_thickness": f"{_D} SELECT layer, x, y, CAST(500 + ppm * 80 // 1000000 AS BIGINT) AS thickness FROM d",
    "merge_groups": f"{WITH}, {GROUPS} SELECT r.id, r.layer, g.grp FROM r JOIN g USING (id)",
    "union_area": f"{WITH}, {GROUPS}, {_UNION} SELECT grp, area FROM area",
    "min_area": f"{WITH}, {GROUPS}, {_UNION}, low AS (SELECT grp, layer, arg_min(x0, (x0, y0)) AS x, arg_min(y0, (x0, y0)) AS y FROM r JOIN g USING (id) GROUP BY grp, layer) {_row('min_area', 'layer', 'area', 6000, 'x', 'y')} FROM area JOIN low USING (grp) WHERE area < 6000",
}

"""Layouts derived from the driver's tables, as SQL that Spark and DuckDB read alike.

All arithmetic is on integers, the die grows with the number of rows so that the
density stays, and coordinates aren't linear in one key, so shapes don't fall
on a lattice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "part", "customer", "supplier", "nation", "lineitem", "events")

RECTS = """SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INT) AS layer, x0, y0,
  x0 + 60 + (o_orderkey * 31) % 140 AS x1, y0 + 60 + (o_orderkey * 17) % 240 AS y1
FROM (SELECT o_orderkey,
    (p * 31 + o_custkey * 7907 + o_orderkey * 13) % die AS x0,
    (p * p % 1000003 * 17 + o_custkey * o_custkey % 999983 + o_orderkey * 104729) % die AS y0
  FROM (SELECT o_orderkey, o_custkey, CAST(FLOOR(o_totalprice) AS BIGINT) AS p,
      (SELECT CAST(FLOOR(SQRT(COUNT(*))) AS BIGINT) * 330 FROM orders) AS die FROM orders) o) r"""

#: Cuts of 40 x 40 inside or at the border of every box.
VIAS = f"""SELECT id, 9 AS layer, vx AS x0, vy AS y0, vx + 40 AS x1, vy + 40 AS y1
FROM (SELECT id, x0 + id * 7 % 23 AS vx, y0 + id * 11 % 21 AS vy FROM ({RECTS}) b) v"""


def _ring(k: str) -> tuple[str, str]:
    """Corner ``k`` of a box, of an L for every third id, and of a U for the next one; counter-clockwise."""
    pick = lambda c: f"CASE {k} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(c.split(", "))) + " END"
    at = lambda axis, ell, you, box: f"CASE id % 3 WHEN 0 THEN {pick(ell)} WHEN 1 THEN {pick(you)} ELSE {pick(box)} END AS {axis}"
    return (
        at("x", "x0, x1, x1, x0 + 35, x0 + 35, x0", "x0, x1, x1, x1 - 20, x1 - 20, x0 + 20, x0 + 20, x0", "x0, x1, x1, x0"),
        at("y", "y0, y0, y0 + 30, y0 + 30, y1, y1", "y0, y0, y1, y1, y0 + 20, y0 + 20, y1, y1", "y0, y0, y1, y1"),
    )


_CORNERS = " UNION ALL ".join(f"SELECT {k} AS k" for k in range(8))
_N = "CASE id % 3 WHEN 0 THEN 6 WHEN 1 THEN 8 ELSE 4 END"
VERTICES = f"""SELECT id, layer, k AS vi, {', '.join(_ring('k'))}
FROM ({RECTS}) b JOIN ({_CORNERS}) c ON k < {_N}"""
EDGES = f"""SELECT id, layer, k AS ei, {', '.join(_ring('k'))}, {', '.join(s.replace(' AS x', ' AS nx').replace(' AS y', ' AS ny') for s in _ring(f'((k + 1) % ({_N}))'))}
FROM ({RECTS}) b JOIN ({_CORNERS}) c ON k < {_N}"""
EDGES = f"SELECT id, layer, ei, x AS x0, y AS y0, nx AS x1, ny AS y1 FROM ({EDGES}) e"

#: The same rings as one array a polygon.
RINGS = f"""SELECT id, layer, array_sort(collect_list(struct(vi, x, y))) AS ring FROM ({VERTICES}) v GROUP BY id, layer"""

#: Every sixth box with a hole of its own: one walk around the box, along a slit and around the hole.
KEYHOLES = f"""SELECT id, layer, x0, y0, x1, y1, x0 + 15 AS hx0, y0 + 15 AS hy0, x0 + 25 + id % 20 AS hx1, y0 + 30 + id % 17 AS hy1, x0 + 20 AS mx FROM ({RECTS}) b WHERE id % 6 = 0"""

#: A transistor for each part: kind, gate (even nets only), source, drain, size.
DEVICES = """SELECT p_partkey AS dev_id, CASE WHEN p_size % 2 = 0 THEN 'nmos' ELSE 'pmos' END AS kind,
  2 * (p_partkey * 7 % h) AS g, p_partkey * p_partkey % n AS s, (p_partkey * 13 + p_size) % n AS d,
  100 + p_size % 4 * 50 AS w, 20 + p_size % 3 * 10 AS l
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(FLOOR((SELECT COUNT(*) FROM part) * 0.3) AS BIGINT) AS n,
    CAST(FLOOR((SELECT COUNT(*) FROM part) * 0.15) AS BIGINT) AS h FROM part) p"""

#: A net label for each customer, at a point.
TEXTS = """SELECT c_custkey AS text_id, CAST(c_custkey % 4 AS INT) AS layer, c_mktsegment AS text,
  (c_custkey * 7907 + CAST(FLOOR(c_acctbal) AS BIGINT) * 31 + 1000000) % die AS x, (c_custkey * c_custkey * 17 + 104729 * CAST(c_nationkey AS BIGINT)) % die AS y
FROM (SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, (SELECT CAST(FLOOR(SQRT(COUNT(*))) AS BIGINT) * 330 FROM orders) AS die FROM customer) c"""

#: Branches of a supply network, with a current and a width.
BRANCHES = """SELECT s_suppkey AS branch_id, s_suppkey % 7 AS layer, CAST(FLOOR(s_acctbal * 100) AS BIGINT) AS current_ua,
  50 + s_suppkey * 13 % 400 AS width, 500 + s_suppkey * 7907 % 9000 AS length, 60 + s_nationkey AS temp_c FROM supplier"""

#: Changed tiles, one for each event.
CHANGES = """SELECT event_id, user_id % 50 AS tx, event_id % 40 AS ty, event_type AS layer, ts FROM events"""


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view over the Parquet tables of ``sf_dir``; nothing is registered in the session."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = re.sub(r"\b(" + "|".join(used) + r")\b", r"{\1}", sql)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

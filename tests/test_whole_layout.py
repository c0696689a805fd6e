"""That layout queries do their whole job: cases that cuts in them have missed."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoscan.functions import solvers
from lithoscan.operators import erc, flow_queries, graph, lvs, pex, signoff_queries

SF = "/root/testdata/sf0.001"


def test_invalidated_rules_by_brute_force(spark):
    got = {r["item"] for r in flow_queries.QUERIES["invalidated_rules"](spark, SF).collect()}
    changes = set(duckdb.sql(f"select event_type, user_id % 50, event_id % 40 from '{SF}/events.parquet'").fetchall())
    parts = duckdb.sql(f"select p_partkey, p_size from '{SF}/part.parquet'").fetchall()
    want = set()
    for key, size in parts:
        x, y, layer = key * 37 % 5000, key * 53 % 4000, ("click", "view", "purchase")[size % 3]
        if key % 2 == 0 and any(la == layer and tx * 100 <= x + 300 and x <= tx * 100 + 100 and ty * 100 <= y + 300 and y <= ty * 100 + 100 for la, tx, ty in changes):
            want.add(key)
    keys = {k for k, _ in parts}
    todo = list(want)
    while todo:
        after = todo.pop() + 500
        if after - 500 in keys and after not in want:
            want.add(after)
            todo.append(after)
    assert got == want


def chains(spark, lengths):
    rows, net = [], 0
    for n in lengths:
        for _ in range(n):
            rows.append((len(rows), "nmos", -1 - len(rows), net, net + 1, 1, 1))
            net += 1
        net += 1
    return spark.createDataFrame(rows, "dev_id long, kind string, g long, s long, d long, w long, l long")


def test_refinement_settles_or_raises(spark):
    pins = lvs.device_pins(chains(spark, [30]), "layout")
    with pytest.raises(RuntimeError):
        graph.refine(pins, max_rounds=5)
    assert graph.refine(pins)[0].select("cls").distinct().count() == 15


def test_long_chains_of_unequal_split_differ(spark):
    checks = [r["check"] for r in lvs.compare(chains(spark, [204, 212]), chains(spark, [208, 208])).collect()]
    assert "topology" in checks


def netted_boxes(spark, n=160):
    """Boxes of three layers, some long, flat or equal, some of one net and some of none; all within a few rows."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x, y = rng.randrange(0, 4000), rng.randrange(0, 300)
        w, h = rng.choice((40, 90, 2500)), rng.choice((0, 35, 60, 290))
        rows.append((i, rng.choice((0, 0, 1, 9)), x, y, x + w, y + h, rng.choice((None, 4, i, i))))
    rows += [(n, 0, 0, 0, 50, 50, 7), (n + 1, 0, 90, 0, 140, 50, 8), (n + 2, 0, 90, 0, 140, 50, 9)]
    return spark.createDataFrame(rows, "id long, layer int, x0 long, y0 long, x1 long, y1 long, net long")


def by_net(t):
    return {r["net"]: pytest.approx((r["ohm"], r["ground_af"], r["coupling_af"]), rel=1e-9, abs=1e-9) for r in t.collect()}


@pytest.mark.parametrize(("cutoff", "block"), [(None, 20_000), (None, 7), (200, 20_000)])
def test_sums_by_net_are_those_of_all_pairs(spark, monkeypatch, cutoff, block):
    monkeypatch.setattr(pex, "BLOCK", block)
    monkeypatch.setattr(pex, "COLUMNS", 5)
    boxes, layers = netted_boxes(spark), pex.layer_table(spark, signoff_queries.LAYERS)
    want = by_net(pex.by_net(pex.extract(boxes.drop("net"), layers, cutoff=cutoff), boxes.where("net is not null")))
    got = {r["net"]: (r["ohm"], r["ground_af"], r["coupling_af"]) for r in pex.extract_by_net(boxes, layers, cutoff=cutoff).collect()}
    assert got == want and -1 in got


def test_slabs_do_not_change_the_coupling(spark):
    boxes, layers = netted_boxes(spark).where("net is not null"), pex.layer_table(spark, signoff_queries.LAYERS)
    sums = [{r["net"]: r["af"] for r in pex.coupling_by_net(boxes, layers, slab=s).groupBy("net").agg(F.sum("af").alias("af")).collect()} for s in (10, 64, 100_000)]
    assert sums[0] == pytest.approx(sums[2], abs=1e-9) and sums[1] == pytest.approx(sums[2], abs=1e-9)


def shuffled_rows(spark, df):
    """Rows that the stages of one run have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    total = lambda: sum((s := stages()).apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = total()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


@pytest.mark.parametrize("query", ["pex_by_net", "pex_pi_model"])
def test_coupled_pairs_are_not_shuffled(spark, monkeypatch, query):
    """300 boxes side by side make 44,850 pairs."""
    rows = [(i, 0, 100 * i, 0, 100 * i + 50, 50, i) for i in range(300)]
    boxes = spark.createDataFrame(rows, "id long, layer int, x0 long, y0 long, x1 long, y1 long, net long")
    monkeypatch.setattr(signoff_queries, "_nodes", lambda s, d: boxes.drop("net"))
    monkeypatch.setattr(signoff_queries, "_nets", lambda s, d: boxes)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert 0 < shuffled_rows(spark, signoff_queries.QUERIES[query](spark, SF)) < 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


DEVICE = "dev_id long, kind string, g long, s long, d long"


def test_first_supply_short_by_brute_force(spark):
    """Ends that are gates, equal, null or in either order; ids with several rows, and rows twice."""
    rng = random.Random(5)
    for n in (4, 8, 30, 60):
        some = lambda *v: rng.choice(v)
        rows = [(rng.randrange(n), some("nmos", "pmos"), some(1, 2, 3, None), some(1, 10, 11, 12, 13, 14, None), some(10, 11, 12, 13, 14, 15)) for _ in range(n)]
        rows += rows[:2] + [(9, "nmos", 1, 20, 21)]
        gates = {g for _, _, g, _, _ in rows}
        ends = {(i, k, g, e) for i, k, g, *se in rows for e in se if None not in (g, e) and e not in gates}
        shared = lambda a, b: {x[2:] for x in ends if x[:2] == (a, "nmos")} & {x[2:] for x in ends if x[:2] == (b, "pmos")}
        want = min(((a, b) for a in range(n) for b in range(n) if len(shared(a, b)) >= 2), default=None)
        assert [tuple(r) for r in erc.supply_short(spark.createDataFrame(rows, DEVICE)).collect()] == [want] * (want is not None)


def test_supply_short_makes_no_pairs(spark):
    """800 devices on one gate and two nets make 160,000 pairs."""
    devices = spark.createDataFrame([(i, ("nmos", "pmos")[i % 2], 1, 5, 6) for i in range(800)], DEVICE)
    assert [tuple(r) for r in erc.supply_short(devices).collect()] == [(0, 1)]
    assert 0 < shuffled_rows(spark, erc.supply_short(devices)) < 10_000


def test_long_chains_are_solved():
    """A tree 20,000 branches deep: conjugate gradient does not converge on it in 20,000 rounds."""
    edges = [(k, k - 1 - k % 3, 1.0 + k % 5) for k in range(60_000) if k - 1 - k % 3 > 0]
    got = solvers.solve_grid(edges, {2: 1.2}, {a: 0.001 for a, _, _ in edges})
    below, want = {a: 1 for a, _, _ in edges}, {2: 1.2}
    for a, b, _ in reversed(edges):
        below[b] = below.get(b, 0) + below[a]
    for a, b, ohm in edges:
        want[a] = want[b] - ohm * below[a] * 0.001
    assert got.keys() == want.keys() and max(abs(got[n] - want[n]) for n in want) < 1e-7


@pytest.mark.parametrize("few", [-1, 1, 3, 8, 1000])
def test_networks_by_dense_solution(monkeypatch, few):
    """Meshes with double branches, loops on one node and several fixed nodes, however many nodes are eliminated."""
    monkeypatch.setattr(solvers, "FEW", few)
    rng = random.Random(few)
    for n, m in ((2, 2), (12, 20), (40, 160), (60, 900)):
        edges = [(k, rng.randrange(k), 0.5 + rng.random()) for k in range(1, n)] + [(rng.randrange(n), rng.randrange(n), 0.5 + rng.random()) for _ in range(m)]
        fixed, loads = {0: 1.2, n - 1: 0.9}, {k: rng.random() for k in range(0, n, 2)}
        g, i = np.zeros((n, n)), np.zeros(n)
        for a, b, ohm in edges:
            for p, q in ((a, b), (b, a)):
                g[p, p] += 1 / ohm
                g[p, q] -= 1 / ohm
        for k, amps in loads.items():
            i[k] = -amps
        for k, v in fixed.items():
            g[k], i[k] = 0, v
            g[k, k] = 1
        got = solvers.solve_grid(edges, fixed, loads)
        assert [got[k] for k in range(n)] == pytest.approx(list(np.linalg.solve(g, i)), abs=1e-7)

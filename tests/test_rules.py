"""Design rules on hand-computed layouts, and spatial joins against brute force."""

import random

import pytest

from lithoscan.operators import derived, drc, graph, lvs, pex, spatial

BOX = "id long, layer int, x0 long, y0 long, x1 long, y1 long"


def boxes(spark, *rows, layer=7, first=0):
    return spark.createDataFrame([(first + i, layer, *r) for i, r in enumerate(rows)], BOX)


def found(df):
    return sorted((r["kind"], r["measured"], r["limit"], r["x"], r["y"]) for r in df.collect())


@pytest.mark.parametrize(
    ("second", "want"),
    [((280, 0, 480, 200), [("min_spacing", 80, 100, 200, 0)]), ((300, 0, 500, 200), []), ((200, 0, 400, 200), [])],
)
def test_spacing(spark, second, want):
    assert found(drc.min_spacing(boxes(spark, (0, 0, 200, 200), second), 100)) == want


def test_one_merged_shape_has_notches(spark):
    u = boxes(spark, (0, 0, 50, 200), (0, 0, 200, 50), (120, 0, 200, 200))
    assert found(drc.min_spacing(u, 100)) == [("notch", 70, 100, 50, 0)]
    assert found(drc.min_spacing(u, 100, strict=True)) == [("min_spacing", 70, 100, 50, 0)]
    filled = boxes(spark, (0, 0, 50, 200), (0, 0, 200, 200), (120, 0, 200, 200))
    assert found(drc.min_spacing(filled, 100)) == []


def test_corners(spark):
    two = boxes(spark, (0, 0, 200, 200), (260, 280, 460, 480))
    assert found(drc.corner_to_corner(two, 150)) == [("corner_to_corner", 100, 150, 200, 200)]
    assert found(drc.min_spacing(two, 100)) == []


def test_one_box_rules(spark):
    assert found(drc.min_width_rect(boxes(spark, (0, 0, 80, 400)), 100)) == [("min_width", 80, 100, 0, 0)]
    assert found(drc.min_area(boxes(spark, (0, 0, 100, 100)), 40_000)) == [("min_area", 10_000, 40_000, 0, 0)]
    assert found(drc.min_area(boxes(spark, (0, 0, 200, 200)), 40_000)) == []
    assert found(drc.min_area(boxes(spark, (0, 0, 200, 100), (100, 0, 300, 100)), 40_000)) == [("min_area", 30_000, 40_000, 0, 0)]
    v = spark.createDataFrame([(0, 7, x, y) for x, y in ((3, 0), (203, 0), (203, 200), (3, 200))], "id long, layer int, x long, y long")
    assert sorted(r["measured"] for r in drc.off_grid(v, 5).collect()) == [3, 3, 203, 203]


@pytest.mark.parametrize(("inner", "want"), [((40, 40, 260, 260), 40), ((0, 40, 260, 260), 0), ((50, 50, 250, 250), None), ((400, 0, 500, 100), 0)])
def test_enclosure(spark, inner, want):
    got = found(drc.min_enclosure(boxes(spark, inner, layer=9), boxes(spark, (0, 0, 300, 300)), 50))
    assert got == ([] if want is None else [("min_enclosure", want, 50, inner[0], inner[1])])


def test_vias_and_density(spark):
    assert found(drc.redundant_via(boxes(spark, (0, 0, 100, 100)), 2, 500)) == [("redundant_via", 1, 2, 0, 0)]
    assert found(drc.density(boxes(spark, (0, 0, 1000, 1000)), 2000, low=300_000)) == [("min_density", 250_000, 300_000, 0, 0)]


def test_parasitics(spark):
    layers = pex.layer_table(spark, [pex.Layer(7, 0.1, 25.0, 40.0, 100.0, 200.0), pex.Layer(9, 0.08, 15.0, 30.0, 80.0, 200.0, 10.0), pex.Layer(8, via_r=5.0)])
    wire = boxes(spark, (0, 0, 200, 2000))
    assert pex.resistance(wire, layers).first()["ohm"] == pytest.approx(1.0)
    assert pex.resistance(wire, layers).first()["ohm"] != pytest.approx(1.5)
    assert pex.ground_cap(wire, layers).first()["af"] == pytest.approx(186.0)
    two = boxes(spark, (0, 0, 200, 2000), (400, 0, 600, 2000))
    assert [r["af"] for r in pex.coupling_cap(two, layers).collect()] == [pytest.approx(200.0)]
    assert [r["af"] for r in pex.coupling_cap(two, layers, cutoff=500).collect()] == [pytest.approx(200.0)]
    cross = boxes(spark, (0, 0, 200, 200)).union(boxes(spark, (0, 0, 200, 200), layer=9, first=5))
    assert [r["af"] for r in pex.interlayer_cap(cross, layers).collect()] == [pytest.approx(0.4)]
    assert pex.via_resistance(boxes(spark, (0, 0, 50, 50), layer=8), layers).first()["ohm"] == 5.0


@pytest.mark.parametrize("seed", range(3))
def test_candidates_are_all_pairs_once(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        size = rng.choice((5, 60, 900, 5000))  # far larger than a cell, too
        x, y = rng.randrange(-3000, 3000), rng.randrange(-3000, 3000)
        rows.append((x, y, x + rng.randrange(1, size + 1), y + rng.randrange(1, size + 1)))
    near = lambda a, b, m: a[0] - m <= b[2] and b[0] - m <= a[2] and a[1] - m <= b[3] and b[1] - m <= a[3]
    t = boxes(spark, *rows)
    got = sorted((r["a_id"], r["b_id"]) for r in spatial.candidates(t, None, 70, cell=64).collect())
    assert got == [(i, j) for i in range(120) for j in range(i + 1, 120) if near(rows[i], rows[j], 70)]
    a, b = t.where("id < 60"), t.where("id >= 60")
    got = sorted((r["a_id"], r["b_id"]) for r in spatial.candidates(a, b, 30, cell=64).collect())
    assert got == [(i, j) for i in range(60) for j in range(60, 120) if near(rows[i], rows[j], 30)]


def test_boolean_against_cells(spark):
    rng = random.Random(5)
    a, b = ([(x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for x, y in ((rng.randrange(20), rng.randrange(20)) for _ in range(9))] for _ in "ab")
    cells = [{(x, y) for x0, y0, x1, y1 in s for x in range(x0, x1) for y in range(y0, y1)} for s in (a, b)]
    frames = [spark.createDataFrame([(1, *r) for r in s], "grp long, x0 long, y0 long, x1 long, y1 long") for s in (a, b)]
    want = {"union": cells[0] | cells[1], "intersection": cells[0] & cells[1], "subtraction": cells[0] - cells[1], "xor": cells[0] ^ cells[1]}
    for op, expected in want.items():
        got = [(x, y) for r in derived.boolean(*frames, op).collect() for x in range(r["x0"], r["x1"]) for y in range(r["y0"], r["y1"])]
        assert len(got) == len(set(got)) and set(got) == expected
    shrunk = {(x, y) for r in derived.shrink(frames[0], 1).collect() for x in range(r["x0"], r["x1"]) for y in range(r["y0"], r["y1"])}
    assert shrunk == {(x, y) for x, y in cells[0] if all((x + i, y + j) in cells[0] for i in (-1, 0, 1) for j in (-1, 0, 1))}


def test_components_and_closure(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {n: n for e in edges for n in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = top(x), top(y)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == top(n) for e in edges if e[0] != e[1] for n in e)
    reach = graph.closure(spark.createDataFrame([(1,)], "item long"), spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 4)], "src long, dst long"))
    assert sorted(r["item"] for r in reach.collect()) == [1, 2, 3]


def test_series_devices_are_one(spark):
    cols = "dev_id long, kind string, g long, s long, d long, w long, l long"
    chain = spark.createDataFrame([(1, "nmos", 1, 10, 11, 100, 20), (2, "nmos", 1, 11, 12, 100, 20), (3, "nmos", 1, 12, 13, 100, 20), (4, "nmos", 2, 13, 14, 100, 20)], cols)
    got = sorted((r["g"], r["s"], r["d"], r["l"]) for r in lvs.series_reduce(chain).collect())
    assert [(g, {s, d}, ln) for g, s, d, ln in got] == [(1, {10, 13}, 60), (2, {13, 14}, 20)]
    kept = lvs.series_reduce(chain, spark.createDataFrame([(11,), (12,)], "net long"))
    assert kept.count() == 4

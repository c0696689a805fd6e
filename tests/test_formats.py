"""Formats, hierarchies and field solvers."""

import random

import numpy as np
import pytest

from lithoscan.functions import fields
from lithoscan.operators import extraction, pex
from lithoscan.sources import fieldfiles, gds, hierarchy, layout, oasis, spectre, spice
from lithoscan.sources.gds import Element, Library, Structure


def library():
    leaf = [
        Element("boundary", 1, 0, [(0, 0), (10, 0), (10, 20), (0, 20), (0, 0)]), Element("boundary", 2, 3, [(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10), (0, 0)]),
        Element("path", 4, 0, [(0, 0), (50, 0), (50, -70)], width=10, pathtype=2), Element("text", 5, 1, [(3, -4)], text="vdd"),
    ]
    mid = [Element("sref", xy=[(100, -50)], sname="leaf", reflect=True, angle=90.0), Element("aref", xy=[(0, 0), (60, 0), (0, 90)], sname="leaf", columns=2, rows=3)]
    top = [Element("sref", xy=[(7, 7)], sname="leaf", mag=2.0), Element("sref", xy=[(1000, 0)], sname="mid", angle=180.0), Element("sref", xy=[(0, 2000)], sname="mid")]
    return Library("x", 1e-3, 1e-9, {n: Structure(n, e) for n, e in (("leaf", leaf), ("mid", mid), ("top", top))})


def flat(lib):
    return sorted((s.layer, s.datatype, tuple(s.ring), s.text or "") for s in gds.flatten(lib, "top"))


def rows(df):
    return sorted((r["layer"], r["datatype"], tuple((p["x"], p["y"]) for p in r["ring"]), r["text"] or "") for r in df.collect())


@pytest.mark.parametrize("compress", [False, True])
def test_oasis_round_trip(compress):
    lib = library()
    back = oasis.read(oasis.write(lib, compress))
    loose = lambda lib: sorted((a, b, tuple(sorted(r)), t) for a, b, r, t in flat(lib))
    assert loose(back) == loose(lib) and back.metre_unit == pytest.approx(1e-9)


def test_oasis_modal_values_and_repetitions():
    u, s, st = oasis._unsigned, oasis._signed, oasis._string
    raw = oasis.MAGIC + u(1) + st("1.0") + u(0) + u(1000) + u(0) + bytes(12) + u(3) + st("A") + u(13) + u(0)
    raw += u(20) + bytes([0x7F]) + u(1) + u(0) + u(5) + u(6) + s(0) + s(0) + u(1) + u(0) + u(1) + u(10) + u(20)
    raw += u(16) + u(20) + bytes([0x18]) + s(3) + s(4) + u(21) + bytes([0x20]) + u(0) + u(2) + s(4) + s(5) + u(2)
    got = [e.xy[:-1] for e in oasis.read(raw).structures["A"].elements]
    box = lambda x, y: [(x, y), (x + 5, y), (x + 5, y + 6), (x, y + 6)]
    assert got[:6] == [box(x, y) for y in (0, 20, 40) for x in (0, 10)] and got[6] == box(3, 4)
    assert got[7] == [(3, 4), (7, 4), (7, 9), (3, 9)]
    for cut in (20, 40, len(raw) - 1):
        with pytest.raises(gds.LayoutError):
            oasis.read(raw[:cut])
    with pytest.raises(gds.LayoutError):
        oasis.read(raw[:-1] + u(23))


def test_hierarchies_expand_by_joins(spark, tmp_path):
    lib = library()
    (tmp_path / "a.gds").write_bytes(gds.write(lib))
    (tmp_path / "b.oas").write_bytes(oasis.write(lib))
    assert layout.detect(oasis.write(lib)) == "oasis" and layout.detect(gds.write(lib)) == "gds"
    shapes, places = hierarchy.tables(spark, str(tmp_path))
    got = hierarchy.expand(shapes, places)
    assert {r["top"] for r in got.select("top").distinct().collect()} == {"top"}
    assert rows(got.where("file like '%a.gds'")) == flat(lib)
    assert got.where("file like '%b.oas'").count() == len(flat(lib))
    window = (0, 1900, 130, 2100)
    seen = rows(hierarchy.expand(shapes.where("file like '%a.gds'"), places.where("file like '%a.gds'"), "top", window))
    meets = lambda r: min(x for x, _ in r) <= 130 and max(x for x, _ in r) >= 0 and min(y for _, y in r) <= 2100 and max(y for _, y in r) >= 1900
    assert seen == [r for r in flat(lib) if meets(r[2])] and seen
    assert sorted(map(tuple, hierarchy.unmapped(shapes.where("file like '%a.gds'"), spark.createDataFrame([(1, 0), (4, 0)], "layer int, datatype int")).collect())) == [(2, 3, 1), (5, 1, 1)]


def test_written_layouts_read_back(spark, tmp_path):
    polygons = spark.createDataFrame([("A", 1, 0, [{"x": 0, "y": 0}, {"x": 9, "y": 0}, {"x": 9, "y": 5}]), ("B", 2, 1, [{"x": 1, "y": 1}, {"x": 4, "y": 1}, {"x": 4, "y": 8}, {"x": 1, "y": 8}])], "cell string, layer int, datatype int, ring array<struct<x:int,y:int>>")
    for form in ("gds", "oasis"):
        layout.write_layout(polygons, str(tmp_path / form), form=form)
        got = {r["cell"]: hierarchy.library(bytes(r["content"])).structures[r["cell"]].elements[0].xy for r in layout.contents(spark, str(tmp_path / form)).collect()}
        assert got["A"][:3] == [(0, 0), (9, 0), (9, 5)] and set(got["B"]) == {(1, 1), (4, 1), (4, 8), (1, 8)}


def test_tiles(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 90, 90), (2, 150, 20, 260, 60)], "id long, x0 long, y0 long, x1 long, y1 long")
    assert hierarchy.tile_grid(boxes, 100).count() == 3
    tiled = hierarchy.in_tiles(boxes, 100, 15)
    assert {(r["id"], r["tx"], r["owned"]) for r in tiled.where("ty = 0").collect()} == {(1, 0, True), (1, -1, False), (1, 1, False), (2, 1, True), (2, 2, False)}
    assert tiled.where("owned").count() == 2
    a, b = hierarchy.tile_hashes(tiled, ["id"]), hierarchy.tile_hashes(tiled.orderBy("id", ascending=False), ["id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_spectre():
    text = """simulator lang=spectre
global vdd
model nch bsim4 type=n
subckt inv (a y vss) // comment
 parameters w=1u
 m0 (y a vss vss) nch w=w l=0.1u
 r1 (y vdd) resistor r=1k
ends inv
i0 (x z 0) inv \\
 w=2u
"""
    got = spice.flatten(spectre.parse(text))
    assert [(d.path, d.kind, d.nets, d.params) for d in got] == [("i0/m0", "nmos", ("z", "x", "0", "0"), {"w": pytest.approx(2e-6), "l": pytest.approx(1e-7)}), ("i0/r1", "r", ("z", "vdd"), {"value": 1000.0})]
    for bad in ("altergroup a {", "subckt a (b)", "m0 (a b) nmos", "include \"x\""):
        with pytest.raises(ValueError):
            spectre.parse(bad)


def test_field_files():
    panels = fieldfiles.panels("0 title\nQ a 0 0 0 1 0 0 1 1 0 0 1 0\nT b 0 0 1 1 0 1 0 1 1\nN a plate\n", (0, 0, 2))
    assert [(p.conductor, len(p.corners), p.corners[0]) for p in panels] == [("plate", 4, (0, 0, 2)), ("b", 3, (0, 0, 3))]
    files = {"p": "0 t\nQ a 0 0 0 1 0 0 1 1 0 0 1 0\n"}
    got = fieldfiles.surfaces("* list\nC p 1.0 0 0 0 +\nC p 1.0 0 0 5\nD p 1.0 3.9 0 0 0 0 0 9\n", files.__getitem__)
    assert [s.panels[0].conductor for s in got[:2]] == ["a%1", "a%1"] and (got[2].outside, got[2].inside) == (1.0, 3.9)
    loop = fieldfiles.inductors("* t\n.units um\n.default nwinc=2\nN1 x=0 y=0 z=0\nN2 x=100 y=0 z=0\n+\nE1 N1 N2 w=2 h=1\n.external N1 N2 p\n.freq fmin=1e6 fmax=1e8 ndec=2\n.end")
    assert loop.segments[0].sigma == pytest.approx(5.8e7) and loop.segments[0].nw == 2 and loop.ports == [("n1", "n2", "p")]
    assert [round(f) for f in fields.sweep(*loop.sweep)] == [1000000, 3162278, 10000000, 31622777, 100000000]


def test_capacitances_are_the_known_ones():
    assert fields.capacitance(fields.plate(1, 1, 14, 14), [0] * 196)[0, 0] == pytest.approx(40.8e-12, rel=0.03)
    ball = fields.icosphere(1.0, 2)
    assert fields.capacitance(ball, [0] * len(ball))[0, 0] == pytest.approx(4 * np.pi * fields.EPS0, rel=0.02)
    two = [*fields.plate(1, 1, 8, 8, 0.0), *fields.plate(1, 1, 8, 8, 0.05)]
    c = fields.capacitance(two, [0] * 64 + [1] * 64)
    assert -c[0, 1] > fields.EPS0 / 0.05 and c[0, 0] == pytest.approx(c[1, 1], rel=1e-6)
    inner, outer = fields.icosphere(1.0, 1), fields.icosphere(1.5, 1)
    coated = fields.dielectric_capacitance(inner, [0] * len(inner), [4.0] * len(inner), outer, [(1.0, 4.0)] * len(outer))[0, 0]
    assert coated == pytest.approx(4 * np.pi * fields.EPS0 / ((1 - 1 / 1.5) / 4 + 1 / 1.5), rel=0.15)
    with_tree = fields.capacitance(fields.plate(1, 1, 14, 14), [0] * 196, direct=10)[0, 0]
    assert with_tree == pytest.approx(fields.capacitance(fields.plate(1, 1, 14, 14), [0] * 196)[0, 0], rel=1e-3)


def test_panel_potentials_are_the_integral():
    square = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0.0]])
    g = (np.arange(300) + 0.5) / 300
    x, y = np.meshgrid(g, g)
    for p in ([0.3, 0.4, 0.7], [2, 2, 0.0], [-0.5, 0.2, -0.3], [1.5, 0.5, 0]):
        assert fields.panel_potential(square, np.array([p]))[0] == pytest.approx((1 / np.sqrt((x - p[0]) ** 2 + (y - p[1]) ** 2 + p[2] ** 2)).mean(), rel=1e-4)


def test_inductances():
    a, b = fields.bar([0, 0, 0], [1e-3, 0, 0], 1e-6, 1e-6, 5.8e7), fields.bar([0, 2e-4, 0], [1e-3, 2e-4, 0], 1e-6, 1e-6, 5.8e7)
    assert fields.mutual_inductance(a, b) == pytest.approx(fields.filament_mutual(a.start, a.end, b.start, b.end, 60), rel=1e-6)
    corner = [[0, 0, 0], [1e-3, 0, 0], [1e-3, 1e-3, 0], [0, 1e-3, 0], [0, 1e-5, 0]]
    bars = [fields.bar(corner[i], corner[i + 1], 1e-5, 1e-6, 5.8e7) for i in range(4)]
    z = fields.port_impedance(5, [(0, 1), (1, 2), (2, 3), (3, 4)], bars, [(0, 4)], [1e3, 1e9])[:, 0, 0]
    assert z[0].real == pytest.approx(sum(x.ohm for x in bars)) and z[1].imag / (2 * np.pi * 1e9) == pytest.approx(z[0].imag / (2 * np.pi * 1e3), rel=1e-6)
    m = fields.meshes(4, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 0)])
    inc = np.zeros((5, 4))
    for k, (x, y) in enumerate([(0, 1), (1, 2), (2, 0), (2, 3), (3, 0)]):
        inc[k, x], inc[k, y] = -1, 1
    assert m.shape == (2, 5) and not (m @ inc).any()


def test_linear_systems():
    rng = np.random.default_rng(1)
    a, b = rng.random((30, 30)) + 30 * np.eye(30), rng.random(30)
    want = np.linalg.solve(a, b)
    assert np.allclose(fields.lu_solve(fields.lu(a), b), want) and np.allclose(fields.refined(a, b), want)
    assert np.allclose(fields.gmres(lambda v: a @ v, b, fields.block_jacobi(a, 7), 1e-10), want)
    z = a + 1j * rng.random((30, 30))
    assert np.allclose(fields.gmres_many(lambda v: z @ v, np.stack([b, 2 * b], axis=1).astype(complex), tolerance=1e-10)[:, 1], np.linalg.solve(z, 2 * b))
    x, y = np.linspace(0, 1, 60), np.linspace(3, 4, 50)
    k = 1 / np.abs(x[:, None] - y[None])
    u, v = fields.low_rank(lambda i, j: k[np.ix_(i, j)], k.shape)
    assert u.shape[1] < 12 and np.abs(u @ v - k).max() < 1e-5
    with pytest.raises(np.linalg.LinAlgError):
        fields.lu(np.zeros((2, 2)))


def test_field_extraction_of_two_wires(spark):
    stack = extraction.process_stack([1, 2], {2: (700.0, 300.0)})
    assert (stack[1].bottom, stack[1].top, extraction.film_distance(stack, 1, 2)) == (100.0, 300.0, 400.0)
    rects = spark.createDataFrame([(1, 1, 0, 0, 200, 2000, 5), (2, 1, 400, 0, 600, 2000, 6), (3, 1, 90_000, 0, 90_200, 900, 7)], "id long, layer int, x0 long, y0 long, x1 long, y1 long, net long")
    got = {(r["a"], r["b"]): r["af"] for r in extraction.field_capacitance(rects, stack, 1000, panel_nm=400.0).collect()}
    assert set(got) == {(5, 5), (5, 6), (6, 6), (7, 7)} and got[5, 6] < 0 and got[5, 5] == pytest.approx(got[6, 6], rel=1e-6) and got[5, 5] > -got[5, 6]
    few = extraction.field_capacitance(rects, stack, 1000, most_panels=10)
    assert {r["status"] for r in few.collect()} == {"capacity"}
    layers = [pex.Layer(1, 0.1, 25.0, 40.0, 100.0, 200.0)]
    nets = rects.select("id", "net")
    with pytest.raises(ValueError):
        extraction.extract(rects.drop("net"), layers, nets, "magic")
    assert extraction.extract(rects.drop("net"), layers, nets, "magic", checked=False).count() == 3
    solved = {r["net"]: r for r in extraction.extract(rects.drop("net"), layers, nets, "field", stack).collect()}
    assert solved[5]["coupling_af"] > 0 and solved[7]["coupling_af"] == 0 and solved[7]["ground_af"] > 0


def test_rc_graph_joins_what_touches(spark):
    rects = spark.createDataFrame([(1, 1, 0, 0, 200, 1000), (2, 1, 200, 0, 1200, 200), (3, 1, 400, 400, 600, 1400)], "id long, layer int, x0 long, y0 long, x1 long, y1 long")
    nets = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, net long")
    found = pex.extract(rects, pex.layer_table(spark, [pex.Layer(1, 0.1, 25.0, 40.0, 100.0, 200.0)]))
    nodes, edges = extraction.rc_graph(rects, found, nets)
    assert nodes.count() == 3
    got = {(r["kind"], r["a"], r["b"]): r["ohm"] for r in edges.collect()}
    assert got["resistance", 1, 2] == pytest.approx(0.5) and {k[1:] for k in got if k[0] == "coupling"} == {(1, 3), (2, 3)}
    measures = {r["measure"]: r["value"] for r in extraction.report(found, rects).collect()}
    assert measures["ohm"] == pytest.approx(1.5) and 0 < measures["coupling_share"] < 1


def test_random_rings_survive_both_formats():
    rng = random.Random(3)
    ring = [(0, 0)]
    for _ in range(30):
        ring.append((ring[-1][0] + rng.randrange(1, 10**6), rng.randrange(-(10**6), 10**6)))
    lib = Library("r", structures={"c": Structure("c", [Element("boundary", 300, 70, [*ring, ring[0]])])})
    assert oasis.read(oasis.write(lib)).structures["c"].elements[0].xy == [*ring, ring[0]] == gds.read(gds.write(lib)).structures["c"].elements[0].xy

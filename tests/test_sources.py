"""Streams, netlists, kernels, solvers, decks and results."""

import pytest
from pyspark.sql import functions as F

from lithoscan.functions import kernels, solvers
from lithoscan.plans import deck, results
from lithoscan.sources import gds, layout, spice


def library():
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    leaf = gds.Structure("leaf", [gds.Element("boundary", 7, 0, square, properties=[(1, "p")]), gds.Element("text", 7, 1, [(5, 5)], text="net")])
    top = gds.Structure("top", [
        gds.Element("sref", sname="leaf", xy=[(100, 0)], reflect=True, angle=90.0),
        gds.Element("aref", sname="leaf", xy=[(0, 0), (60, 0), (0, 40)], columns=3, rows=2),
        gds.Element("path", 8, 0, [(0, 0), (100, 0), (100, 50)], width=10),
    ])
    return gds.Library("lib", 1e-3, 1e-9, {"leaf": leaf, "top": top})


def test_stream_round_trip_and_flattening():
    data = gds.write(library())
    assert gds.write(gds.read(data)) == data
    shapes = list(gds.flatten(gds.read(data)))
    assert len(shapes) == 7 * 2 + 2
    assert sorted(min(s.ring) for s in shapes if s.layer == 7 and s.text is None)[:3] == [(0, 0), (0, 20), (20, 0)]
    assert sorted(shapes[0].ring) == [(100, 0), (100, 10), (110, 0), (110, 10)]
    assert gds.unmapped(library(), {(7, 0)}) == [(7, 1, 1), (8, 0, 1)]
    with pytest.raises(gds.LayoutError):
        gds.read(data[:-6])
    with pytest.raises(ValueError, match="unit"):
        gds.check_units(library(), 2.0)
    loop = gds.Library("l", structures={"a": gds.Structure("a", [gds.Element("sref", sname="a", xy=[(0, 0)])])})
    with pytest.raises(ValueError, match="cycle"):
        list(gds.flatten(loop, "a"))


def test_reals():
    for v in (0.0, 1.0, -2.5, 1e-9, 1e-3, 123456.789):
        assert gds.real8(gds.to_real8(v)) == pytest.approx(v, rel=1e-14)


def test_layout_files_as_tables(spark, tmp_path):
    (tmp_path / "a.gds").write_bytes(gds.write(library()))
    t = layout.read_layout(spark, str(tmp_path), dbu_nm=1.0)
    assert t.count() == 16
    polygons = t.where("text is null").withColumn("id", F.monotonically_increasing_id())
    rects = layout.polygon_rects(polygons)
    assert rects.count() == 9 and layout.polygon_validity(polygons).count() == 0


def test_netlists():
    text = """* test
.param wn=0.4u
.subckt inv a y vdd vss w='2*wn'
MP y a vdd vdd pmos W={w} L=0.15u
MN y a vss vss nmos W=wn
+ L=150n
.ends
X1 in mid vdd vss inv
X2 mid out vdd vss inv w=1u
R1 out 0 1.5k
.end"""
    found = spice.flatten(spice.parse(text.replace("'2*wn'", "0.8u").replace("W=wn", "W=0.4u")))
    assert [d.path for d in found] == ["X1/MP", "X1/MN", "X2/MP", "X2/MN", "R1"]
    assert found[2].params["w"] == pytest.approx(1e-6) and found[4].params["value"] == 1500
    assert found[0].nets == ("mid", "in", "vdd", "vdd")
    rows, _ = spice.device_rows(found)
    assert len(rows) == 4 and rows[0][1] == "pmos"
    assert spice.number("2meg") == 2e6 and spice.evaluate("'2*(a+1)^2'", {"a": 2.0}) == 18
    assert spice.expand_bus("A[1:0]") == ["A[1]", "A[0]"]
    for bad in (".tran 1n", "X1 a b none", ".subckt a b\n.subckt c d"):
        with pytest.raises(ValueError):
            spice.flatten(spice.parse(bad))


def test_kernels():
    ell = [(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)]
    assert kernels.area2(ell) == 600 and sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in kernels.decompose(ell)) == 300
    assert [kernels.point_in_ring(ell, p) for p in ((5, 5), (10, 15), (15, 15))] == ["inside", "boundary", "outside"]
    assert kernels.self_intersects([(0, 0), (10, 10), (10, 0), (0, 10)]) and not kernels.self_intersects(ell)
    assert kernels.segment_distance2((0, 0), (10, 0), (5, 3), (5, 9)) == 9
    assert sum(kernels.area2(t) for t in kernels.triangulate(ell)) == 600
    assert kernels.clipped_area(ell, (5, 5, 15, 15)) == 75
    hole = [(0, 0), (30, 0), (30, 30), (0, 30), (0, 10), (10, 10), (10, 20), (20, 20), (20, 10), (10, 10), (0, 10)]
    assert [abs(kernels.area2(h)) for h in kernels.keyhole_holes(hole)] == [200]
    with pytest.raises(ValueError):
        kernels.decompose([(0, 0), (10, 5), (0, 10), (5, 5)])


def test_solvers():
    assert solvers.effective_resistance([(1, 2, 2.0), (2, 3, 2.0), (1, 3, 4.0)], 1, 3) == pytest.approx(2.0)
    assert solvers.solve_grid([(0, 1, 1.0), (1, 2, 1.0)], {0: 1.0}, {2: 0.1})[2] == pytest.approx(0.8)
    triangle = [(1, 2), (2, 3), (1, 3)]
    assert solvers.colour(triangle, 2)[0] == "conflict" and solvers.colour(triangle, 3)[0] == "coloured"
    assert solvers.elmore([(0, 1, 2.0), (1, 2, 3.0)], {1: 1.0, 2: 1.0}, 0) == {0: 0.0, 1: 4.0, 2: 7.0}
    assert solvers.shortest_path([("a", "b", 1, 2, 1), ("b", "c", 1, 2, 1), ("a", "c", 1, 0.5, 1)], "a", "c", 1, 5) == (2.0, ["a", "b", "c"])


def test_decks():
    with pytest.raises(ValueError, match="no rule kind"):
        deck.Deck.from_json('{"rules": [{"kind": "nothing"}]}')
    with pytest.raises(ValueError, match="missing"):
        deck.Deck.from_json('{"rules": [{"kind": "min_width", "layer": "a"}]}')
    d = deck.Deck.from_json('{"variables": {"a": 2, "b": {"op": "mul", "args": [{"var": "a"}, 5]}}, "rules": [{"kind": "min_width", "layer": "m", "min": {"if": 0, "then": 1, "else": {"var": "b"}}}]}')
    assert d.rules[0].params["min"] == 10
    step = deck.Table(((0, 1), (10, 2), (20, 3)))
    assert [step.at(x) for x in (-5, 5, 10, 11, 99)] == [1, 1, 1, 2, 3] and deck.Table(((0, 0), (10, 100)), True).at(5) == 50


def test_checked_run_never_hides_a_failure(spark):
    ok = spark.createDataFrame([(1, 0, 0, 0, 200, 200)], "id long, layer int, x0 long, y0 long, x1 long, y1 long")
    d = deck.Deck.from_json('{"rules": [{"kind": "min_width", "id": "a", "layer": "m", "min": 100}, {"kind": "min_width", "id": "b", "layer": "gone", "min": 1}, {"kind": "min_width", "id": "c", "layer": "bad", "min": 1}]}')
    found, statuses = deck.run_checked(spark, d, {"m": ok, "bad": ok.drop("x0")})
    assert {r["rule_id"]: r["status"] for r in statuses.collect()} == {"a": "Clean", "b": "NotRun", "c": "Error"}
    assert found.count() == 0 and not deck.is_clean(statuses)


def test_results(spark):
    rows = spark.createDataFrame([("r", "k", "1", i, 9, i, 0) for i in (1, 2, 2)], "rule_id string, kind string, layer string, measured long, `limit` long, x long, y long")
    known = results.insert(rows.limit(0).withColumn("fingerprint", F.lit("")), rows)
    assert known.count() == 2 and results.insert(known, rows).count() == 2
    w = known.select("fingerprint", F.expr("if(measured = 1, date'2020-01-01', null)").alias("expires_on"))
    assert {r["measured"]: r["status"] for r in results.apply_waivers(known, w, "2026-01-01").collect()} == {1: "Expired", 2: "Waived"}
    assert len(results.canonical_json(known).collect()) == 2


def test_parasitics_as_text(spark, tmp_path):
    from lithoscan.sources import spef

    nets = spark.createDataFrame([(2, 0.0, 500.0, 0.0), (1, 12.5, 1000.0, 3000.0), (-1, 1.0, 0.0, 0.0)], "net long, ohm double, ground_af double, coupling_af double")
    names = spark.createDataFrame([(1, "vdd")], "net long, name string")
    for make in (spef.spef, spef.dspf):
        blocks = make(nets, "top", names)
        spef.write(blocks, str(tmp_path / make.__name__))
        text = "".join(p.read_text() for p in sorted((tmp_path / make.__name__).glob("part-*")))
        assert text == "".join(r["block"] for r in blocks.sort("net").collect())
        assert text.index("net_-1") < text.index("vdd") < text.index("net_2")
        assert spef.spef(nets.limit(0), "top").count() == 1
    found = {r["net"]: r["block"] for r in spef.spef(nets, "top", names).collect()}
    assert found[1] == "*D_NET vdd 4.00000\n*CAP\n1 vdd:1 2.00000\n2 vdd:2 2.00000\n*RES\n1 vdd:1 vdd:2 12.5000\n*END\n"
    assert "*RES" not in found[2] and found[None].startswith("*SPEF")
    assert text.endswith(".ENDS\n")

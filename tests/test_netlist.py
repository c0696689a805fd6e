"""Netlists from layouts and their comparison."""

import random

import pytest

from lithoscan.functions.matching import Part, match
from lithoscan.operators import devices, evidence, graph, lvs, netlist
from lithoscan.plans import hierarchical
from lithoscan.sources import spice
from lithoscan.sources.gds import Element, Library, Structure

BOX = "id long, layer int, x0 long, y0 long, x1 long, y1 long"
DEVICE = "dev_id long, kind string, g long, s long, d long, w long, l long"
INVERTER = [
    (1, 3, 40, 0, 60, 400), (2, 2, 0, 50, 100, 100), (3, 2, 0, 250, 100, 350), (4, 10, -10, 40, 110, 110), (5, 11, -10, 240, 110, 360), (6, 1, -20, 200, 120, 380), (7, 12, 30, 240, 70, 360),
    (20, 5, 500, 0, 900, 50), (21, 13, 550, 0, 850, 50), (22, 4, 490, 0, 520, 50), (23, 4, 880, 0, 910, 50),
]
DECK = netlist.NetDeck(
    (1, 2, 3, 4, 5), (), (devices.MosRule("n", "nmos", 3, 2, 10), devices.MosRule("p", "pmos", 3, 2, 11, ((12, "lvt"),), 1)), (devices.ResistorRule("r", 5, 13, 4, 2.0),)
)


@pytest.fixture(scope="module")
def inverter(spark):
    texts = spark.createDataFrame([(1, "in", 50, 10), (2, "out", 80, 60)], "text_id long, text string, x long, y long")
    return netlist.extract_netlist(spark.createDataFrame(INVERTER, BOX), DECK, texts)


def test_inverter(inverter):
    got = [tuple(r) for r in inverter.mos.orderBy("dev_id").collect()]
    assert got == [(0, "nmos", "standard", 0, 5, 6, None, 50, 20, 5000, 300, 0, 0), (1, "pmos", "lvt", 0, 7, 8, 1, 100, 20, 10_000, 400, 0, 0)]
    assert [tuple(r) for r in inverter.resistors.collect()] == [("r", 20, 3, 4, 400, 50, 16.0)]
    assert {(r["net"], r["name"]) for r in inverter.names.collect()} == {(0, "in"), (6, "out")}
    assert inverter.faults.count() == 0 and {r["net"] for r in inverter.floating.collect()} == {1, 2}


def test_verdicts(spark, inverter):
    ref = spark.createDataFrame([(7, "nmos", 1, 2, 3, 50, 20), (8, "pmos_lvt", 1, 4, 5, 100, 20)], DEVICE)
    match_ = netlist.run_lvs(spark, inverter, ref)
    assert match_.status == "Match" and {tuple(r) for r in match_.pairs.collect()} == {(0, 7), (1, 8)}
    assert netlist.run_lvs(spark, inverter, ref, fail_on_floating=True).status == "Mismatch"
    wide = netlist.run_lvs(spark, inverter, ref.selectExpr("dev_id", "kind", "g", "s", "d", "w + 1 as w", "l"))
    assert wide.status == "Mismatch" and "parametric" in {r["check"] for r in wide.findings.collect()}


def test_crossings_without_or_with_two_implants_are_faults(spark):
    rows = [(1, 3, 40, 0, 60, 400), (2, 2, 0, 50, 100, 100), (3, 2, 0, 250, 100, 350), (4, 10, 0, 240, 110, 360), (5, 11, 0, 240, 110, 360)]
    got = {r["diff_id"]: r["status"] for r in devices.mos_rules(spark.createDataFrame(rows, BOX), DECK.mos, [13]).collect()}
    assert got == {2: "no implant", 3: "ambiguous rule"}
    found = netlist.extract_netlist(spark.createDataFrame(rows, BOX), DECK)
    assert found.mos.count() == 0 and netlist.run_lvs(spark, found, spark.createDataFrame([], DEVICE)).status == "Error"


def test_supplies_that_look_alike_are_a_seed_conflict(spark):
    rows = spark.createDataFrame([(1, "nmos", 1, 2, 3, 1, 1), (2, "nmos", 1, 2, 4, 1, 1)], DEVICE)
    seeds = spark.createDataFrame([(3, "VDD"), (4, "VSS")], "net long, name string")
    got = netlist.run_lvs(spark, rows, rows, seeds)
    assert got.status == "Mismatch" and [r["detail"] for r in got.findings.collect()] == ["VDD and VSS can't be told apart"]
    assert netlist.run_lvs(spark, rows, rows, seeds.limit(1)).status == "Match"


def test_refinement_is_the_classes_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(("nmos", "pmos")), rng.randrange(6), rng.randrange(9), rng.randrange(9), 1, 1) for i in range(24)]
    got = {}
    for r in graph.refine(lvs.device_pins(spark.createDataFrame(rows, DEVICE), "a"))[0].collect():
        got.setdefault(r["cls"], set()).add(r["dev_id"])
    kind, nets = {r[0]: r[1] for r in rows}, {n: 0 for r in rows for n in r[2:5]}
    for _ in range(60):
        dev = {r[0]: (kind[r[0]], tuple(sorted([("g", nets[r[2]]), ("sd", nets[r[3]]), ("sd", nets[r[4]])]))) for r in rows}
        index = {v: k for k, v in enumerate(sorted(set(dev.values())))}
        around = {n: tuple(sorted((role, index[dev[r[0]]]) for r in rows for role, m in (("g", r[2]), ("sd", r[3]), ("sd", r[4])) if m == n)) for n in nets}
        index = {v: k for k, v in enumerate(sorted({(nets[n], around[n]) for n in nets}))}
        nets = {n: index[nets[n], around[n]] for n in nets}
    want = {}
    for i, c in dev.items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("seed", range(2))
def test_series_reduction_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, net = [], 100
    for _ in range(12):
        g, w, n = rng.randrange(3), rng.choice((1, 2)), rng.randrange(1, 6)
        for _ in range(n):
            rows.append((len(rows), "nmos", g, net, net + 1, w, rng.randrange(1, 5)))
            net += 1
        net += 1
    want = {}
    start = 0
    while start < len(rows):
        end = start
        while end + 1 < len(rows) and rows[end + 1][3] == rows[end][4]:
            end += 1
        part = rows[start : end + 1]
        want[part[0][3], part[-1][4]] = sum(r[6] for r in part)
        start = end + 1
    got = {(min(r["s"], r["d"]), max(r["s"], r["d"])): r["l"] for r in lvs.series_reduce(spark.createDataFrame(rows, DEVICE)).collect()}
    assert got == want


def ring(after, p):
    return [Part(f"{p}{i}", "r", (("t", f"{p}n{i}"), ("t", f"{p}n{after[i]}"))) for i in after]


def test_exact_search_decides_what_refinement_cannot():
    six, two = {i: (i + 1) % 6 for i in range(6)}, {0: 1, 1: 2, 2: 0, 3: 4, 4: 5, 5: 3}
    found = match(ring(six, "a"), ring(six, "b"))
    assert found.status == "Match" and len(found.devices) == 6
    for i in range(6):
        assert {found.nets[f"an{i}"], found.nets[f"an{six[i]}"]} == {f"bn{int(found.devices[f'a{i}'][1:])}", f"bn{six[int(found.devices[f'a{i}'][1:])]}"}
    assert match(ring(six, "a"), ring(two, "b")).status == "Mismatch"
    assert match(ring(six, "a"), ring(two, "b"), states=1).status == "Indeterminate"


SUBCKTS = """.subckt inv a y vdd vss
M1 y a vss vss nmos W=1u L=0.1u
M2 y a vdd vdd pmos W=2u L=0.1u
.ends
.subckt top in out vdd vss
X1 in m vdd vss inv
X2 m out vdd vss inv
.ends
"""


def test_hierarchies():
    a = spice.parse(SUBCKTS)
    swapped = spice.parse(SUBCKTS.replace("M1 y a vss", "M9 vss a y").replace("inv a y vdd vss", "inv y a vss vdd").replace("X1 in m vdd vss", "Xz q in vss vdd").replace("X2 m out vdd vss", "Xy out q vss vdd"))
    assert hierarchical.compare(a, swapped, "top").status == "Match"
    flat = spice.parse(SUBCKTS.split(".subckt top")[0].replace("inv", "buf") + ".subckt top in out vdd vss\nX1 in m vdd vss buf\nX2 m out vdd vss buf\n.ends")
    got = hierarchical.compare(a, flat, "top")
    assert got.status == "Match" and got.flattened == ["inv"] and "inv" not in got.cells  # compared within the top cell
    assert hierarchical.compare(a, flat, "top", options=hierarchical.HierOptions(equate={"inv": "buf"})).cells["inv"].status == "Match"
    wide = hierarchical.compare(a, spice.parse(SUBCKTS.replace("W=2u", "W=3u")), "top")
    assert wide.cells["inv"].kind == "property" and wide.status == "Mismatch"
    boxed = hierarchical.HierOptions(black_boxes=frozenset(["inv"]))
    assert hierarchical.compare(a, spice.parse(SUBCKTS.replace("W=2u", "W=3u")), "top", options=boxed).status == "Match"
    with pytest.raises(ValueError, match="cycle"):
        hierarchical.order(spice.parse(".subckt a p\nX1 p b\n.ends\n.subckt b p\nX1 p a\n.ends"), "a")


def test_cells_of_a_layout():
    shape = lambda la, x0, y0, x1, y1: Element("boundary", la, 0, [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])
    text = lambda la, x, y, t: Element("text", la, 0, [(x, y)], text=t)
    cuts = [shape(6, x, y, x + 20, y + 20) for x in (5, 75) for y in (60, 290)]
    inv = Structure("INV", [shape(3, 40, 0, 60, 400), shape(2, 0, 50, 100, 100), shape(2, 0, 250, 100, 350), shape(10, -10, 40, 110, 110), shape(11, -10, 240, 110, 360), *cuts, shape(7, 0, 20, 30, 90), shape(7, 0, 280, 30, 340), shape(7, 70, 50, 110, 300), text(20, 50, 10, "a"), text(21, 100, 200, "y"), text(21, 10, 60, "vss"), text(21, 10, 300, "vdd")])
    wires = [shape(7, 0, 20, 1030, 30), shape(7, 0, 330, 1030, 340), shape(3, 45, -100, 55, 10), shape(7, 100, 200, 1000, 210), shape(6, 985, 195, 995, 205), shape(3, 980, 190, 1045, 210), shape(7, 1100, 200, 1200, 220)]
    names = [text(20, 50, -50, "in"), text(21, 1150, 210, "out"), text(21, 500, 25, "vss"), text(21, 500, 335, "vdd")]
    top = Structure("TOP", [Element("sref", xy=[(0, 0)], sname="INV"), Element("sref", xy=[(1000, 0)], sname="INV"), *wires, *names])
    deck = hierarchical.CellDeck(((3, 0), (2, 0), (7, 0)), {(6, 0): ((3, 0), (2, 0), (7, 0))}, (("n", "nmos", (3, 0), (2, 0), (10, 0)), ("p", "pmos", (3, 0), (2, 0), (11, 0))), {(20, 0): (3, 0), (21, 0): (7, 0)})
    cells = hierarchical.layout_cells(Library("x", structures={"INV": inv, "TOP": top}), deck)
    ref = spice.parse(".subckt inv a y vdd vss\nM1 y a vss vss nmos W=50n L=20n\nM2 y a vdd vdd pmos W=100n L=20n\n.ends\n.subckt top in out vdd vss\nX1 in m vdd vss inv\nX2 m out vdd vss inv\n.ends")
    for i in ref.subckts["inv"].items:
        i.nets = i.nets[:3]  # the layout's cells have no bulk
    assert hierarchical.compare(cells, ref, "top").status == "Match"


def test_discharge_paths(spark):
    needs = spark.createDataFrame([("n", 1, 1.0, 5.0, 10.0), ("far", 1, 5.0, 5.0, 10.0), ("long", 4, 1.0, 2.0, 10.0)], "req string, source long, amps double, most_ohm double, most_volts double")
    edges = spark.createDataFrame([(1, 2, 1.0, 9.0, 3.0, False), (2, 3, 2.0, 2.0, 4.0, False), (1, 3, 9.0, 9.0, 1.0, False), (4, 3, 3.0, 9.0, 0.0, True)], "a long, b long, ohm double, amps double, volts double, both boolean")
    targets = spark.createDataFrame([("n", 3), ("far", 3), ("long", 3)], "req string, node long")
    got = {r["req"]: (r["status"], r["ohm"], r["capacity"], r["clamp"]) for r in evidence.discharge_paths(needs, edges, targets).collect()}
    assert got == {"n": ("ok", 3.0, 2.0, 4.0), "far": ("too much resistance", 9.0, 9.0, 1.0), "long": ("too much resistance", 3.0, 9.0, 0.0)}


def test_kth_smallest(spark):
    rng = random.Random(4)
    values = [rng.randrange(1 << rng.randrange(1, 40)) for _ in range(300)]
    t = spark.createDataFrame([(v,) for v in values], "v long")
    assert [evidence.kth_smallest(t, "v", k) for k in (0, 150, 299, 300)] == [sorted(values)[0], sorted(values)[150], sorted(values)[299], None]

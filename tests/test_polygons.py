"""Rules over rings: distances and gaps against exact kernels, and layouts on which boxes alone mislead."""

import random

import pytest

from lithoscan.functions import kernels
from lithoscan.operators import drc, polygons, spatial

RING = "id long, layer int, ring array<struct<x:long,y:long>>"
BOX = "id long, layer int, x0 long, y0 long, x1 long, y1 long"


def rings(spark, *rows, layer=1):
    return spark.createDataFrame([(i, layer, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rows)], RING)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def boxes(spark, *rows, layer=1, first=0):
    return spark.createDataFrame([(first + i, layer, *r) for i, r in enumerate(rows)], BOX)


def found(df):
    return sorted((r["kind"], r["measured"], r["x"], r["y"]) for r in df.collect())


def shapes(seed, n=14):
    """Triangles and boxes, some diagonal, that don't cross themselves."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x, y, a, b = rng.randrange(400), rng.randrange(400), rng.randrange(10, 60), rng.randrange(10, 60)
        out.append([(x, y), (x + a, y + rng.randrange(-9, 9)), (x + rng.randrange(a), y + b)] if rng.random() < 0.6 else box(x, y, x + a, y + b))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_distances_are_the_edges_least(spark, seed):
    all_ = shapes(seed)
    got = {(r["a"], r["b"]): r["d2"] for r in polygons.distances(polygons.edges_of(rings(spark, *all_)), None, 60).collect()}
    for i, a in enumerate(all_):
        for j, b in enumerate(all_[:i]):
            d2 = min(kernels.segment_distance2(*p, *q) for p in kernels.edges(a) for q in kernels.edges(b))
            if d2 < 3600:
                assert got[j, i] == d2
            else:
                assert got.get((j, i), 3600) >= 3600


def test_inside_is_strict(spark):
    star = [(0, 0), (40, 10), (80, 0), (70, 40), (80, 80), (40, 70), (0, 80), (10, 40)]
    points = [(x, y) for x in range(-5, 86, 5) for y in range(-5, 86, 5)]
    df = spark.createDataFrame([(0, x, y) for x, y in points], "poly long, x long, y long")
    got = {(r["x"], r["y"]): r["inside"] for r in polygons.inside(df, polygons.edges_of(rings(spark, star))).collect()}
    assert got == {p: kernels.point_in_ring(star, p) == "inside" for p in points}


def test_interlocked_shapes_are_apart_though_their_boxes_overlap(spark):
    ell = [(0, 0), (100, 0), (100, 20), (20, 20), (20, 100), (0, 100)]
    inner = box(50, 50, 90, 90)
    e = polygons.edges_of(rings(spark, ell, inner))
    assert found(polygons.min_spacing(e, 40)) == [("min_spacing", 30, 100, 0)]
    assert found(polygons.min_spacing(e, 30)) == []
    # a box inside a ring's concavity isn't enclosed by it, one in its arm is
    arm = polygons.edges_of(rings(spark, box(30, 5, 60, 15), box(50, 50, 60, 60), layer=2))
    outer = polygons.edges_of(rings(spark, ell))
    assert found(polygons.min_enclosure(arm, outer, 10)) == [("min_enclosure", 0, 50, 50), ("min_enclosure", 5, 30, 5)]


def test_diagonal_widths(spark):
    # a 45 degree wire, 28 wide; boxes of it are wide
    wire = [(0, 0), (20, -20), (120, 80), (100, 100)]
    got = found(polygons.min_width(polygons.edges_of(rings(spark, wire)), 40))
    assert [g[1] for g in got] == [28]
    assert found(polygons.min_width(polygons.edges_of(rings(spark, wire)), 28)) == []


def test_holes(spark):
    keyhole = [(0, 0), (20, 0), (20, 20), (12, 20), (12, 16), (16, 16), (16, 12), (8, 12), (8, 16), (12, 16), (12, 20), (0, 20)]
    t = rings(spark, keyhole, box(100, 0, 120, 20), box(108, 8, 112, 12))
    assert found(polygons.min_enclosed_area(t, 40)) == [("min_enclosed_area", 32, 8, 12)]
    assert found(polygons.cheesing(t, 100)) == [("cheesing", 400, 100, 0)]


def test_validity(spark):
    t = rings(spark, box(0, 0, 9, 9), [(0, 0), (5, 0), (0, 0)], [(0, 0), (9, 9), (9, 0), (0, 8)], [(0, 0), (1 << 31, 0), (0, 5)])
    assert sorted((r["kind"], r["measured"]) for r in polygons.validity(t).collect()) == [("geometry_capacity", 1), ("polygon_validity", 0), ("polygon_validity", 1)]


def test_gap_fills(spark):
    u = polygons.edges_of(rings(spark, box(0, 0, 50, 200), box(0, 0, 200, 50), box(120, 0, 200, 200)))
    assert [tuple(r) for r in polygons.gap_fills(u, 100).collect()] == [(1, 0, -50, 170, 250)]


def test_overlap_counts_what_b_has_not_at_all(spark):
    a, b = boxes(spark, (0, 0, 100, 100), (500, 0, 600, 100), (900, 0, 1000, 100)), boxes(spark, (0, 0, 40, 100), (40, 0, 100, 100), (900, 0, 950, 20), (900, 20, 920, 60), layer=2, first=10)
    assert found(drc.overlap_rect(a, b, 90)) == [("overlap", 0, 500, 0), ("overlap_geometry_error", -1, 900, 0)]


def test_corners_of_one_shape_are_no_pair(spark):
    bridge = boxes(spark, (0, 0, 100, 100), (150, 150, 250, 250), (0, 90, 20, 300), (0, 240, 200, 300))
    assert found(drc.corner_to_corner(bridge, 100)) == []
    assert found(drc.corner_to_corner(boxes(spark, (0, 0, 100, 100), (150, 150, 250, 250)), 100)) == [("corner_to_corner", 70, 100, 100)]
    assert found(drc.corner_to_corner(boxes(spark, (0, 0, 100, 100), (100, 130, 250, 250)), 100)) == [("corner_to_corner", 30, 100, 100)]


def test_line_ends(spark):
    # the end's own distance, not the boxes': the other box reaches nearer beside the line than before it
    two = boxes(spark, (0, 0, 40, 200), (-100, 230, 100, 260))
    assert found(drc.eol_spacing(two, 60, 50)) == [("eol_spacing", 30, 40, 200)]
    beside = boxes(spark, (0, 0, 40, 200), (70, 0, 300, 200))
    assert found(drc.eol_spacing(beside, 60, 50)) == []


def test_flush_enclosure_is_none(spark):
    assert found(drc.asymmetric_enclosure(boxes(spark, (0, 20, 50, 80), layer=9), boxes(spark, (0, 0, 300, 300)), 30)) == [("asymmetric_enclosure", 0, 0, 20)]


def test_extension_marks(spark):
    got = found(drc.min_extension(boxes(spark, (0, 0, 20, 100)), boxes(spark, (-50, 10, 50, 95), layer=2, first=5), 30))
    assert got == [("min_extension", 5, 0, 95), ("min_extension", 10, 0, 10)]


def test_one_chip_wide_shape_leaves_cells_small(spark):
    rng = random.Random(2)
    rows = [(x, y, x + 30, y + 30) for x, y in ((rng.randrange(100_000), rng.randrange(100_000)) for _ in range(4000))]
    t = boxes(spark, *rows, (0, 0, 100_000, 100_000))
    levels = spatial.size_levels([(t, 0)], 64, per_cell=50)
    binned = spatial._binned(t, "a", 0, 64, levels, ["id"])
    assert binned.groupBy("lv", "gx", "gy").count().agg({"count": "max"}).first()[0] < 300
    got = spatial.candidates(t, None, 0, cell=64, levels=levels)
    assert got.where("b_id = 4000").count() == 4000


def test_chip_wide_group_is_cut_into_tiles(spark):
    wide = boxes(spark, *[(0, y, 200_000, y + 40) for y in range(0, 4000, 80)], *[(x, 0, x + 40, 4000) for x in range(0, 200_000, 4000)]).selectExpr("0L as grp", "x0", "y0", "x1", "y1")
    got = drc.union_areas(wide).first()["area"]
    assert got == 50 * 40 * 200_000 + 50 * 40 * 4000 - 50 * 50 * 1600 - 0 * got
    cut = spatial.tiled(wide, 2000)
    assert cut.groupBy("grp", "tx", "ty").count().agg({"count": "max"}).first()[0] < 60

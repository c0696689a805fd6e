"""All-angle regions against point tests and areas."""

import random
from fractions import Fraction

import pytest

from lithoscan.functions import kernels, regions

BOX = [(0, 0), (10, 0), (10, 10), (0, 10)]


@pytest.mark.parametrize("seed", range(30))
def test_booleans_of_triangles(seed):
    rng = random.Random(seed)
    x, y = ([(rng.randrange(12), rng.randrange(12)) for _ in range(3)] for _ in "xy")
    if 0 in (kernels.area2(x), kernels.area2(y)):
        return
    size = {op: regions.area(regions.boolean([x], [y], op)) for op in regions.OPS}
    a, b = (abs(Fraction(kernels.area2(t), 2)) for t in (x, y))
    assert size["union"] + size["intersection"] == a + b and size["subtraction"] == a - size["intersection"] and size["xor"] == size["union"] - size["intersection"]
    for op, rule in regions.OPS.items():
        found = regions.boolean([x], [y], op)
        for _ in range(20):
            p = (Fraction(rng.randrange(1200) * 2 + 1, 200), Fraction(rng.randrange(1200) * 2 + 1, 211))
            assert regions._covers(found, p) == rule(regions._covers([x], p), regions._covers([y], p))


def test_holes_offsets_and_contacts():
    assert len(regions.boolean([BOX], [[(3, 3), (6, 3), (6, 6), (3, 6)]], "subtraction")) == 2
    assert regions.area(regions.grown(BOX, 2)) == 196 and regions.area(regions.shrunk(BOX, 2)) == 36
    assert regions.area(regions.grown([(0, 0), (12, 0), (0, 12)], 1)) == 124
    assert regions.contact(BOX, [(5, 5), (15, 5), (15, 15)]) == "overlap" and regions.contact(BOX, [(0, 0), (5, 0), (5, 10), (0, 10)]) == "overlap"
    assert regions.contact(BOX, [(10, 0), (20, 0), (20, 10), (10, 10)]) == "touch" and regions.contact(BOX, [(11, 0), (20, 0), (20, 10)]) == "disjoint"
    assert regions.snapped(regions.crossing((0, 0), (4, 4), (0, 4), (4, 0))) == (2, 2) and regions.snapped(regions.crossing((0, 0), (1, 1), (0, 1), (1, 0))) is None
    with pytest.raises(ValueError):
        regions.boolean([BOX], [BOX], "union", most=3)

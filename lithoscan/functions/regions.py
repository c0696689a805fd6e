"""Regions of any angle: exact booleans, offsets and contacts of rings, in fractions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from fractions import Fraction

from .kernels import Ring, classify_segments, edges, point_in_ring

Point = tuple[Fraction, Fraction]

OPS: dict[str, Callable[[bool, bool], bool]] = {
    "union": lambda a, b: a or b,
    "intersection": lambda a, b: a and b,
    "subtraction": lambda a, b: a and not b,
    "xor": lambda a, b: a != b,
}


def crossing(a: Point, b: Point, c: Point, d: Point) -> Point | None:
    """Where the lines of two segments meet, exactly; None for parallel ones."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    turn = rx * sy - ry * sx
    if turn == 0:
        return None
    t = Fraction((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / turn
    return a[0] + t * rx, a[1] + t * ry


def snapped(p: Point) -> tuple[int, int] | None:
    """The point on whole coordinates, or None where it has none."""
    return (int(p[0]), int(p[1])) if p[0].denominator == p[1].denominator == 1 else None


def contact(a: Ring, b: Ring) -> str:
    """``disjoint``, ``touch`` or ``overlap`` (in area) of two simple rings, filled.

    Where boundaries only touch, a vertex or the middle of an edge strictly
    inside the other ring tells; equal rings overlap.
    """
    touch = False
    for p in edges(a):
        for q in edges(b):
            how = classify_segments(*p, *q)
            if how == "proper":
                return "overlap"
            touch |= how != "none"

    def inside(x: Ring, y: Ring) -> bool:
        twice = [(2 * px, 2 * py) for px, py in y]
        return any(point_in_ring(twice, (2 * p[0], 2 * p[1])) == "inside" or point_in_ring(twice, (p[0] + q[0], p[1] + q[1])) == "inside" for p, q in edges(x))

    if inside(a, b) or inside(b, a) or set(a) == set(b):
        return "overlap"
    return "touch" if touch else "disjoint"


def _covers(rings: Sequence[Sequence[Point]], p: Point) -> bool:
    """Whether a point off all edges has an odd number of them to its right."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (ay > p[1]) != (by > p[1]) and ax + (p[1] - ay) * (bx - ax) / (by - ay) > p[0]:
                odd = not odd
    return odd


def boolean(a: Sequence[Sequence[Point]], b: Sequence[Sequence[Point]], op: str, most: int = 4_000_000) -> list[list[Point]]:
    """Rings of ``a op b``; each side is a set of rings, filled by parity, so holes are rings too. The region lies left of the rings.

    Edges are split where any two meet; a part is kept where the region is on
    one of its sides only, and parts are chained, turning as far left as can be.
    More than ``most`` tests of two edges raise.
    """
    sides = [[[(Fraction(x), Fraction(y)) for x, y in r] for r in s] for s in (a, b)]
    segments = [(p, q) for s in sides for r in s for p, q in zip(r, [*r[1:], r[0]], strict=True) if p != q]
    if len(segments) ** 2 > 2 * most:
        raise ValueError(f"more than {most} pairs of edges")
    cuts: list[set[Point]] = [{p, q} for p, q in segments]

    def on(p: Point, s: tuple[Point, Point]) -> bool:
        (ax, ay), (bx, by) = s
        return (bx - ax) * (p[1] - ay) == (by - ay) * (p[0] - ax) and min(ax, bx) <= p[0] <= max(ax, bx) and min(ay, by) <= p[1] <= max(ay, by)

    for i, s in enumerate(segments):
        for j in range(i):
            t = segments[j]
            if max(s[0][0], s[1][0]) < min(t[0][0], t[1][0]) or max(t[0][0], t[1][0]) < min(s[0][0], s[1][0]) or max(s[0][1], s[1][1]) < min(t[0][1], t[1][1]) or max(t[0][1], t[1][1]) < min(s[0][1], s[1][1]):
                continue
            for x, y, k, m in ((s, t, i, j), (t, s, j, i)):
                for p in y:
                    if on(p, x):
                        cuts[k].add(p)
            p = crossing(*s, *t)
            if p and on(p, s) and on(p, t):
                cuts[i].add(p)
                cuts[j].add(p)
    pieces: set[tuple[Point, Point]] = set()
    for own in cuts:
        row = sorted(own)
        pieces.update(zip(row, row[1:], strict=False))
    keep: dict[Point, list[Point]] = defaultdict(list)
    rule = OPS[op]
    for p, q in pieces:
        mx, my = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2
        nx, ny = p[1] - q[1], q[0] - p[0]  # to the left of p -> q
        # near enough that no other edge lies between: half way to the nearest one that the normal meets
        step = Fraction(1)
        for ends in segments:
            hit = crossing((mx, my), (mx + nx, my + ny), *ends)
            if hit and on(hit, ends):
                t = (hit[0] - mx) / nx if nx else (hit[1] - my) / ny
                if t != 0:
                    step = min(step, abs(t) / 2)
        left = rule(*(_covers(s, (mx + step * nx, my + step * ny)) for s in sides))
        right = rule(*(_covers(s, (mx - step * nx, my - step * ny)) for s in sides))
        if left and not right:
            keep[p].append(q)
        elif right and not left:
            keep[q].append(p)
    out = []

    def quadrant(d: Point) -> int:
        return 0 if d[1] >= 0 and d[0] > 0 else 1 if d[0] <= 0 and d[1] > 0 else 2 if d[0] < 0 else 3

    def leftmost(at: Point, came: Point) -> Point:
        """The way on that turns most to the left."""
        back = (came[0] - at[0], came[1] - at[1])

        def turn(q: Point) -> tuple:
            d = (q[0] - at[0], q[1] - at[1])
            x, y = d[0] * back[0] + d[1] * back[1], back[0] * d[1] - back[1] * d[0]  # in the frame of where it came from
            k = quadrant((x, y))
            return k, (y / x if x else Fraction(0)) if k in (0, 2) else (-x / y)

        return max(keep[at], key=turn)

    while keep:
        first = min(keep)
        ring, came, at = [first], None, first
        while True:
            to = keep[at][0] if came is None else leftmost(at, came)
            keep[at].remove(to)
            if not keep[at]:
                del keep[at]
            if to == first:
                break
            ring.append(to)
            came, at = at, to
        ring = [p for k, p in enumerate(ring) if (p[0] - ring[k - 1][0]) * (ring[(k + 1) % len(ring)][1] - p[1]) != (p[1] - ring[k - 1][1]) * (ring[(k + 1) % len(ring)][0] - p[0])]
        out.append(ring)
    return out


def area(rings: Sequence[Sequence[Point]]) -> Fraction:
    """Area left of the rings: holes, which run the other way, take off."""
    total = Fraction(0)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]], strict=True):
            total += Fraction(ax) * by - Fraction(bx) * ay
    return total / 2


def grown(ring: Ring, by: int) -> list[list[Point]]:
    """The ring's region with every point's square of half side ``by``: the union of the ring and of what each edge sweeps."""
    out: Sequence[Sequence[Point]] = [ring]
    for (ax, ay), (bx, by_) in edges(ring):
        corners = sorted({(x + i * by, y + j * by) for x, y in ((ax, ay), (bx, by_)) for i in (-1, 1) for j in (-1, 1)})
        out = boolean(out, [hull(corners)], "union")
    return [list(r) for r in out]


def shrunk(ring: Ring, by: int) -> list[list[Point]]:
    """What of the ring's region keeps a square of half side ``by`` within it: the region less what each edge sweeps."""
    out: Sequence[Sequence[Point]] = [ring]
    for (ax, ay), (bx, by_) in edges(ring):
        corners = sorted({(x + i * by, y + j * by) for x, y in ((ax, ay), (bx, by_)) for i in (-1, 1) for j in (-1, 1)})
        out = boolean(out, [hull(corners)], "subtraction")
    return [list(r) for r in out]


def hull(points: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The convex hull, counter-clockwise."""

    def half(row: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
        h: list[tuple[int, int]] = []
        for p in row:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) <= (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]):
                h.pop()
            h.append(p)
        return h[:-1]

    row = sorted(set(points))
    return [*half(row), *half(row[::-1])]

"""Exact geometry on integer rings, for what columns can't decide; plain Python integers, so no overflow."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

Point = tuple[int, int]
Ring = list[Point]
Box = tuple[int, int, int, int]


def area2(ring: Ring) -> int:
    """Twice the signed area; positive for counter-clockwise rings."""
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True))


def orient(a: Point, b: Point, c: Point) -> int:
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (v > 0) - (v < 0)


def on_segment(a: Point, b: Point, p: Point) -> bool:
    return orient(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def classify_segments(a: Point, b: Point, c: Point, d: Point) -> str:
    """``none``, ``touch``, ``overlap`` or ``proper``."""
    o = (orient(a, b, c), orient(a, b, d), orient(c, d, a), orient(c, d, b))
    if o[0] == o[1] == 0:
        k = 0 if a[0] != b[0] else 1
        lo, hi = max(min(a[k], b[k]), min(c[k], d[k])), min(max(a[k], b[k]), max(c[k], d[k]))
        return "none" if lo > hi else "touch" if lo == hi else "overlap"
    if o[0] * o[1] < 0 and o[2] * o[3] < 0:
        return "proper"
    hit = any((on_segment(a, b, c), on_segment(a, b, d), on_segment(c, d, a), on_segment(c, d, b)))
    return "touch" if hit else "none"


def edges(ring: Ring) -> Iterator[tuple[Point, Point]]:
    yield from pairwise([*ring, ring[0]])


def point_in_ring(ring: Ring, p: Point) -> str:
    """``inside``, ``boundary`` or ``outside``."""
    inside = False
    for a, b in edges(ring):
        if on_segment(a, b, p):
            return "boundary"
        if (a[1] > p[1]) != (b[1] > p[1]):
            side = (b[0] - a[0]) * (p[1] - a[1]) - (p[0] - a[0]) * (b[1] - a[1])
            inside ^= (side > 0) == (b[1] > a[1])
    return "inside" if inside else "outside"


def self_intersects(ring: Ring) -> bool:
    """Whether two edges cross properly; contacts, as of keyholes, are legal."""
    es = list(edges(ring))
    return any(classify_segments(*es[i], *es[j]) == "proper" for i in range(len(es)) for j in range(i + 1, len(es)))


def segment_distance2(a: Point, b: Point, c: Point, d: Point) -> int:
    """Squared distance of two segments, 0 where they meet; projections are truncated."""
    if classify_segments(a, b, c, d) != "none":
        return 0

    def to(p: Point, q: Point, r: Point) -> int:
        dx, dy = r[0] - q[0], r[1] - q[1]
        n = dx * dx + dy * dy
        t = (p[0] - q[0]) * dx + (p[1] - q[1]) * dy
        if n == 0 or t <= 0:
            return (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
        if t >= n:
            return (p[0] - r[0]) ** 2 + (p[1] - r[1]) ** 2
        cross = (p[0] - q[0]) * dy - (p[1] - q[1]) * dx
        return cross * cross // n

    return min(to(a, c, d), to(b, c, d), to(c, a, b), to(d, a, b))


def clean_ring(ring: Ring) -> Ring:
    """Without repeated and collinear vertices, counter-clockwise, from the smallest vertex on; fewer than three raise."""
    out = [p for i, p in enumerate(ring) if p != ring[i - 1]]
    while True:
        kept = [p for i, p in enumerate(out) if orient(out[i - 1], p, out[(i + 1) % len(out)]) != 0]
        if len(kept) == len(out):
            break
        out = kept
    if len(out) < 3:
        raise ValueError("degenerate ring")
    if area2(out) < 0:
        out.reverse()
    k = out.index(min(out))
    return out[k:] + out[:k]


def is_rectilinear(ring: Ring) -> bool:
    return all(a[0] == b[0] or a[1] == b[1] for a, b in edges(ring))


def decompose(ring: Ring) -> list[Box]:
    """Disjoint boxes of a rectilinear ring, by vertical slabs; other rings raise."""
    if len(ring) < 4:
        raise ValueError("too few vertices")
    if not is_rectilinear(ring):
        raise ValueError("not rectilinear")
    flat = [(min(a[0], b[0]), max(a[0], b[0]), a[1]) for a, b in edges(ring) if a[1] == b[1] and a[0] != b[0]]
    out: list[Box] = []
    for x0, x1 in pairwise(sorted({x for x, _ in ring})):
        ys = sorted(y for lo, hi, y in flat if lo <= x0 and x1 <= hi)
        if len(ys) % 2:
            raise ValueError("odd crossings")
        out += [(x0, ys[i], x1, ys[i + 1]) for i in range(0, len(ys), 2) if ys[i] < ys[i + 1]]
    return out


def keyhole_holes(ring: Ring) -> list[Ring]:
    """Holes of a single boundary walk: closed parts between two visits of a vertex that run clockwise."""
    turn = 1 if area2(ring) >= 0 else -1
    stack: list[Point] = []
    at: dict[Point, int] = {}
    holes = []
    for p in ring:
        if p in at:
            part = stack[at[p] :]
            if len(part) >= 3 and area2(part) * turn < 0:
                holes.append(part)
            for q in stack[at[p] + 1 :]:
                at.pop(q, None)
            del stack[at[p] + 1 :]
        else:
            at[p] = len(stack)
            stack.append(p)
    return holes


def clip(ring: Ring, box: Box) -> list[tuple[float, float]]:
    """The ring cut to a box, side by side."""
    out: list[tuple[float, float]] = [(float(x), float(y)) for x, y in ring]
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        new = []
        for i, q in enumerate(out):
            p = out[i - 1]
            ip, iq = sign * (p[axis] - limit) >= 0, sign * (q[axis] - limit) >= 0
            if ip != iq:
                t = (limit - p[axis]) / (q[axis] - p[axis])
                new.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if iq:
                new.append(q)
        out = new
    return out


def clipped_area(ring: Ring, box: Box) -> float:
    cut = [(x - box[0], y - box[1]) for x, y in clip(ring, box)]
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(cut, [*cut[1:], *cut[:1]], strict=True))) / 2


def triangulate(ring: Ring) -> list[Ring]:
    """Triangles of a simple ring, by ears."""
    left = clean_ring(ring)
    out = []
    while len(left) > 3:
        for i, p in enumerate(left):
            a, b = left[i - 1], left[(i + 1) % len(left)]
            if orient(a, p, b) > 0 and not any(q not in (a, p, b) and point_in_ring([a, p, b], q) != "outside" for q in left):
                out.append([a, p, b])
                left.pop(i)
                break
        else:
            raise ValueError("not a simple ring")
    return [*out, left]


def validity(ring: Ring) -> tuple[str, int] | None:
    """The ring's fault as (kind, measured), or None."""
    if len(ring) < 3 or area2(ring) == 0:
        return ("zero_area", 0)
    return ("self_intersecting", 1) if self_intersects(ring) else None


def stroke(points: list[Point], width: int, pathtype: int = 0) -> list[Ring]:
    """Boxes of a path of axis-parallel segments of even positive width; type 2 reaches half a width beyond the ends."""
    if width <= 0 or width % 2:
        raise ValueError("path width must be even and positive")
    if pathtype not in (0, 2):
        raise ValueError(f"path type {pathtype} isn't supported")
    h, out, last = width // 2, [], len(points) - 2
    for i, (a, b) in enumerate(pairwise(points)):
        if a == b:
            continue
        if a[0] != b[0] and a[1] != b[1]:
            raise ValueError("diagonal path segment")
        # inner ends reach over the corner; outer ones by the path's type
        before = h if i or pathtype == 2 else 0
        after = h if i < last or pathtype == 2 else 0
        k = 0 if a[0] != b[0] else 1
        sign = 1 if b[k] > a[k] else -1
        lo, hi = sorted((a[k] - sign * before, b[k] + sign * after))
        c = a[1 - k]
        box = (lo, c - h, hi, c + h) if k == 0 else (c - h, lo, c + h, hi)
        out.append([(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])])
    return out

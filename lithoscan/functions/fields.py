"""Quasi-static field solvers: capacitance of panels, inductance of bars, and what solves their systems. NumPy, SI units."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

EPS0 = 8.8541878128e-12
MU0 = 4e-7 * np.pi

Operator = Callable[[np.ndarray], np.ndarray]


# --- panels -------------------------------------------------------------------------


def frame(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """A flat panel's centroid, unit normal and area; corners in order, three or four."""
    c = np.asarray(corners, dtype=float)
    parts = [(c[0], c[i], c[i + 1]) for i in range(1, len(c) - 1)]
    crosses = [np.cross(b - a, d - a) / 2 for a, b, d in parts]
    whole = sum(crosses)
    area = float(np.linalg.norm(whole))
    sizes = [float(np.dot(x, whole)) / max(area, 1e-300) for x in crosses]
    centre = sum(s * (a + b + d) / 3 for s, (a, b, d) in zip(sizes, parts, strict=True)) / max(area, 1e-300)
    return centre, whole / max(area, 1e-300), area


def panel_potential(corners: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Integral of 1/r over a flat polygon, at each point, by its edges: exact wherever the points are.

    Over each edge, the line integral of the distance's logarithm; less the
    height over the plane times the angle that the edge is seen under.
    """
    c = np.asarray(corners, dtype=float)
    p = np.atleast_2d(points).astype(float)
    _, normal, _ = frame(c)
    height = (p - c[0]) @ normal
    foot = p - height[:, None] * normal
    out = np.zeros(len(p))
    for a, b in zip(c, np.roll(c, -1, axis=0), strict=True):
        along = b - a
        length = np.linalg.norm(along)
        if length < 1e-300:
            continue
        along = along / length
        outward = np.cross(along, normal)
        s0, s1 = (a - foot) @ along, (b - foot) @ along
        off = (a - foot) @ outward
        r0, r1 = np.sqrt(s0**2 + off**2 + height**2), np.sqrt(s1**2 + off**2 + height**2)
        base = off**2 + height**2
        # the logarithm from whichever end doesn't cancel
        direct, turned = (r1 + s1) / np.maximum(r0 + s0, 1e-300), (r0 - s0) / np.maximum(r1 - s1, 1e-300)
        line = np.where(base > 1e-24 * length**2, np.log(np.maximum(np.where(s0 + s1 > 0, direct, turned), 1e-300)), 0.0)
        h = np.abs(height)
        angle = np.arctan2(off * s1, base + h * r1) - np.arctan2(off * s0, base + h * r0)
        out += off * line - h * angle
    return out


def panel_field(corners: np.ndarray, points: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Derivative of :func:`panel_potential` along a direction at each point, by central differences of a thousandth of the panel's size."""
    _, _, area = frame(corners)
    h = 1e-3 * np.sqrt(area)
    return (panel_potential(corners, points + h * directions) - panel_potential(corners, points - h * directions)) / (2 * h)


def plate(width: float, height: float, nx: int, ny: int, z: float = 0.0) -> list[np.ndarray]:
    """A flat rectangle, centred, as nx by ny panels."""
    xs, ys = np.linspace(-width / 2, width / 2, nx + 1), np.linspace(-height / 2, height / 2, ny + 1)
    return [np.array([[xs[i], ys[j], z], [xs[i + 1], ys[j], z], [xs[i + 1], ys[j + 1], z], [xs[i], ys[j + 1], z]]) for i in range(nx) for j in range(ny)]


def icosphere(radius: float, rounds: int) -> list[np.ndarray]:
    """A sphere as 20 x 4^rounds triangles."""
    g = (1 + 5**0.5) / 2
    v = np.array([(-1, g, 0), (1, g, 0), (-1, -g, 0), (1, -g, 0), (0, -1, g), (0, 1, g), (0, -1, -g), (0, 1, -g), (g, 0, -1), (g, 0, 1), (-g, 0, -1), (-g, 0, 1)])
    near = np.linalg.norm(v[:, None] - v[None], axis=2)
    edge = near[near > 1e-9].min() * 1.01
    faces = [(i, j, k) for i in range(12) for j in range(i + 1, 12) for k in range(j + 1, 12) if near[i, j] < edge and near[j, k] < edge and near[i, k] < edge]
    tris = []
    for i, j, k in faces:
        t = v[[i, j, k]]
        tris.append(t if np.dot(np.cross(t[1] - t[0], t[2] - t[0]), t.sum(axis=0)) > 0 else t[::-1])
    unit = lambda x: x / np.linalg.norm(x)
    tris = [np.array([unit(x) for x in t]) for t in tris]
    for _ in range(rounds):
        finer = []
        for a, b, c in tris:
            ab, bc, ca = unit(a + b), unit(b + c), unit(c + a)
            finer += [np.array(t) for t in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca))]
        tris = finer
    return [radius * t for t in tris]


def box_panels(lo: Sequence[float], hi: Sequence[float], most: float) -> list[np.ndarray]:
    """The six sides of a box as panels no longer than ``most``."""
    lo, hi = np.asarray(lo, float), np.asarray(hi, float)
    out = []
    for axis in range(3):
        u, v = [k for k in range(3) if k != axis]
        nu, nv = (max(int(np.ceil((hi[k] - lo[k]) / most)), 1) for k in (u, v))
        for at in (lo[axis], hi[axis]):
            us, vs = np.linspace(lo[u], hi[u], nu + 1), np.linspace(lo[v], hi[v], nv + 1)
            for i in range(nu):
                for j in range(nv):
                    p = np.zeros((4, 3))
                    p[:, axis] = at
                    p[:, u], p[:, v] = us[[i, i + 1, i + 1, i]], vs[[j, j, j + 1, j + 1]]
                    out.append(p)
    return out


# --- capacitance ----------------------------------------------------------------------


def potential_matrix(panels: Sequence[np.ndarray], permittivity: float = 1.0) -> np.ndarray:
    """Potential at each panel's centroid of a unit charge spread over each panel."""
    centres, _, areas = (np.array(x) for x in zip(*map(frame, panels), strict=True))
    return np.stack([panel_potential(p, centres) / a for p, a in zip(panels, areas, strict=True)], axis=1) / (4 * np.pi * EPS0 * permittivity)


def capacitance(panels: Sequence[np.ndarray], conductor: Sequence[int], permittivity: float = 1.0, direct: int = 500) -> np.ndarray:
    """The Maxwell matrix (farads): charges of each conductor with one at a volt and the others at none.

    Up to ``direct`` panels by factorisation, beyond by GMRES on the tree code.
    """
    of = np.asarray(conductor)
    v = (of[:, None] == np.arange(of.max() + 1)[None]).astype(float)
    if len(panels) <= direct:
        q = np.linalg.solve(potential_matrix(panels, permittivity), v)
    else:
        apply = TreeCode(panels, permittivity)
        q = np.stack([gmres(apply, v[:, k], precondition=apply.near_solve, tolerance=1e-6) for k in range(v.shape[1])], axis=1)
    c = v.T @ q
    return (c + c.T) / 2


def dielectric_capacitance(conductors: Sequence[np.ndarray], conductor: Sequence[int], outside: Sequence[float], interfaces: Sequence[np.ndarray], sides: Sequence[tuple[float, float]]) -> np.ndarray:
    """The Maxwell matrix with dielectric interfaces, by equivalent charge in free space.

    Conductor panels fix the potential; on an interface panel, whose normal
    points from the second to the first of its two permittivities, the normal
    flux is continuous. Free charge is the equivalent one times ``outside``.
    """
    panels = [*conductors, *interfaces]
    centres, normals, areas = (np.array(x) for x in zip(*map(frame, panels), strict=True))
    n = len(conductors)
    a = np.zeros((len(panels), len(panels)))
    for j, p in enumerate(panels):
        a[:n, j] = panel_potential(p, centres[:n]) / areas[j] / (4 * np.pi * EPS0)
        if len(interfaces):
            a[n:, j] = panel_field(p, centres[n:], normals[n:]) / areas[j] / (4 * np.pi * EPS0)
    for k, (first, second) in enumerate(sides):
        i = n + k
        # the panel's own field jumps by sigma / eps0; its mean, from both sides, is that of the others
        a[i, i] = 0.0
        a[i] *= first - second
        a[i, i] = -(first + second) / (2 * EPS0 * areas[i])
    of = np.asarray(conductor)
    v = np.zeros((len(panels), of.max() + 1))
    v[np.arange(n), of] = 1.0
    q = np.linalg.solve(a, v)[:n] * np.asarray(outside)[:, None]
    return (of[:, None] == np.arange(of.max() + 1)[None]).astype(float).T @ q


class TreeCode:
    """Potentials of panel charges in n log n: an octree whose far cells are seen as charges on Chebyshev nodes.

    A cell is far where it lies at least its own size away; the kernel between
    cells is interpolated at ``order``^3 nodes, so any smooth kernel would do.
    Near cells are exact, panel by panel.
    """

    def __init__(self, panels: Sequence[np.ndarray], permittivity: float = 1.0, order: int = 4, leaf: int = 40):
        self.centres, _, self.areas = (np.array(x) for x in zip(*map(frame, panels), strict=True))
        self.scale, self.order = 1 / (4 * np.pi * EPS0 * permittivity), order
        k = np.arange(order)
        self.nodes = np.cos((2 * k + 1) * np.pi / (2 * order))
        self.cells: list[tuple[np.ndarray, float, np.ndarray, list[int]]] = []  # middle, half side, panels, children
        lo, hi = self.centres.min(axis=0), self.centres.max(axis=0)
        self._build(np.arange(len(panels)), (lo + hi) / 2, max(float((hi - lo).max()) / 2, 1e-12) * 1.001, leaf)
        self.leaves = [i for i, c in enumerate(self.cells) if not c[3]]
        self.weights = {i: self._weights(c) for i, c in enumerate(self.cells)}
        self.far: dict[int, list[int]] = defaultdict(list)
        self.near: dict[int, list[int]] = defaultdict(list)
        for leaf_ in self.leaves:
            self._meet(leaf_, 0)
        self.blocks = {}
        for target, sources in self.near.items():
            rows = self.cells[target][2]
            cols = np.concatenate([self.cells[s][2] for s in sources])
            block = np.stack([panel_potential(panels[j], self.centres[rows]) / self.areas[j] for j in cols], axis=1) * self.scale
            own = np.searchsorted(np.sort(cols), rows)
            order_ = np.argsort(cols)
            self.blocks[target] = (rows, cols, block, np.linalg.inv(block[:, order_[own]]))

    def _build(self, ids: np.ndarray, middle: np.ndarray, half: float, leaf: int) -> int:
        at = len(self.cells)
        self.cells.append((middle, half, ids, []))
        if len(ids) > leaf and half > 1e-15:
            octant = ((self.centres[ids] > middle) * np.array([1, 2, 4])).sum(axis=1)
            for o in range(8):
                own = ids[octant == o]
                if len(own):
                    shift = np.array([1 if o >> k & 1 else -1 for k in range(3)]) * half / 2
                    self.cells[at][3].append(self._build(own, middle + shift, half / 2, leaf))
        return at

    def _grid(self, middle: np.ndarray, half: float) -> np.ndarray:
        g = np.stack(np.meshgrid(self.nodes, self.nodes, self.nodes, indexing="ij"), axis=-1).reshape(-1, 3)
        return middle + half * g

    def _weights(self, cell: tuple) -> np.ndarray:
        """Chebyshev interpolation weights of the cell's panels, [node, panel]."""
        middle, half, ids, _ = cell
        x = (self.centres[ids] - middle) / half
        n, k = self.order, np.arange(1, self.order)
        each = []
        for axis in range(3):
            t = np.cos(k[:, None] * np.arccos(np.clip(x[:, axis], -1, 1))[None])
            tn = np.cos(k[:, None] * np.arccos(self.nodes)[None])
            each.append(1 / n + 2 / n * tn.T @ t)
        return np.einsum("ap,bp,cp->abcp", *each).reshape(-1, len(ids))

    def _meet(self, target: int, source: int) -> None:
        middle, half = self.cells[target][:2]
        m, h, _, children = self.cells[source]
        if float(np.abs(m - middle).max()) >= 2 * h + half + 1e-15 and source != target:
            self.far[target].append(source)
        elif not children:
            self.near[target].append(source)
        else:
            for c in children:
                self._meet(target, c)

    def __call__(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        moments = {i: self.weights[i] @ q[c[2]] for i, c in enumerate(self.cells)}
        for target in self.leaves:
            rows, cols, block, _ = self.blocks[target]
            own = block @ q[cols]
            for source in self.far[target]:
                m, h = self.cells[source][:2]
                d = np.linalg.norm(self.centres[rows][:, None] - self._grid(m, h)[None], axis=2)
                own = own + self.scale * (1 / d) @ moments[source]
            out[rows] = own
        return out

    def near_solve(self, r: np.ndarray) -> np.ndarray:
        """Each leaf's own block solved by itself: the preconditioner."""
        out = np.zeros(len(r))
        for rows, _, _, inverse in self.blocks.values():
            out[rows] = inverse @ r[rows]
        return out


# --- inductance -----------------------------------------------------------------------


def self_inductance(length: float, width: float, height: float) -> float:
    """Partial self-inductance of a straight bar, by its cross-section's mean distance."""
    g = 0.2235 * (width + height)  # the mean distance of a rectangle's points from each other
    ratio = length / g
    return MU0 * length / (2 * np.pi) * (np.log(ratio + np.sqrt(1 + ratio**2)) - np.sqrt(1 + 1 / ratio**2) + 1 / ratio)


def parallel_mutual(length1: float, length2: float, distance: float, shift: float) -> float:
    """Mutual inductance of two parallel thin wires: the second starts ``shift`` behind the first one's start, ``distance`` beside it."""

    def part(x: float) -> float:
        return x * np.arcsinh(x / distance) - np.sqrt(x * x + distance * distance)

    a, b, c, d = shift + length2, shift + length2 - length1, shift - length1, shift
    if distance > 0:
        return MU0 / (4 * np.pi) * (part(a) - part(b) + part(c) - part(d))
    log = lambda x: abs(x) * np.log(abs(x)) if x else 0.0
    return MU0 / (4 * np.pi) * (log(a) - log(b) + log(c) - log(d))


def filament_mutual(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, points: int = 12) -> float:
    """Mutual inductance of two thin wires in any position, by Gauss-Legendre quadrature of Neumann's integral; perpendicular ones have none."""
    u, v = a1 - a0, b1 - b0
    dot = float(u @ v)
    if abs(dot) < 1e-12 * np.linalg.norm(u) * np.linalg.norm(v):
        return 0.0
    t, w = np.polynomial.legendre.leggauss(points)
    t, w = (t + 1) / 2, w / 2
    p, q = a0 + t[:, None] * u, b0 + t[:, None] * v
    d = np.linalg.norm(p[:, None] - q[None], axis=2)
    return float(MU0 / (4 * np.pi) * dot * (w[:, None] * w[None] / np.maximum(d, 1e-15)).sum())


def mutual_inductance(a: Bar, b: Bar) -> float:
    """Of two bars: closed where they are parallel, else by quadrature; bars near each other by the mean over four wires each."""
    la, lb = np.linalg.norm(a.end - a.start), np.linalg.norm(b.end - b.start)
    ua, ub = (a.end - a.start) / la, (b.end - b.start) / lb
    cos = float(ua @ ub)
    near = np.linalg.norm((a.start + a.end) / 2 - (b.start + b.end) / 2) < 3 * max(a.width, a.height, b.width, b.height)
    total = 0.0
    for oa in a.wires(near):
        for ob in b.wires(near):
            gap = b.start + ob - a.start - oa
            if abs(abs(cos) - 1) < 1e-9:
                along = float(gap @ ua)
                aside = float(np.linalg.norm(gap - along * ua))
                if cos < 0:
                    along -= lb
                total += cos * parallel_mutual(la, lb, max(aside, 1e-12 * la), along)
            else:
                total += filament_mutual(a.start + oa, a.end + oa, b.start + ob, b.end + ob)
    return total / (len(a.wires(near)) * len(b.wires(near)))


@dataclass
class Bar:
    """A straight conductor of rectangular section; ``aside`` is the unit vector along its width."""

    start: np.ndarray
    end: np.ndarray
    width: float
    height: float
    sigma: float
    aside: np.ndarray

    @property
    def length(self) -> float:
        return float(np.linalg.norm(self.end - self.start))

    @property
    def ohm(self) -> float:
        return self.length / (self.sigma * self.width * self.height)

    def up(self) -> np.ndarray:
        u = np.cross((self.end - self.start) / self.length, self.aside)
        return u / np.linalg.norm(u)

    def wires(self, near: bool) -> list[np.ndarray]:
        """Shifts of the wires that stand for it: one, or four at the Gauss points of its section."""
        if not near:
            return [np.zeros(3)]
        g = 1 / (2 * 3**0.5)
        return [i * g * self.width * self.aside + j * g * self.height * self.up() for i in (-1, 1) for j in (-1, 1)]

    def filaments(self, nw: int, nh: int) -> list[Bar]:
        """Parts of equal section, for the current's crowding at high frequency."""
        out = []
        for i in range(nw):
            for j in range(nh):
                shift = ((i + 0.5) / nw - 0.5) * self.width * self.aside + ((j + 0.5) / nh - 0.5) * self.height * self.up()
                out.append(Bar(self.start + shift, self.end + shift, self.width / nw, self.height / nh, self.sigma, self.aside))
        return out


def bar(start: Sequence[float], end: Sequence[float], width: float, height: float, sigma: float) -> Bar:
    """A bar whose width lies in the horizontal plane, or along x for vertical ones."""
    s, e = np.asarray(start, float), np.asarray(end, float)
    u = (e - s) / np.linalg.norm(e - s)
    aside = np.cross([0.0, 0.0, 1.0], u)
    if np.linalg.norm(aside) < 1e-9:
        aside = np.array([1.0, 0.0, 0.0])
    return Bar(s, e, width, height, sigma, aside / np.linalg.norm(aside))


def inductance_matrix(bars: Sequence[Bar]) -> np.ndarray:
    n = len(bars)
    m = np.zeros((n, n))
    for i in range(n):
        m[i, i] = self_inductance(bars[i].length, bars[i].width, bars[i].height)
        for j in range(i):
            m[i, j] = m[j, i] = mutual_inductance(bars[i], bars[j])
    return m


def spanning_forest(n_nodes: int, branches: Sequence[tuple[int, int]]) -> tuple[dict[int, tuple[int, int, int]], list[int]]:
    """``(parents, chords)``: each node's (parent, branch, direction) in a forest, and the branches that close loops."""
    near: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, (a, b) in enumerate(branches):
        near[a].append((b, k, 1))
        near[b].append((a, k, -1))
    parents: dict[int, tuple[int, int, int]] = {}
    used: set[int] = set()
    for root in range(n_nodes):
        if root in parents:
            continue
        parents[root] = (-1, -1, 0)
        todo = [root]
        while todo:
            x = todo.pop()
            for y, k, way in near[x]:
                if y not in parents:
                    parents[y] = (x, k, way)
                    used.add(k)
                    todo.append(y)
    return parents, [k for k in range(len(branches)) if k not in used]


def meshes(n_nodes: int, branches: Sequence[tuple[int, int]]) -> np.ndarray:
    """A row for each independent loop, +1 or -1 for the branches along it."""
    parents, chords = spanning_forest(n_nodes, branches)

    def to_root(x: int) -> list[tuple[int, int]]:
        out = []
        while parents[x][0] >= 0:
            p, k, way = parents[x]
            out.append((k, way))
            x = p
        return out

    m = np.zeros((len(chords), len(branches)))
    for row, k in enumerate(chords):
        a, b = branches[k]
        m[row, k] = 1
        for edge, way in to_root(a):  # the loop comes from the root down to a, and goes back from b
            m[row, edge] += way
        for edge, way in to_root(b):
            m[row, edge] -= way
    return m


def port_impedance(n_nodes: int, branches: Sequence[tuple[int, int]], bars: Sequence[Bar], ports: Sequence[tuple[int, int]], frequencies: Sequence[float], direct: int = 100) -> np.ndarray:
    """Impedance matrices of the ports at each frequency, [frequency, port, port].

    Each port is a branch of its own that closes loops with the conductors; loop
    currents solve M Z M^T, by factorisation below ``direct`` branches and by
    block-preconditioned GMRES beyond.
    """
    all_branches = [*branches, *ports]
    loops = meshes(n_nodes, all_branches)
    inner, outer = loops[:, : len(branches)], loops[:, len(branches) :]
    r, l = np.array([b.ohm for b in bars]), inductance_matrix(bars)  # noqa: E741
    out = []
    for f in frequencies:
        z = np.diag(r).astype(complex) + 2j * np.pi * f * l
        a = inner @ z @ inner.T
        if len(branches) <= direct:
            x = np.linalg.solve(a, outer.astype(complex))
        else:
            d = np.diag(a)
            x = np.stack([gmres(lambda v: a @ v, outer[:, k].astype(complex), precondition=lambda v: v / d, tolerance=1e-8) for k in range(outer.shape[1])], axis=1)  # noqa: B023
        out.append(np.linalg.inv(outer.T @ x))
    return np.array(out)


def sweep(low: float, high: float, per_decade: float) -> list[float]:
    """Frequencies from ``low`` to ``high``, evenly spaced on the logarithm."""
    if high <= low:
        return [low]
    n = int(round(per_decade * np.log10(high / low)))
    return [float(low * 10 ** (k / per_decade)) for k in range(n + 1)]


# --- linear systems ---------------------------------------------------------------------


def gmres(apply: Operator, b: np.ndarray, precondition: Operator | None = None, tolerance: float = 1e-3, restart: int = 50, rounds: int = 40) -> np.ndarray:
    """Restarted GMRES, preconditioned from the right, for real or complex systems; no convergence raises."""
    m = precondition or (lambda v: v)
    x = np.zeros_like(b)
    goal = tolerance * np.linalg.norm(b)
    if goal == 0:
        return x
    for _ in range(rounds):
        r = b - apply(x)
        beta = np.linalg.norm(r)
        if beta <= goal:
            return x
        q, h = [r / beta], np.zeros((restart + 1, restart), dtype=np.result_type(b, r))
        k = 0
        for k in range(restart):
            w = apply(m(q[k]))
            for _twice in range(2):  # once more against rounding
                for j in range(k + 1):
                    c = np.vdot(q[j], w)
                    h[j, k] += c
                    w = w - c * q[j]
            h[k + 1, k] = np.linalg.norm(w)
            e = np.zeros(k + 2, dtype=h.dtype)
            e[0] = beta
            y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], e, rcond=None)
            if np.linalg.norm(h[: k + 2, : k + 1] @ y - e) <= goal or abs(h[k + 1, k]) < 1e-14 * beta:
                break
            q.append(w / h[k + 1, k])
        x = x + m(np.stack(q[: k + 1], axis=1) @ y)
    raise ArithmeticError("GMRES did not converge")


def gmres_many(apply: Operator, b: np.ndarray, **more: object) -> np.ndarray:
    """A solution for each column of ``b``."""
    return np.stack([gmres(apply, b[:, k], **more) for k in range(b.shape[1])], axis=1)  # type: ignore[arg-type]


def block_jacobi(a: np.ndarray, size: int) -> Operator:
    """The inverse of a matrix's diagonal blocks, as a preconditioner."""
    parts = [(s, min(s + size, len(a)), np.linalg.inv(a[s : s + size, s : s + size])) for s in range(0, len(a), size)]

    def apply(v: np.ndarray) -> np.ndarray:
        out = np.empty(len(v), dtype=np.result_type(a, v))
        for s, e, inverse in parts:
            out[s:e] = inverse @ v[s:e]
        return out

    return apply


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(factors, order)`` with partial pivoting: both triangles in one matrix; a singular one raises."""
    f, order = np.array(a, dtype=np.result_type(a, float)), np.arange(len(a))
    for k in range(len(f)):
        p = k + int(np.abs(f[k:, k]).argmax())
        if f[p, k] == 0:
            raise np.linalg.LinAlgError("singular matrix")
        f[[k, p]], order[[k, p]] = f[[p, k]], order[[p, k]]
        f[k + 1 :, k] /= f[k, k]
        f[k + 1 :, k + 1 :] -= np.outer(f[k + 1 :, k], f[k, k + 1 :])
    return f, order


def lu_solve(factors: tuple[np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    f, order = factors
    x = np.array(b, dtype=np.result_type(f, b))[order]
    for k in range(len(f)):
        x[k] -= f[k, :k] @ x[:k]
    for k in range(len(f) - 1, -1, -1):
        x[k] = (x[k] - f[k, k + 1 :] @ x[k + 1 :]) / f[k, k]
    return x


def refined(a: np.ndarray, b: np.ndarray, rounds: int = 5, tolerance: float = 1e-12) -> np.ndarray:
    """A solution from single-precision factors of the equilibrated matrix, improved by residuals in double precision."""
    rows = 1 / np.maximum(np.abs(a).max(axis=1), 1e-300)
    cols = 1 / np.maximum(np.abs(a * rows[:, None]).max(axis=0), 1e-300)
    low = np.complex64 if np.iscomplexobj(a) else np.float32
    factors = lu((a * rows[:, None] * cols[None]).astype(low))
    x = np.zeros(len(b), dtype=np.result_type(a, b, float))
    for _ in range(rounds):
        r = b - a @ x
        if np.linalg.norm(r) <= tolerance * np.linalg.norm(b):
            break
        x = x + cols * lu_solve(factors, (rows * r).astype(low)).astype(x.dtype)
    return x


def low_rank(entry: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int], tolerance: float = 1e-6, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """``u @ v`` near a matrix that is only looked at by rows and columns (adaptive crosses, partial pivots)."""
    u, v, norm2, row, seen = [], [], 0.0, 0, set()
    for _ in range(min(most, *shape)):
        seen.add(row)
        r = entry(np.array([row]), np.arange(shape[1]))[0] - sum((a[row] * b for a, b in zip(u, v, strict=True)), np.zeros(shape[1]))
        col = int(np.abs(r).argmax())
        if abs(r[col]) < 1e-300:
            left = [k for k in range(shape[0]) if k not in seen]
            if not left:
                break
            row = left[0]
            continue
        c = entry(np.arange(shape[0]), np.array([col]))[:, 0] - sum((a * b[col] for a, b in zip(u, v, strict=True)), np.zeros(shape[0]))
        own = c / r[col]
        norm2 += float((own @ own.conj()).real * (r @ r.conj()).real) + 2 * sum(float(abs((a @ own.conj()) * (b @ r.conj()))) for a, b in zip(u, v, strict=True))
        u.append(own)
        v.append(r)
        if np.linalg.norm(own) * np.linalg.norm(r) <= tolerance * np.sqrt(norm2):
            break
        row = int(np.abs(np.where([k in seen for k in range(shape[0])], 0, c)).argmax())
    return (np.stack(u, axis=1), np.stack(v)) if u else (np.zeros((shape[0], 0)), np.zeros((0, shape[1])))

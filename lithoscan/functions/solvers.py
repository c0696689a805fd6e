"""Numerical and combinatorial kernels for one component at a time: NumPy and plain Python."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

import numpy as np


def conjugate_gradient(product: Callable[[np.ndarray], np.ndarray], i: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-10, rounds: int = 20_000) -> np.ndarray:
    """x of g x = i for a symmetric positive definite g, given by its ``product`` with a vector and its ``diagonal``; no convergence raises."""
    x = np.zeros_like(i, dtype=float)
    r = i - product(x)
    z = r / diagonal
    p, rz = z.copy(), float(r @ z)
    end = tolerance * max(float(np.linalg.norm(i)), 1e-300)
    for _ in range(rounds):
        if float(np.linalg.norm(r)) <= end:
            return x
        q = product(p)
        a = rz / float(p @ q)
        x, r = x + a * p, r - a * q
        z = r / diagonal
        rz, old = float(r @ z), rz
        p = z + rz / old * p
    raise ArithmeticError("conjugate gradient did not converge")


#: Branches of a node up to which it is eliminated exactly.
FEW = 8


def _eliminate(near: dict[int, dict[int, float]], drawn: dict[int, float], fixed: dict[int, float]) -> list[tuple[int, dict[int, float]]]:
    """Take free nodes of few branches out of ``near``, fewest first, each replaced by branches between its neighbours; in the order of elimination, with their branches.

    Conductances are only added, multiplied and divided, so a long chain loses
    no digits. What a node draws goes to its neighbours.
    """
    heap = [(len(branches), n) for n, branches in near.items() if n not in fixed]
    heapq.heapify(heap)
    out = []
    while heap:
        degree, n = heapq.heappop(heap)
        if n not in near or degree != len(near[n]):
            continue  # in the heap once more, by the branches that it has now
        if degree > FEW:
            break
        mine = near.pop(n)
        out.append((n, mine))
        total = sum(mine.values())
        ends = list(mine.items())
        for k, (a, g) in enumerate(ends):
            del near[a][n]
            drawn[a] += drawn[n] * (g / total)
            for b, h in ends[:k]:
                if a not in fixed or b not in fixed:
                    near[a][b] = near[b][a] = near[a].get(b, 0.0) + g * (h / total)
        for a in mine:
            if a not in fixed:
                heapq.heappush(heap, (len(near[a]), a))
    return out


def solve_grid(edges: list[tuple[int, int, float]], fixed: dict[int, float], loads: dict[int, float]) -> dict[int, float]:
    """Voltages of a resistor network: ``edges`` (a, b, ohm), ``fixed`` voltages and drawn currents; fixed nodes are eliminated.

    Trees, chains and ladders are solved exactly, by elimination, whatever their
    length; conjugate gradient solves what is left between nodes of many
    branches. The network stays a list of branches, so memory is that of its edges.
    """
    near: dict[int, dict[int, float]] = {n: {} for n in sorted({n for a, b, _ in edges for n in (a, b)} | fixed.keys() | loads.keys())}
    for a, b, ohm in edges:
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + 1 / ohm
    nodes, drawn = list(near), {n: loads.get(n, 0.0) for n in near}
    order = _eliminate(near, drawn, fixed)
    volts = {n: float(v) for n, v in fixed.items()}
    if len(near) > len(fixed):
        volts |= _dense_part(near, fixed, drawn)
    most = sum(abs(i) for i in loads.values())
    for n, branches in reversed(order):
        if not branches:  # the last node of a part that no fixed one is in
            if abs(drawn[n]) > 1e-10 * most:
                raise ArithmeticError("current is drawn where no fixed voltage is")
            volts[n] = 0.0
            continue
        by = volts[next(iter(branches))]
        volts[n] = by + (sum(g * (volts[m] - by) for m, g in branches.items()) - drawn[n]) / sum(branches.values())
    return {n: volts[n] for n in nodes}


def _dense_part(near: dict[int, dict[int, float]], fixed: dict[int, float], drawn: dict[int, float]) -> dict[int, float]:
    """Voltages of the free nodes of ``near`` by conjugate gradient."""
    at = {n: k for k, n in enumerate(near)}
    pairs = [(at[x], at[y], g) for x, branches in near.items() for y, g in branches.items() if at[x] < at[y]]
    a = np.array([x for x, _, _ in pairs], dtype=np.int64)
    b = np.array([y for _, y, _ in pairs], dtype=np.int64)
    siemens = np.array([g for _, _, g in pairs])
    volts, free = np.zeros(len(at)), np.ones(len(at), dtype=bool)
    for n, v in fixed.items():
        volts[at[n]], free[at[n]] = v, False

    def flow(v: np.ndarray) -> np.ndarray:
        """Current that leaves each node."""
        along = siemens * (v[a] - v[b])
        return np.bincount(a, along, len(at)) - np.bincount(b, along, len(at))

    load, whole = np.array([drawn[n] for n in at]), np.zeros(len(at))

    def product(x: np.ndarray) -> np.ndarray:
        whole[free] = x
        return flow(np.where(free, whole, 0.0))[free]

    diagonal = (np.bincount(a, siemens, len(at)) + np.bincount(b, siemens, len(at)))[free]
    volts[free] = conjugate_gradient(product, (-flow(np.where(free, 0.0, volts)) - load)[free], diagonal, rounds=max(20_000, 4 * int(free.sum())))
    return {n: float(volts[k]) for n, k in at.items() if n not in fixed}


def effective_resistance(edges: list[tuple[int, int, float]], a: int, b: int) -> float:
    """Between two nodes, from the network's Laplacian; not connected: infinite."""
    nodes = sorted({n for x, y, _ in edges for n in (x, y)} | {a, b})
    at = {n: k for k, n in enumerate(nodes)}
    g = np.zeros((len(nodes), len(nodes)))
    for x, y, ohm in edges:
        for p, q in ((at[x], at[y]), (at[y], at[x])):
            g[p, p] += 1 / ohm
            g[p, q] -= 1 / ohm
    e = np.zeros(len(nodes))
    e[at[a]], e[at[b]] = 1, -1
    v = np.linalg.pinv(g) @ e
    return float(e @ v) if np.allclose(g @ v, e, atol=1e-8) else float("inf")


def shortest_path(edges: list[tuple[str, str, float, float, float]], src: str, dst: str, current: float, most_volts: float) -> tuple[float, list[str]] | None:
    """Least resistance over edges (a, b, ohm, capacity, clamp volts) that carry ``current`` and clamp low enough; None without a path."""
    near = defaultdict(list)
    for a, b, ohm, capacity, clamp in edges:
        if capacity >= current and clamp <= most_volts:
            near[a].append((b, ohm))
            near[b].append((a, ohm))
    heap: list[tuple[float, str, list[str]]] = [(0.0, src, [src])]
    done: set[str] = set()
    while heap:
        d, n, path = heapq.heappop(heap)
        if n == dst:
            return d, path
        if n in done:
            continue
        done.add(n)
        for m, ohm in near[n]:
            if m not in done:
                heapq.heappush(heap, (d + ohm, m, [*path, m]))
    return None


def colour(edges: list[tuple[int, int]], colours: int, states: int = 1_000_000) -> tuple[str, dict[int, int]]:
    """``("coloured", mask by node)``, ``("conflict", {})`` or ``("unknown", {})`` after ``states`` states; most constrained node first."""
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    done: dict[int, int] = {}
    left = states

    def go() -> bool | None:
        nonlocal left
        if len(done) == len(near):
            return True
        left -= 1
        if left < 0:
            return None
        n = max((x for x in near if x not in done), key=lambda x: (len({done[y] for y in near[x] if y in done}), len(near[x]), -x))
        taken = {done[y] for y in near[n] if y in done}
        fresh = max(done.values(), default=-1) + 1
        for c in range(min(colours, fresh + 1)):  # colours not used yet are alike
            if c not in taken:
                done[n] = c
                found = go()
                if found is not False:
                    return found
                del done[n]
        return False

    found = go()
    return ("coloured", dict(done)) if found else ("unknown" if found is None else "conflict", {})


def elmore(edges: list[tuple[int, int, float]], caps: dict[int, float], root: int) -> dict[int, float]:
    """Delay to each node of a resistor tree: the sum over its path of resistance times the capacitance beyond; a cycle raises."""
    near = defaultdict(list)
    for a, b, ohm in edges:
        near[a].append((b, ohm))
        near[b].append((a, ohm))
    order, parent, todo = [], {root: (root, 0.0)}, [root]
    while todo:
        n = todo.pop()
        order.append(n)
        for m, ohm in near[n]:
            if m == parent[n][0]:
                continue
            if m in parent:
                raise ValueError("not a tree")
            parent[m] = (n, ohm)
            todo.append(m)
    below = {n: caps.get(n, 0.0) for n in order}
    for n in reversed(order[1:]):
        below[parent[n][0]] += below[n]
    delay = {root: 0.0}
    for n in order[1:]:
        p, ohm = parent[n]
        delay[n] = delay[p] + ohm * below[n]
    return delay


EPS0 = 8.8541878128e-12
MU0 = 4e-7 * np.pi


def panel_capacitance(centres: np.ndarray, areas: np.ndarray, conductor: np.ndarray, permittivity: float = EPS0) -> np.ndarray:
    """Maxwell capacitance matrix (farads) of square panels by collocation: point charges off, an equal square's mean potential on the diagonal."""
    d = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    np.fill_diagonal(d, 1.0)
    p = 1 / (4 * np.pi * permittivity * d)
    # potential at the middle of a uniformly charged square of side s: 4 ln(1 + sqrt 2) / s
    np.fill_diagonal(p, 4 * np.log(1 + np.sqrt(2)) / (4 * np.pi * permittivity * np.sqrt(areas)))
    n = int(conductor.max()) + 1
    v = (conductor[:, None] == np.arange(n)[None]).astype(float)
    q = np.linalg.solve(p, v)
    return v.T @ q


def gmres(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-3, restart: int = 50, rounds: int = 40) -> np.ndarray:
    """Restarted GMRES for real or complex systems; no convergence raises."""
    x = np.zeros_like(b)
    for _ in range(rounds):
        r = b - a @ x
        beta = np.linalg.norm(r)
        if beta <= tolerance * np.linalg.norm(b):
            return x
        q, h = [r / beta], np.zeros((restart + 1, restart), dtype=np.result_type(a, b))
        k = 0
        for k in range(restart):
            w = a @ q[k]
            for j in range(k + 1):
                h[j, k] = np.vdot(q[j], w)
                w = w - h[j, k] * q[j]
            h[k + 1, k] = np.linalg.norm(w)
            if abs(h[k + 1, k]) < 1e-14:
                break
            q.append(w / h[k + 1, k])
        e = np.zeros(k + 2, dtype=h.dtype)
        e[0] = beta
        y = np.linalg.lstsq(h[: k + 2, : k + 1], e, rcond=None)[0]
        x = x + np.stack(q[: k + 1], axis=1) @ y
    raise ArithmeticError("GMRES did not converge")

"""Input of the field solvers: panel files and lists of them, and conductor segments with ports."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .spice import number

Point3 = tuple[float, float, float]

# Metres a unit.
UNITS = {"km": 1e3, "m": 1.0, "cm": 1e-2, "mm": 1e-3, "um": 1e-6, "in": 0.0254, "mils": 2.54e-5}
#: Siemens a metre of a conductor of which nothing is said; the file's own values are by its unit of length.
COPPER = 5.8e7


@dataclass
class Panel:
    conductor: str
    corners: list[Point3]


@dataclass
class Surface:
    """Panels with what lies on both sides: a conductor in ``outside``, or a dielectric between two permittivities."""

    panels: list[Panel]
    outside: float = 1.0
    inside: float | None = None
    reference: Point3 | None = None


def panels(text: str, shift: Point3 = (0.0, 0.0, 0.0)) -> list[Panel]:
    """Panels of a file: ``Q name 12 numbers``, ``T name 9 numbers``; a first line ``0 title``, comments ``*``, and ``N old new`` to rename."""
    out, names = [], {}
    for k, raw in enumerate(text.splitlines()):
        words = raw.split()
        if not words or raw.startswith("*") or (k == 0 and words[0].startswith("0")):
            continue
        kind = words[0].upper()
        if kind == "N":
            names[words[1]] = words[2]
            continue
        if kind not in ("Q", "T"):
            raise ValueError(f"line {k + 1}: no panel: {raw}")
        n = 12 if kind == "Q" else 9
        v = [float(w) for w in words[2 : 2 + n]]
        if len(v) != n:
            raise ValueError(f"line {k + 1}: {len(v)} of {n} numbers")
        out.append(Panel(words[1], [tuple(v[i + j] + shift[j] for j in range(3)) for i in range(0, n, 3)]))  # type: ignore[misc]
    for p in out:
        p.conductor = names.get(p.conductor, p.conductor)
    return out


def surfaces(text: str, load: Callable[[str], str]) -> list[Surface]:
    """A list file: ``C file permittivity x y z [+]`` for conductors (``+`` joins the next one's names to the same group), ``D file outer inner x y z rx ry rz`` for dielectrics."""
    out: list[Surface] = []
    group, joined = 0, False
    for k, raw in enumerate(text.splitlines()):
        words = raw.split()
        if not words or words[0] in ("*", "#") or raw.startswith("*"):
            continue
        kind = words[0].upper()
        if kind == "C":
            if not joined:
                group += 1
            joined = words[-1] == "+"
            v = [float(w) for w in words[2:6]]
            own = panels(load(words[1]), (v[1], v[2], v[3]))
            for p in own:
                p.conductor = f"{p.conductor}%{group}"
            out.append(Surface(own, v[0]))
        elif kind == "D":
            v = [float(w) for w in words[2:10]]
            out.append(Surface(panels(load(words[1]), (v[2], v[3], v[4])), v[0], v[1], (v[5], v[6], v[7])))
        else:
            raise ValueError(f"line {k + 1}: not understood: {raw}")
    return out


@dataclass
class Segment:
    name: str
    a: str
    b: str
    width: float
    height: float
    sigma: float
    nw: int = 1
    nh: int = 1


@dataclass
class Inductors:
    """Nodes in metres, segments, groups of equivalent nodes, ports between two nodes, and the sweep (from, to, points a decade)."""

    nodes: dict[str, Point3] = field(default_factory=dict)
    segments: list[Segment] = field(default_factory=list)
    equal: list[list[str]] = field(default_factory=list)
    ports: list[tuple[str, str, str]] = field(default_factory=list)
    sweep: tuple[float, float, float] = (1.0, 1.0, 1.0)


def inductors(text: str) -> Inductors:
    """Nodes ``N``, segments ``E``, ``.units .default .equiv .external .freq .end``, continuation by ``+``; ground planes become a grid of segments."""
    out, scale = Inductors(), 1.0
    default: dict[str, float] = {"nwinc": 1, "nhinc": 1}
    lines: list[str] = []
    for k, raw in enumerate(text.splitlines()):
        if k == 0 or raw.startswith("*") or not raw.strip():  # the first line is a title
            continue
        if raw.startswith("+") and lines:
            lines[-1] += " " + raw[1:]
        else:
            lines.append(raw.strip())
    for line in lines:
        line = re.sub(r"\s*=\s*", "=", line)
        words = line.split()
        head = words[0].lower()
        given = {w.split("=")[0].lower(): w.split("=")[1] for w in words if "=" in w}
        if head == ".units":
            if words[1].lower() not in UNITS:
                raise ValueError(f"unit {words[1]}")
            scale = UNITS[words[1].lower()]
        elif head == ".default":
            default |= {k: number(v) for k, v in given.items()}
        elif head == ".equiv":
            out.equal.append(words[1:])
        elif head == ".external":
            out.ports.append((words[1], words[2], words[3] if len(words) > 3 else f"port{len(out.ports) + 1}"))
        elif head == ".freq":
            out.sweep = (number(given["fmin"]), number(given["fmax"]), number(given.get("ndec", "1")))
        elif head == ".end":
            break
        elif head[0] == "n":
            at = [number(given.get(c, str(default.get(c, 0.0)))) * scale for c in "xyz"]
            out.nodes[head] = (at[0], at[1], at[2])
        elif head[0] == "e":
            of = lambda k: number(given[k]) if k in given else default[k]  # noqa: B023, E731
            sigma = 1 / number(given["rho"]) if "rho" in given else number(given["sigma"]) if "sigma" in given else default.get("sigma", COPPER * scale)
            out.segments.append(Segment(head, words[1].lower(), words[2].lower(), of("w") * scale, of("h") * scale, sigma / scale, int(of("nwinc")), int(of("nhinc"))))
        elif head[0] == "g":
            plane(out, head, words, given, default, scale)
        else:
            raise ValueError(f"not understood: {line}")
    out.equal = [[n.lower() for n in g] for g in out.equal]
    out.ports = [(a.lower(), b.lower(), n) for a, b, n in out.ports]
    lost = {n for s in out.segments for n in (s.a, s.b)} - out.nodes.keys()
    if lost:
        raise ValueError(f"no node {sorted(lost)[0]}")
    return out


def plane(out: Inductors, name: str, words: list[str], given: dict[str, str], default: dict[str, float], scale: float) -> None:
    """A ground plane of three corners as a grid of ``seg1`` by ``seg2`` segments; nodes written behind it as ``name (x,y,z)`` are its nearest grid nodes."""
    corner = [tuple(number(given[f"{c}{k}"]) * scale for c in "xyz") for k in (1, 2, 3)]
    n1, n2 = int(number(given["seg1"])), int(number(given["seg2"]))
    thick = number(given["thick"]) * scale
    sigma = (number(given["sigma"]) if "sigma" in given else default.get("sigma", COPPER * scale)) / scale
    u = [(corner[1][j] - corner[0][j]) / n1 for j in range(3)]
    v = [(corner[2][j] - corner[1][j]) / n2 for j in range(3)]
    length = lambda d: sum(x * x for x in d) ** 0.5
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            out.nodes[f"{name}_{i}_{j}"] = tuple(corner[0][k] + i * u[k] + j * v[k] for k in range(3))  # type: ignore[assignment]
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if i < n1:
                out.segments.append(Segment(f"{name}_u{i}_{j}", f"{name}_{i}_{j}", f"{name}_{i + 1}_{j}", length(v), thick, sigma))
            if j < n2:
                out.segments.append(Segment(f"{name}_v{i}_{j}", f"{name}_{i}_{j}", f"{name}_{i}_{j + 1}", length(u), thick, sigma))
    for m in re.finditer(r"(\w+)\s*\(([^)]*)\)", " ".join(words)):
        at = [float(x) * scale for x in m[2].split(",")]
        near = min((n for n in out.nodes if n.startswith(f"{name}_")), key=lambda n: sum((out.nodes[n][k] - at[k]) ** 2 for k in range(3)))
        out.nodes[m[1].lower()] = out.nodes[near]
        out.equal.append([m[1].lower(), near])

"""Comparison cell by cell, from the leaves up, and the cells of a layout as netlists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from ..functions.kernels import Box, decompose, stroke
from ..functions.matching import Part, Verdict, match
from ..sources import gds
from ..sources.spice import Instance, Netlist, Subckt, evaluate


@dataclass(frozen=True)
class HierOptions:
    """``equate``: layout cell to reference cell where names differ; ``flatten``: all, none, or these layout cells go up into their
    parents; ``black_boxes``: cells of which only the ports are compared; ``instances``: most placements a cell may expand to."""

    equate: Mapping[str, str] = field(default_factory=dict)
    flatten: frozenset[str] | str = frozenset()
    black_boxes: frozenset[str] = frozenset()
    instances: int = 1_000_000
    states: int = 1_000_000
    tolerance: Mapping[str, tuple[float, float]] = field(default_factory=dict)


@dataclass
class HierResult:
    """``cells``: the verdict of each layout cell; ``flattened``: cells that didn't match and were compared within their parents."""

    status: str
    cells: dict[str, Verdict]
    flattened: list[str]


def order(n: Netlist, top: str) -> list[str]:
    """Cells below ``top``, children first; a cycle or a missing cell raises."""
    out: list[str] = []
    open_: list[str] = []

    def go(name: str) -> None:
        if name in open_:
            raise ValueError("cycle: " + " -> ".join([*open_, name]))
        if name in out:
            return
        if name not in n.subckts:
            raise ValueError(f"no subcircuit {name}")
        open_.append(name)
        for i in n.subckts[name].items:
            if i.kind == "x":
                go(i.model)
        open_.pop()
        out.append(name)

    go(top)
    return out


def _props(i: Instance) -> tuple[tuple[str, float], ...]:
    out = []
    for k, v in i.params.items():
        if k in ("w", "l", "value"):
            out.append((k, evaluate(v, {})))
    if i.kind in "rc" and i.model and "value" not in i.params:
        try:
            out.append(("value", evaluate(i.model, {})))
        except ValueError:
            pass
    return tuple(sorted(out))


def _device(i: Instance, nets: Sequence[str], name: str, n: Netlist) -> Part:
    """Roles by kind: source and drain, and both ends of resistors and capacitors, may be exchanged; diodes are polar."""
    if i.kind == "m":
        roles: Sequence[str] = ("sd", "g", "sd", "b")
    elif i.kind == "q":
        roles = ("c", "b", "e")
    elif i.kind == "d":
        roles = ("a", "k")
    else:
        roles = ("t", "t")
    kind = n.models.get(i.model, i.model) if i.kind in "mqd" else i.kind
    return Part(name, f"{i.kind}:{kind}", tuple(zip(roles, nets, strict=False)), _props(i))


def parts(n: Netlist, cell: str, whole: Mapping[str, str], limit: int) -> list[Part]:
    """A cell's parts: its devices, its placed cells that are ``whole`` (cell: the name of their match) as one part each, and what the others hold."""
    out: list[Part] = []

    def go(c: Subckt, prefix: str, nets: Mapping[str, str]) -> None:
        full = lambda x: x if x in n.globals else nets.get(x, prefix + x)
        for i in c.items:
            own = [full(x) for x in i.nets]
            if i.kind != "x":
                out.append(_device(i, own, prefix + i.name, n))
            elif i.model in whole:
                out.append(Part(prefix + i.name, f"cell:{whole[i.model]}", tuple(zip((f"port {p}" for p in n.subckts[i.model].ports), own, strict=True))))
            else:
                child = n.subckts[i.model]
                if len(child.ports) != len(own):
                    raise ValueError(f"{i.name}: {len(own)} nets for {len(child.ports)} ports")
                go(child, f"{prefix}{i.name}/", dict(zip(child.ports, own, strict=True)))
            if len(out) > limit:
                raise ValueError(f"more than {limit} parts in {cell}")

    c = n.subckts[cell]
    go(c, "", {p: p for p in c.ports})
    return out


def compare(layout: Netlist, reference: Netlist, top: str, reference_top: str | None = None, options: HierOptions | None = None) -> HierResult:
    """Cell by cell from the leaves up.

    Cells correspond by name or ``equate``. One that matches is a part of its
    parents on both sides, its ports by name; one that doesn't,
    or has no counterpart, goes up into them and is compared there. The top
    cell's verdict decides. Equal cells are compared once.
    """
    o = options or HierOptions()
    other = {c: o.equate.get(c, c) for c in layout.subckts}
    other[top] = reference_top or other[top]
    verdicts: dict[str, Verdict] = {}
    whole_l: dict[str, str] = {}
    whole_r: dict[str, str] = {}
    flattened: list[str] = []
    known: dict[tuple, Verdict] = {}
    below_r = set(order(reference, other[top]))
    for cell in order(layout, top):
        mate = other[cell]
        up = o.flatten == "all" or (o.flatten != "all" and cell in o.flatten)
        if cell != top and (mate not in below_r or up):
            flattened.append(cell)
            continue
        lp, rp = layout.subckts[cell].ports, reference.subckts[mate].ports
        if cell in o.black_boxes:
            verdict = Verdict("Match") if sorted(lp) == sorted(rp) else Verdict("Mismatch", "ports of a black box differ", "ports")
        else:
            a, b = parts(layout, cell, whole_l, o.instances), parts(reference, mate, whole_r, o.instances)
            key = (tuple(sorted(a, key=lambda p: p.name)), tuple(sorted(b, key=lambda p: p.name)), tuple(lp), tuple(rp))
            if key not in known:
                known[key] = match(a, b, {p: p for p in lp if p in set(rp)}, o.states, o.tolerance)
            verdict = known[key]
            if verdict.status == "Match" and sorted(lp) != sorted(rp):
                verdict = Verdict("Mismatch", "ports differ", "ports", sorted(set(lp) - set(rp)), sorted(set(rp) - set(lp)))
        verdicts[cell] = verdict
        if verdict.status == "Match":
            whole_l[cell], whole_r[mate] = mate, mate
        elif cell != top:
            flattened.append(cell)
    return HierResult(verdicts[top].status, verdicts, flattened)


# --- layouts --------------------------------------------------------------------------


@dataclass(frozen=True)
class CellDeck:
    """Layers (layer, datatype): ``conductors`` and ``cuts`` (cut: what it joins), ``mos`` as (name, kind, gate, channel, implant),
    ``labels``: text layer to the conductor whose shapes its texts name."""

    conductors: tuple[tuple[int, int], ...]
    cuts: Mapping[tuple[int, int], tuple[tuple[int, int], ...]]
    mos: tuple[tuple[str, str, tuple[int, int], tuple[int, int], tuple[int, int]], ...]
    labels: Mapping[tuple[int, int], tuple[int, int]]


def _over(a: Box, b: Box) -> Box | None:
    x = (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    return x if x[0] < x[2] and x[1] < x[3] else None


def _touch(a: Box, b: Box) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def _near(boxes: list[tuple[Box, int]], cell: int = 4096) -> Iterable[tuple[int, int]]:
    """Pairs of boxes that touch, by bins."""
    bins: dict[tuple[int, int], list[int]] = {}
    for k, (b, _) in enumerate(boxes):
        for i in range(b[0] // cell, b[2] // cell + 1):
            for j in range(b[1] // cell, b[3] // cell + 1):
                bins.setdefault((i, j), []).append(k)
    seen = set()
    for own in bins.values():
        for x in range(len(own)):
            for y in range(x):
                pair = (own[y], own[x])
                if pair not in seen and _touch(boxes[pair[0]][0], boxes[pair[1]][0]):
                    seen.add(pair)
                    yield pair


def layout_cells(lib: gds.Library, deck: CellDeck, depth: int = 256) -> Netlist:
    """Every structure of a layout as a subcircuit: its own transistors, its placed cells, and as ports the nets that its texts name.

    Texts are the only evidence of ports. A placed cell's port is on the net of
    the parent's shape of the same layer that the port's shapes, moved, touch;
    one that meets none, or several nets, raises. Channels are cut at gates.
    """
    out = Netlist()
    shapes_of: dict[str, dict[str, list[tuple[tuple[int, int], Box]]]] = {}

    def build(name: str, path: tuple[str, ...]) -> None:
        if name in out.subckts:
            return
        if name in path or len(path) > depth:
            raise ValueError("cycle: " + " -> ".join([*path, name]))
        if name not in lib.structures:
            raise ValueError(f"no structure {name}")
        own: dict[tuple[int, int], list[Box]] = {}
        texts, placed = [], []
        for e in lib.structures[name].elements:
            if e.kind in ("sref", "aref"):
                build(e.sname, (*path, name))
                origin = e.xy[0]
                shifts = [origin]
                if e.kind == "aref":
                    (x, y), (cx, cy), (rx, ry) = e.xy[:3]
                    col, row = (gds.pitch(cx, x, e.columns), gds.pitch(cy, y, e.columns)), (gds.pitch(rx, x, e.rows), gds.pitch(ry, y, e.rows))
                    shifts = [(x + i * col[0] + j * row[0], y + i * col[1] + j * row[1]) for i in range(e.columns) for j in range(e.rows)]
                placed += [(e, gds.instance(e, at)) for at in shifts]
            elif e.kind == "text":
                texts.append(e)
            elif e.kind != "node":
                for ring in stroke(e.xy, e.width, e.pathtype) if e.kind == "path" else [e.xy[:-1] if e.xy[0] == e.xy[-1] else e.xy]:
                    own.setdefault((e.layer, e.datatype), []).extend(decompose(ring))
        channels = {m[3] for m in deck.mos}
        nodes: list[tuple[Box, tuple[int, int]]] = []
        devices: list[tuple[str, Box, int, list[tuple[Box, int]], bool]] = []
        for layer in (*deck.conductors, *deck.cuts):
            if layer not in channels:
                nodes += [(b, layer) for b in own.get(layer, [])]
        for layer in channels:
            for d in own.get(layer, []):
                gates = [(x, g, m) for m in deck.mos if m[3] == layer for g in own.get(m[2], []) if (x := _over(g, d))]
                along = 2 * sum(x[1] <= d[1] and x[3] >= d[3] for x, _, _ in gates) >= len(gates)
                lo, hi = (0, 2) if along else (1, 3)
                spans: list[list[int]] = []
                for x, _, _ in sorted(gates, key=lambda t: t[0][lo]):
                    if spans and x[lo] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[hi])
                    else:
                        spans.append([x[lo], x[hi]])
                at, segments = d[lo], []
                for s, e_ in [*spans, [d[hi], d[hi]]]:
                    if s > at:
                        box = (at, d[1], s, d[3]) if along else (d[0], at, d[2], s)
                        segments.append((box, len(nodes)))
                        nodes.append((box, layer))
                    at = e_
                for x, g, m in gates:
                    fits = [r for r in deck.mos if r[2] == m[2] and r[3] == layer and any(_over(x, i) for i in own.get(r[4], []))]
                    if m not in fits:
                        continue
                    if len(fits) > 1:
                        raise ValueError(f"{name}: a gate meets rules {[r[0] for r in fits]}")
                    devices.append((m[1], x, next(k for k, (b, la) in enumerate(nodes) if b == g and la == m[2]), segments, along))
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in _near([(b, 0) for b, _ in nodes]):
            (a, la), (b, lb) = nodes[i], nodes[j]
            if la == lb or (_over(a, b) and (lb in deck.cuts.get(la, ()) or la in deck.cuts.get(lb, ()))):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
        names: dict[int, str] = {}
        for t in texts:
            on = deck.labels.get((t.layer, t.datatype))
            hit = next((k for k, (b, la) in enumerate(nodes) if la == on and b[0] <= t.xy[0][0] <= b[2] and b[1] <= t.xy[0][1] <= b[3]), None)
            if hit is not None:
                names.setdefault(root(hit), t.text)
        net = lambda k: names.get(root(k), f"n{root(k)}")
        cell = Subckt(name.lower(), list(dict.fromkeys(names.values())))
        for k, (kind, x, gate, segments, along) in enumerate(devices):
            lo, hi = (0, 2) if along else (1, 3)
            before = [s for s in segments if s[0][hi] <= x[lo]]
            after = [s for s in segments if s[0][lo] >= x[hi]]
            if before and after:
                w, length = (x[3] - x[1], x[2] - x[0]) if along else (x[2] - x[0], x[3] - x[1])
                cell.items.append(Instance(f"m{k}", "m", [net(after[0][1]), net(gate), net(before[-1][1])], kind, {"w": f"{w}n", "l": f"{length}n"}))
        for k, (e, t) in enumerate(placed):
            child = out.subckts[e.sname.lower()]
            ends = []
            for port in child.ports:
                met = set()
                for layer, b in shapes_of[e.sname][port]:
                    p, q = gds.apply(t, (b[0], b[1])), gds.apply(t, (b[2], b[3]))
                    moved = (min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1]))
                    met |= {root(i) for i, (o, la) in enumerate(nodes) if la == layer and _touch(o, moved)}
                if len(met) != 1:
                    raise ValueError(f"{name}: port {port} of {e.sname} is on {len(met)} nets")
                ends.append(net(met.pop()))
            cell.items.append(Instance(f"x{k}", "x", ends, child.name, {}))
        shapes_of[name] = {p: [(la, b) for k, (b, la) in enumerate(nodes) if names.get(root(k)) == p and la in deck.conductors] for p in cell.ports}
        out.subckts[cell.name] = cell

    for top in gds.tops(lib):
        build(top, ())
    return out

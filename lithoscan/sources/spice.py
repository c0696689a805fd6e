"""SPICE netlists: a fail-closed subset as a tree of subcircuits, flattened to device rows; and writing."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

# Engineering suffixes.
SUFFIXES = {"t": 1e12, "g": 1e9, "meg": 1e6, "k": 1e3, "mil": 25.4e-6, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15}
_NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(meg|mil|[tgkmunpf])?[a-z]*$", re.I)
DEVICE_KINDS = ("nmos", "pmos", "npn", "pnp")
PINS = {"m": 4, "r": 2, "c": 2, "d": 2, "q": 3}


def number(text: str) -> float:
    m = _NUMBER.match(text.strip())
    if not m:
        raise ValueError(f"not a number: {text}")
    return float(m[1]) * SUFFIXES.get((m[2] or "").lower(), 1.0)


def evaluate(text: str, names: dict[str, float]) -> float:
    """A number, a parameter, or an expression of + - * / ^ and parentheses, in quotes or braces."""
    s = text.strip().strip("'{}\"").strip()
    try:
        return number(s)
    except ValueError:
        pass

    def of(n: ast.AST) -> float:
        if isinstance(n, ast.Expression):
            return of(n.body)
        if isinstance(n, ast.Constant):
            return float(n.value)
        if isinstance(n, ast.Name):
            if n.id not in names:
                raise ValueError(f"no parameter {n.id}")
            return names[n.id]
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return -of(n.operand) if isinstance(n.op, ast.USub) else of(n.operand)
        ops: dict[type, Callable[[float, float], float]] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: lambda a, b: a**b}
        if isinstance(n, ast.BinOp) and type(n.op) in ops:
            return ops[type(n.op)](of(n.left), of(n.right))
        raise ValueError(f"expression {text}")

    plain = re.sub(r"(?<![\w.])(\d+\.?\d*|\.\d+)(meg|mil|[tgkmunpf])\b", lambda m: repr(number(m[0])), s.lower())
    try:
        return of(ast.parse(plain.replace("^", "**"), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"expression {text}") from e


def expand_bus(name: str) -> list[str]:
    """``A[3:0]`` as its four bits, other names as they are."""
    m = re.fullmatch(r"(.*)[\[<](\d+):(\d+)[\]>]", name)
    if not m:
        return [name]
    a, b = int(m[2]), int(m[3])
    return [f"{m[1]}[{i}]" for i in (range(a, b - 1, -1) if a >= b else range(a, b + 1))]


@dataclass
class Instance:
    name: str
    kind: str
    nets: list[str]
    model: str
    params: dict[str, str]


@dataclass
class Subckt:
    name: str
    ports: list[str]
    params: dict[str, str] = field(default_factory=dict)
    items: list[Instance] = field(default_factory=list)


@dataclass
class Netlist:
    subckts: dict[str, Subckt] = field(default_factory=dict)
    top: Subckt = field(default_factory=lambda: Subckt("", []))
    models: dict[str, str] = field(default_factory=dict)
    globals: set[str] = field(default_factory=set)


def _split(words: list[str]) -> tuple[list[str], dict[str, str]]:
    plain = [w for w in words if "=" not in w]
    return plain, {k.lower(): v for k, v in (w.split("=", 1) for w in words if "=" in w)}


def parse(text: str, include: Callable[[str], str] | None = None, _into: Netlist | None = None, _seen: tuple[str, ...] = ()) -> Netlist:
    """The netlist of a text; ``include`` gives the text of an included file. What isn't understood raises."""
    out = _into or Netlist()
    lines: list[str] = []
    for raw in text.splitlines():
        line = re.split(r"\s\$|;", raw, maxsplit=1)[0].rstrip()
        if line.startswith("+") and lines:
            lines[-1] += " " + line[1:]
        elif line.strip() and not line.lstrip().startswith("*"):
            lines.append(line.strip())
    cell = out.top
    for line in lines:
        line = re.sub(r"\s*=\s*", "=", line)
        words = re.findall(r"(?:[^\s'{]|'[^']*'|\{[^}]*\})+", line)
        head = words[0].lower()
        if head == ".subckt":
            if cell is not out.top:
                raise ValueError("subcircuit within a subcircuit")
            plain, params = _split(words[1:])
            cell = Subckt(plain[0].lower(), [b for p in plain[1:] for b in expand_bus(p)], params)
            if cell.name in out.subckts:
                raise ValueError(f"second subcircuit {cell.name}")
            out.subckts[cell.name] = cell
        elif head == ".ends":
            if cell is out.top:
                raise ValueError(".ends without .subckt")
            cell = out.top
        elif head == ".global":
            out.globals |= set(words[1:])
        elif head == ".param":
            cell.params |= _split(words[1:])[1]
        elif head == ".model":
            out.models[words[1].lower()] = words[2].lower()
        elif head in (".include", ".lib"):
            name = words[1].strip("'\"")
            if include is None or name in _seen:
                raise ValueError(f"include of {name}")
            parse(include(name), include, out, (*_seen, name))
        elif head == ".end":
            break
        elif head == ".endl":
            continue
        elif head[0] in PINS or head[0] == "x":
            plain, params = _split(words[1:])
            nets = [b for p in plain for b in expand_bus(p)]
            if head[0] == "x":
                cell.items.append(Instance(words[0], "x", nets[:-1], nets[-1].lower(), params))
            else:
                n = PINS[head[0]]
                if len(nets) < n:
                    raise ValueError(f"too few pins: {line}")
                rest = nets[n:]
                cell.items.append(Instance(words[0], head[0], nets[:n], rest[0].lower() if rest else "", params))
        else:
            raise ValueError(f"not understood: {line}")
    return out


@dataclass
class Device:
    path: str
    kind: str
    model: str
    nets: tuple[str, ...]
    params: dict[str, float]


def flatten(n: Netlist, top: str | None = None, limit: int = 1_000_000) -> list[Device]:
    """Devices of a subcircuit (or the top level) with their nets' full names; cycles, missing cells and wrong port counts raise."""
    out: list[Device] = []

    def walk(c: Subckt, prefix: str, nets: dict[str, str], given: dict[str, float], path: tuple[str, ...]) -> None:
        if c.name and c.name in path:
            raise ValueError("cycle: " + " -> ".join([*path, c.name]))
        names = {**{k: v for k, v in given.items()}}
        for k, v in c.params.items():
            names.setdefault(k, evaluate(v, names))
        full = lambda net: net if net in n.globals else nets.get(net, prefix + net)
        for i in c.items:
            params = {k: evaluate(v, names) for k, v in i.params.items()}
            own = [full(x) for x in i.nets]
            if i.kind == "x":
                sub = n.subckts.get(i.model)
                if sub is None:
                    raise ValueError(f"no subcircuit {i.model}")
                if len(sub.ports) != len(own):
                    raise ValueError(f"{i.name}: {len(own)} nets for {len(sub.ports)} ports")
                walk(sub, f"{prefix}{i.name}/", dict(zip(sub.ports, own, strict=True)), params, (*path, c.name))
                continue
            if i.kind in "rc" and i.model and "value" not in params:
                try:
                    params["value"], model = evaluate(i.model, names), ""
                except ValueError:
                    model = i.model
            else:
                model = i.model
            out.append(Device(prefix + i.name, n.models.get(model, model if model in DEVICE_KINDS else {"m": "nmos", "q": "npn"}.get(i.kind, i.kind)) if i.kind in "mqd" else i.kind, model, tuple(own), params))
            if len(out) > limit:
                raise ValueError(f"more than {limit} devices")

    walk(n.subckts[top.lower()] if top else n.top, "", {}, {}, ())
    return out


def device_rows(devices: list[Device], dbu: float = 1e-9) -> tuple[list[tuple], str]:
    """Transistors as rows ``(dev_id, kind, g, s, d, w, l)`` with nets numbered by name, and their schema."""
    names = {x: i for i, x in enumerate(sorted({x for d in devices for x in d.nets}))}
    rows = [(i, d.kind, names[d.nets[1]], names[d.nets[2]], names[d.nets[0]], round(d.params.get("w", 0) / dbu), round(d.params.get("l", 0) / dbu)) for i, d in enumerate(devices) if len(d.nets) == 4]
    return rows, "dev_id long, kind string, g long, s long, d long, w long, l long"


def write(name: str, ports: list[str], devices: list[tuple], parasitics: list[tuple[str, float, float]] = ()) -> str:
    """A subcircuit of ``(id, kind, g, s, d, w, l)`` rows in nm, with a lumped resistor and capacitor for each ``(port, ohm, af)``."""
    out = [f".subckt {name} {' '.join(ports)}"]
    for i, kind, g, s, d, w, length in sorted(devices):
        body = "vss" if kind == "nmos" else "vdd"
        out.append(f"M{i} n{d} n{g} n{s} {body} {kind} W={w}n L={length}n")
    for port, ohm, af in sorted(parasitics):
        out += [f"R_{port} {port} {port}_i {ohm:.6g}", f"C_{port} {port}_i 0 {af:.6g}a"]
    return "\n".join([*out, f".ends {name}", ""])

"""Spectre netlists, a fail-closed subset, into the same tree as SPICE ones."""

from __future__ import annotations

import re
from collections.abc import Callable

from .spice import Instance, Netlist, Subckt, expand_bus

# Primitive names of the language, by the kinds of the tree.
PRIMITIVES = {"resistor": ("r", "r"), "capacitor": ("c", "c"), "diode": ("d", ""), "bsim4": ("m", "l"), "bsim3v3": ("m", "l"), "mos1": ("m", "l"), "nmos": ("m", "l"), "pmos": ("m", "l"), "npn": ("q", "area"), "pnp": ("q", "area"), "bjt": ("q", "area")}
PINS = {"m": 4, "r": 2, "c": 2, "d": 2, "q": 3}
SILENT = ("simulator", "global", "//", "*")


def _logical(text: str) -> list[str]:
    """Lines without comments, continued ones (a backslash at the end, or a plus at the start) joined."""
    out: list[str] = []
    keep = False
    for raw in text.splitlines():
        line = raw.split("//", 1)[0].rstrip()
        if line.lstrip().startswith("*"):
            continue
        more = line.endswith("\\")
        line = line.rstrip("\\").strip()
        if (keep or line.startswith("+")) and out:
            out[-1] += " " + line.lstrip("+").strip()
        elif line:
            out.append(line)
        keep = more
    return out


def parse(text: str, include: Callable[[str], str] | None = None, _into: Netlist | None = None, _seen: tuple[str, ...] = ()) -> Netlist:
    """The netlist of a text. Statements: simulator, global, parameters, model, include, subckt, ends and instances ``name (nets) master k=v``; others raise."""
    out = _into or Netlist()
    cell = out.top
    for line in _logical(text):
        line = re.sub(r"\s*=\s*", "=", line)
        head = line.split()[0].lower()
        if head == "simulator":
            if "lang=spectre" not in line.lower():
                raise ValueError(f"not understood: {line}")
        elif head == "global":
            out.globals |= set(line.split()[1:])
        elif head == "parameters":
            cell.params |= {k.lower(): v for k, v in (w.split("=", 1) for w in line.split()[1:])}
        elif head == "include":
            name = line.split(None, 1)[1].strip("\"'")
            if include is None or name in _seen:
                raise ValueError(f"include of {name}")
            parse(include(name), include, out, (*_seen, name))
        elif head == "model":
            words = line.split()
            kind = words[2].lower()
            typed = next((w.split("=", 1)[1].lower() for w in words[3:] if w.lower().startswith("type=")), "")
            out.models[words[1].lower()] = {"n": "nmos", "p": "pmos"}.get(typed, typed) or kind
        elif head == "subckt":
            if cell is not out.top:
                raise ValueError("subcircuit within a subcircuit")
            words = line.replace("(", " ").replace(")", " ").split()
            cell = Subckt(words[1].lower(), [b for p in words[2:] for b in expand_bus(p)])
            if cell.name in out.subckts:
                raise ValueError(f"second subcircuit {cell.name}")
            out.subckts[cell.name] = cell
        elif head == "ends":
            if cell is out.top:
                raise ValueError("ends without subckt")
            cell = out.top
        else:
            m = re.fullmatch(r"(\S+)\s*\(([^)]*)\)\s*(\S+)((?:\s+\S+=\S+)*)\s*", line)
            if not m:
                raise ValueError(f"not understood: {line}")
            nets = [b for p in m[2].split() for b in expand_bus(p)]
            params = {k.lower(): v for k, v in (w.split("=", 1) for w in m[4].split())}
            master = m[3].lower()
            kind = PRIMITIVES.get(master) or PRIMITIVES.get(out.models.get(master, ""))
            if kind is None:
                cell.items.append(Instance(m[1], "x", nets, master, params))
                continue
            if len(nets) != PINS[kind[0]]:
                raise ValueError(f"{m[1]}: {len(nets)} nets for {PINS[kind[0]]} pins")
            if kind[0] in "rc" and kind[1] in params:
                params["value"] = params.pop(kind[1])
            cell.items.append(Instance(m[1], kind[0], nets, master, params))
    if cell is not out.top:
        raise ValueError("subckt without ends")
    return out

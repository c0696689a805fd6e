"""GDSII streams: lossless records, a library of structures, flattening and writing."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.kernels import Ring, stroke

# Record types of the stream format.
HEADER, BGNLIB, LIBNAME, UNITS, ENDLIB, BGNSTR, STRNAME, ENDSTR = range(8)
BOUNDARY, PATH, SREF, AREF, TEXT, LAYER, DATATYPE, WIDTH, XY, ENDEL, SNAME, COLROW = range(8, 20)
NODE, TEXTTYPE, PRESENTATION, STRING, STRANS, MAG, ANGLE = 0x15, 0x16, 0x17, 0x19, 0x1A, 0x1B, 0x1C
PATHTYPE, NODETYPE, PROPATTR, PROPVALUE, BOX, BOXTYPE = 0x21, 0x2A, 0x2B, 0x2C, 0x2D, 0x2E
KINDS = {BOUNDARY: "boundary", PATH: "path", SREF: "sref", AREF: "aref", TEXT: "text", NODE: "node", BOX: "box"}
CODES = {v: k for k, v in KINDS.items()}


class LayoutError(ValueError):
    """A fault of the stream, with the byte it is at."""

    def __init__(self, what: str, at: int):
        super().__init__(f"{what} at byte {at}")
        self.at = at


def real8(data: bytes) -> float:
    """Excess-64, base-16 number."""
    head, mantissa = data[0], int.from_bytes(data[1:8])
    value = mantissa / 2.0**56 * 16.0 ** ((head & 0x7F) - 64)
    return -value if head & 0x80 else value


def to_real8(value: float) -> bytes:
    if value == 0:
        return bytes(8)
    sign, v, e = (0x80 if value < 0 else 0), abs(value), 64
    while v >= 1:
        v, e = v / 16, e + 1
    while v < 1 / 16:
        v, e = v * 16, e - 1
    mantissa = round(v * 2**56)
    if mantissa >= 1 << 56:
        mantissa, e = mantissa >> 4, e + 1
    return bytes([sign | e]) + mantissa.to_bytes(7)


@dataclass
class Element:
    kind: str
    layer: int = 0
    datatype: int = 0
    xy: list[tuple[int, int]] = field(default_factory=list)
    text: str = ""
    sname: str = ""
    width: int = 0
    pathtype: int = 0
    reflect: bool = False
    mag: float = 1.0
    angle: float = 0.0
    columns: int = 1
    rows: int = 1
    properties: list[tuple[int, str]] = field(default_factory=list)
    extra: list[tuple[int, int, bytes]] = field(default_factory=list)


@dataclass
class Structure:
    name: str
    elements: list[Element] = field(default_factory=list)


@dataclass
class Library:
    name: str
    user_unit: float = 1e-3
    metre_unit: float = 1e-9
    structures: dict[str, Structure] = field(default_factory=dict)


def records(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """``(offset, type, data type, payload)`` up to the end of the library."""
    at = 0
    while at + 4 <= len(data):
        size, kind, form = struct.unpack_from(">HBB", data, at)
        if size < 4 or at + size > len(data):
            raise LayoutError("broken record", at)
        yield at, kind, form, data[at + 4 : at + size]
        if kind == ENDLIB:
            return
        at += size
    raise LayoutError("no end of library", at)


def _ints(payload: bytes, size: int) -> list[int]:
    code = ">h" if size == 2 else ">i"
    return [v for (v,) in struct.iter_unpack(code, payload)]


def _ascii(payload: bytes) -> str:
    return payload.rstrip(b"\0").decode("latin-1")


def read(data: bytes, strict: bool = True) -> Library:
    """The library of a stream. ``strict``: unknown records raise; else they are kept with their element."""
    lib, cell, el, attr = Library(""), None, None, None
    for at, kind, form, p in records(data):
        if kind == LIBNAME:
            lib.name = _ascii(p)
        elif kind == UNITS:
            lib.user_unit, lib.metre_unit = real8(p[:8]), real8(p[8:16])
        elif kind == STRNAME:
            cell = Structure(_ascii(p))
            if cell.name in lib.structures:
                raise LayoutError(f"second structure {cell.name}", at)
            lib.structures[cell.name] = cell
        elif kind == ENDSTR:
            cell = None
        elif kind in KINDS:
            if cell is None:
                raise LayoutError("element outside a structure", at)
            el = Element(KINDS[kind])
        elif kind == ENDEL:
            if el is None or cell is None:
                raise LayoutError("end of no element", at)
            cell.elements.append(el)
            el = None
        elif el is None:
            continue
        elif kind == LAYER:
            el.layer = _ints(p, 2)[0]
        elif kind in (DATATYPE, TEXTTYPE, BOXTYPE, NODETYPE):
            el.datatype = _ints(p, 2)[0]
        elif kind == WIDTH:
            el.width = _ints(p, 4)[0]
        elif kind == PATHTYPE:
            el.pathtype = _ints(p, 2)[0]
        elif kind == XY:
            v = _ints(p, 4)
            el.xy = list(zip(v[::2], v[1::2], strict=True))
        elif kind == SNAME:
            el.sname = _ascii(p)
        elif kind == COLROW:
            el.columns, el.rows = _ints(p, 2)
        elif kind == STRING:
            el.text = _ascii(p)
        elif kind == STRANS:
            el.reflect = bool(p[0] & 0x80)
        elif kind == MAG:
            el.mag = real8(p)
        elif kind == ANGLE:
            el.angle = real8(p)
        elif kind == PROPATTR:
            attr = _ints(p, 2)[0]
        elif kind == PROPVALUE:
            el.properties.append((attr, _ascii(p)))
        elif strict and kind not in (PRESENTATION,):
            raise LayoutError(f"unknown record {kind:#x}", at)
        else:
            el.extra.append((kind, form, p))
    return lib


def _record(kind: int, form: int, payload: bytes = b"") -> bytes:
    payload += b"\0" * (len(payload) % 2)
    return struct.pack(">HBB", len(payload) + 4, kind, form) + payload


def _text(kind: int, s: str) -> bytes:
    return _record(kind, 6, s.encode("latin-1"))


def _num(kind: int, *v: int, size: int = 2) -> bytes:
    return _record(kind, 2 if size == 2 else 3, struct.pack(f">{len(v)}{'h' if size == 2 else 'i'}", *v))


def write(lib: Library) -> bytes:
    stamp = struct.pack(">12h", *[1970, 1, 1, 0, 0, 0] * 2)
    out = [_num(HEADER, 600), _record(BGNLIB, 2, stamp), _text(LIBNAME, lib.name), _record(UNITS, 5, to_real8(lib.user_unit) + to_real8(lib.metre_unit))]
    for cell in lib.structures.values():
        out += [_record(BGNSTR, 2, stamp), _text(STRNAME, cell.name)]
        for e in cell.elements:
            out.append(_record(CODES[e.kind], 0))
            if e.kind in ("sref", "aref"):
                out.append(_text(SNAME, e.sname))
            else:
                out += [_num(LAYER, e.layer), _num({"text": TEXTTYPE, "box": BOXTYPE, "node": NODETYPE}.get(e.kind, DATATYPE), e.datatype)]
            if e.kind == "path":
                out += [_num(PATHTYPE, e.pathtype), _num(WIDTH, e.width, size=4)]
            out += [_record(k, f, p) for k, f, p in e.extra]
            if e.reflect or e.mag != 1.0 or e.angle:
                out.append(_record(STRANS, 1, b"\x80\0" if e.reflect else b"\0\0"))
                out += [_record(MAG, 5, to_real8(e.mag))] if e.mag != 1.0 else []
                out += [_record(ANGLE, 5, to_real8(e.angle))] if e.angle else []
            if e.kind == "aref":
                out.append(_num(COLROW, e.columns, e.rows))
            out.append(_num(XY, *[v for p in e.xy for v in p], size=4))
            if e.kind == "text":
                out.append(_text(STRING, e.text))
            for k, v in e.properties:
                out += [_num(PROPATTR, k), _text(PROPVALUE, v)]
            out.append(_record(ENDEL, 0))
        out.append(_record(ENDSTR, 0))
    return b"".join([*out, _record(ENDLIB, 0)])


Affine = tuple[float, float, float, float, float, float]  # a b c d, and the shift
IDENTITY: Affine = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_TURNS = {0.0: (1.0, 0.0), 90.0: (0.0, 1.0), 180.0: (-1.0, 0.0), 270.0: (0.0, -1.0)}


def instance(e: Element, at: tuple[float, float]) -> Affine:
    import math

    c, s = _TURNS.get(e.angle % 360.0) or (math.cos(math.radians(e.angle)), math.sin(math.radians(e.angle)))
    m = -1.0 if e.reflect else 1.0
    return (e.mag * c, -e.mag * s * m, e.mag * s, e.mag * c * m, at[0], at[1])


def compose(outer: Affine, inner: Affine) -> Affine:
    a, b, c, d, x, y = outer
    e, f, g, h, u, v = inner
    return (a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h, a * u + b * v + x, c * u + d * v + y)


def apply(t: Affine, p: tuple[int, int]) -> tuple[int, int]:
    """The moved point; one that isn't on the grid raises."""
    x, y = t[0] * p[0] + t[1] * p[1] + t[4], t[2] * p[0] + t[3] * p[1] + t[5]
    rx, ry = round(x), round(y)
    if abs(x - rx) > 1e-6 or abs(y - ry) > 1e-6:
        raise ValueError(f"({x}, {y}) is off the grid")
    return rx, ry


def pitch(end: int, origin: int, count: int) -> int:
    if (end - origin) % count:
        raise ValueError("array pitch isn't whole")
    return (end - origin) // count


@dataclass
class Shape:
    cell: str
    layer: int
    datatype: int
    ring: Ring
    path: tuple[str, ...]
    text: str | None = None
    properties: tuple[tuple[int, str], ...] = ()


def tops(lib: Library) -> list[str]:
    used = {e.sname for c in lib.structures.values() for e in c.elements if e.sname}
    return [n for n in lib.structures if n not in used]


def flatten(lib: Library, top: str | None = None, limit: int = 10_000_000) -> Iterator[Shape]:
    """Every polygon and text below ``top`` (or each top), in its coordinates. Cycles, missing cells and more than ``limit`` shapes raise."""
    made = 0

    def walk(name: str, t: Affine, path: tuple[str, ...], root: str) -> Iterator[Shape]:
        nonlocal made
        if name in path:
            raise ValueError("cycle: " + " -> ".join([*path, name]))
        if name not in lib.structures:
            raise ValueError(f"no structure {name}")
        path = (*path, name)
        for e in lib.structures[name].elements:
            if e.kind in ("sref", "aref"):
                for i in range(e.columns if e.kind == "aref" else 1):
                    for j in range(e.rows if e.kind == "aref" else 1):
                        x, y = e.xy[0]
                        if e.kind == "aref":
                            (cx, cy), (rx, ry) = e.xy[1], e.xy[2]
                            x, y = x + i * pitch(cx, e.xy[0][0], e.columns) + j * pitch(rx, e.xy[0][0], e.rows), y + i * pitch(cy, e.xy[0][1], e.columns) + j * pitch(ry, e.xy[0][1], e.rows)
                        yield from walk(e.sname, compose(t, instance(e, (x, y))), path, root)
                continue
            rings = stroke(e.xy, e.width, e.pathtype) if e.kind == "path" else [e.xy if e.kind == "text" or e.xy[0] != e.xy[-1] else e.xy[:-1]]
            if e.kind == "node":
                continue
            for ring in rings:
                made += 1
                if made > limit:
                    raise ValueError(f"more than {limit} shapes")
                yield Shape(root, e.layer, e.datatype, [apply(t, p) for p in ring], path, e.text if e.kind == "text" else None, tuple(e.properties))

    for name in [top] if top else tops(lib):
        yield from walk(name, IDENTITY, (), name)


def unmapped(lib: Library, known: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(layer, datatype, elements)`` that the deck has no layer for, in order."""
    n = Counter((e.layer, e.datatype) for c in lib.structures.values() for e in c.elements if e.kind not in ("sref", "aref"))
    return [(*k, v) for k, v in sorted(n.items()) if k not in known]


def check_units(lib: Library, dbu_nm: float) -> None:
    own = lib.metre_unit * 1e9
    if abs(own - dbu_nm) > max(1e-12, 1e-9 * dbu_nm):
        raise ValueError(f"the layout's unit is {own} nm, the deck's {dbu_nm} nm")

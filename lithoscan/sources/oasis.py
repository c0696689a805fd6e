"""OASIS streams: reading into the library that GDSII streams give, and writing.

Read: names by number and by text, cells, placements, rectangles, polygons,
paths, texts, properties, modal values, both coordinate modes, repetitions and
compressed blocks. Names by number must come before their use; trapezoids,
circles, tables at the end and validation signatures raise or are skipped as
the comments say.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .gds import Element, LayoutError, Library, Structure

# The stream's first bytes, and record numbers.
MAGIC = b"%SEMI-OASIS\r\n"
PAD, START, END = 0, 1, 2
CELLNAME, TEXTSTRING, PROPNAME, PROPSTRING, LAYERNAME = (3, 4), (5, 6), (7, 8), (9, 10), (11, 12)
CELL, XYABSOLUTE, XYRELATIVE, PLACEMENT, TEXT, RECTANGLE, POLYGON, PATH = (13, 14), 15, 16, (17, 18), 19, 20, 21, 22
PROPERTY, CBLOCK = (28, 29), 34
#: Unit steps of 3-deltas, by their low three bits: right, up, left, down, and between them.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (-1, 1), (-1, -1), (1, -1))

Point = tuple[int, int]


class Bytes:
    """A cursor over the stream that knows where it is."""

    def __init__(self, data: bytes, at: int = 0, base: int | None = None):
        self.data, self.at, self.base = data, at, base

    def fail(self, what: str) -> LayoutError:
        return LayoutError(what, self.at if self.base is None else self.base)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise self.fail("stream ends within a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def unsigned(self) -> int:
        value = shift = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7
            if shift > 63:
                raise self.fail("number of more than 64 bits")

    def signed(self) -> int:
        v = self.unsigned()
        return -(v >> 1) if v & 1 else v >> 1

    def real(self) -> float:
        kind = self.unsigned()
        if kind in (0, 1):
            return float(self.unsigned() * (-1 if kind else 1))
        if kind in (2, 3):
            return (-1 if kind == 3 else 1) / self.unsigned()
        if kind in (4, 5):
            return (-1 if kind == 5 else 1) * self.unsigned() / self.unsigned()
        if kind in (6, 7):
            return struct.unpack("<f" if kind == 6 else "<d", self.take(4 if kind == 6 else 8))[0]
        raise self.fail(f"real of kind {kind}")

    def string(self) -> str:
        return self.take(self.unsigned()).decode("latin-1")

    def delta(self) -> Point:
        """A g-delta: either a distance in one of eight directions or two numbers."""
        v = self.unsigned()
        if v & 1 == 0:
            dx, dy = STEPS[v >> 1 & 7]
            return dx * (v >> 4), dy * (v >> 4)
        x = -(v >> 2) if v & 2 else v >> 2
        return x, self.signed()

    def points(self, polygon: bool) -> list[Point]:
        """A point list as steps from the first point, which isn't in it; closing steps of polygons are left out."""
        kind, n = self.unsigned(), self.unsigned()
        out: list[Point] = []
        if kind in (0, 1):
            for k in range(n):
                d = self.signed()
                out.append((d, 0) if (k % 2 == 0) == (kind == 0) else (0, d))
            if polygon:  # the last corner lies on the first point's line
                x, y = sum(p[0] for p in out), sum(p[1] for p in out)
                last_flat = bool(out) and out[-1][1] == 0 and (n - 1) % 2 == (0 if kind == 0 else 1)
                out.append((0, -y) if last_flat else (-x, 0))
        elif kind in (2, 3):
            for _ in range(n):
                v = self.unsigned()
                bits = 2 if kind == 2 else 3
                dx, dy = STEPS[v & (1 << bits) - 1]
                out.append((dx * (v >> bits), dy * (v >> bits)))
        elif kind in (4, 5):
            step = (0, 0)
            for _ in range(n):
                d = self.delta()
                step = (step[0] + d[0], step[1] + d[1]) if kind == 5 else d
                out.append(step)
        else:
            raise self.fail(f"point list of kind {kind}")
        return out

    def repetition(self, last: list[Point] | None) -> list[Point]:
        """Shifts of all copies, the first one's (0, 0) included."""
        kind = self.unsigned()
        if kind == 0:
            if last is None:
                raise self.fail("no repetition to use again")
            return last
        u = self.unsigned
        if kind == 1:
            nx, ny, dx, dy = u() + 2, u() + 2, u(), u()
            return [(i * dx, j * dy) for j in range(ny) for i in range(nx)]
        if kind in (2, 3):
            n, d = u() + 2, u()
            return [(i * d, 0) if kind == 2 else (0, i * d) for i in range(n)]
        if kind in (4, 5, 6, 7):
            n, grid = u() + 2, 1
            if kind in (5, 7):
                grid = u()
            out, at = [(0, 0)], 0
            for _ in range(n - 1):
                at += u() * grid
                out.append((at, 0) if kind in (4, 5) else (0, at))
            return out
        if kind == 8:
            n, m = u() + 2, u() + 2
            (ax, ay), (bx, by) = self.delta(), self.delta()
            return [(i * ax + j * bx, i * ay + j * by) for j in range(m) for i in range(n)]
        if kind == 9:
            n = u() + 2
            ax, ay = self.delta()
            return [(i * ax, i * ay) for i in range(n)]
        if kind in (10, 11):
            n = u() + 2
            grid = u() if kind == 11 else 1
            out, x, y = [(0, 0)], 0, 0
            for _ in range(n - 1):
                dx, dy = self.delta()
                x, y = x + dx * grid, y + dy * grid
                out.append((x, y))
            return out
        raise self.fail(f"repetition of kind {kind}")


@dataclass
class Modal:
    """Values that a record takes from the one before it."""

    values: dict[str, object] = field(default_factory=dict)
    x: dict[str, int] = field(default_factory=lambda: {"geometry": 0, "placement": 0, "text": 0})
    y: dict[str, int] = field(default_factory=lambda: {"geometry": 0, "placement": 0, "text": 0})
    relative: bool = False


def is_oasis(data: bytes) -> bool:
    return data[: len(MAGIC)] == MAGIC


def read(data: bytes) -> Library:
    """The library of a stream; what it doesn't know raises with the byte it is at."""
    if not is_oasis(data):
        raise LayoutError("not an OASIS stream", 0)
    lib = Library("")
    names: dict[str, dict[int, str]] = {"cell": {}, "text": {}}
    state: dict[str, object] = {"cell": None, "modal": Modal(), "done": False, "last": []}

    def run(b: Bytes) -> None:
        while b.at < len(b.data) and not state["done"]:
            record(b)

    def name(b: Bytes, kind: str, records: tuple[int, int], number: int) -> None:
        text = b.string()
        own = names[kind] if kind in names else {}
        at = len(own) if number == records[0] else b.unsigned()
        if at in own:
            raise b.fail(f"second name {at}")
        own[at] = text

    def modal(key: str, b: Bytes, given: bool, of: Callable[[], object]) -> object:
        m: Modal = state["modal"]  # type: ignore[assignment]
        if given:
            m.values[key] = of()
        if key not in m.values:
            raise b.fail(f"no {key} to use again")
        return m.values[key]

    def place(b: Bytes, kind: str, has_x: bool, has_y: bool) -> Point:
        m: Modal = state["modal"]  # type: ignore[assignment]
        for given, at in ((has_x, m.x), (has_y, m.y)):
            if given:
                v = b.signed()
                at[kind] = at[kind] + v if m.relative else v
        return m.x[kind], m.y[kind]

    def add(b: Bytes, e: Element, repeated: bool) -> None:
        cell: Structure | None = state["cell"]  # type: ignore[assignment]
        if cell is None:
            raise b.fail("element outside a cell")
        shifts = modal("repetition", b, True, lambda: b.repetition(state["modal"].values.get("repetition"))) if repeated else [(0, 0)]  # type: ignore[union-attr]
        made = []
        for dx, dy in shifts:  # type: ignore[union-attr]
            made.append(Element(e.kind, e.layer, e.datatype, [(x + dx, y + dy) for x, y in e.xy], e.text, e.sname, e.width, e.pathtype, e.reflect, e.mag, e.angle))
        cell.elements += made
        state["last"] = made

    def record(b: Bytes) -> None:
        kind = b.unsigned()
        m: Modal = state["modal"]  # type: ignore[assignment]
        if kind == PAD:
            return
        if kind == START:
            version, unit, at_end = b.string(), b.real(), b.unsigned()
            if version != "1.0":
                raise b.fail(f"version {version}")
            lib.user_unit, lib.metre_unit = 1 / unit, 1e-6 / unit  # unit: grid steps a micrometre
            if not at_end:
                for _ in range(12):
                    b.unsigned()
        elif kind == END:
            state["done"] = True  # tables and signatures behind it aren't read
        elif kind in CELLNAME:
            name(b, "cell", CELLNAME, kind)
        elif kind in TEXTSTRING:
            name(b, "text", TEXTSTRING, kind)
        elif kind in (*PROPNAME, *PROPSTRING):
            b.string()
            if kind in (PROPNAME[1], PROPSTRING[1]):
                b.unsigned()
        elif kind in LAYERNAME:
            b.string()
            for _ in range(2):
                how = b.unsigned()
                for _ in range((0, 1, 1, 1, 2)[how] if how < 5 else 0):
                    b.unsigned()
        elif kind in CELL:
            own = b.string() if kind == CELL[1] else number(b, "cell")
            if own in lib.structures:
                raise b.fail(f"second cell {own}")
            state["cell"], state["modal"] = Structure(own), Modal()
            lib.structures[own] = state["cell"]  # type: ignore[assignment]
        elif kind in (XYABSOLUTE, XYRELATIVE):
            m.relative = kind == XYRELATIVE
        elif kind in PLACEMENT:
            i = b.byte()
            cell_name = modal("placed cell", b, bool(i & 0x80), lambda: number(b, "cell") if i & 0x40 else b.string())
            mag, angle = 1.0, 90.0 * (i >> 1 & 3)
            if kind == PLACEMENT[1]:
                mag = b.real() if i & 4 else 1.0
                angle = b.real() if i & 2 else 0.0
            at = place(b, "placement", bool(i & 0x20), bool(i & 0x10))
            add(b, Element("sref", xy=[at], sname=str(cell_name), reflect=bool(i & 1), mag=mag, angle=angle), bool(i & 8))
        elif kind == TEXT:
            i = b.byte()
            text = modal("text", b, bool(i & 0x40), lambda: number(b, "text") if i & 0x20 else b.string())
            layer = modal("text layer", b, bool(i & 1), b.unsigned)
            datatype = modal("text type", b, bool(i & 2), b.unsigned)
            at = place(b, "text", bool(i & 0x10), bool(i & 8))
            add(b, Element("text", int(layer), int(datatype), [at], text=str(text)), bool(i & 4))  # type: ignore[arg-type]
        elif kind in (RECTANGLE, POLYGON, PATH):
            shape(b, kind)
        elif kind in PROPERTY:
            prop(b, kind)
        elif kind == CBLOCK:
            at = b.at
            if b.unsigned() != 0:
                raise b.fail("unknown compression")
            size, packed = b.unsigned(), b.unsigned()
            plain = zlib.decompress(b.take(packed), -15)
            if len(plain) != size:
                raise b.fail("compressed block of another size")
            run(Bytes(plain, 0, at))
        else:
            raise b.fail(f"record {kind} isn't supported")

    def number(b: Bytes, kind: str) -> str:
        at = b.unsigned()
        if at not in names[kind]:
            raise b.fail(f"no {kind} name {at} before its use")
        return names[kind][at]

    def shape(b: Bytes, kind: int) -> None:
        i = b.byte()
        layer = int(modal("layer", b, bool(i & 1), b.unsigned))  # type: ignore[call-overload]
        datatype = int(modal("datatype", b, bool(i & 2), b.unsigned))  # type: ignore[call-overload]
        if kind == RECTANGLE:
            w = int(modal("width", b, bool(i & 0x40), b.unsigned))  # type: ignore[call-overload]
            if i & 0x80:  # a square
                h = state["modal"].values["height"] = w  # type: ignore[union-attr]
            else:
                h = int(modal("height", b, bool(i & 0x20), b.unsigned))  # type: ignore[call-overload]
            x, y = place(b, "geometry", bool(i & 0x10), bool(i & 8))
            add(b, Element("boundary", layer, datatype, [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]), bool(i & 4))
            return
        if kind == POLYGON:
            steps = modal("polygon", b, bool(i & 0x20), lambda: b.points(True))
            x, y = place(b, "geometry", bool(i & 0x10), bool(i & 8))
            ring = walk((x, y), steps)  # type: ignore[arg-type]
            add(b, Element("boundary", layer, datatype, [*ring, ring[0]]), bool(i & 4))
            return
        half = int(modal("half width", b, bool(i & 0x40), b.unsigned))  # type: ignore[call-overload]
        ends = modal("path ends", b, bool(i & 0x80), lambda: path_ends(b, half))
        steps = modal("path", b, bool(i & 0x20), lambda: b.points(False))
        x, y = place(b, "geometry", bool(i & 0x10), bool(i & 8))
        first, last = ends  # type: ignore[misc]
        if first != last or first not in (0, half):
            raise b.fail("path ends that differ")
        add(b, Element("path", layer, datatype, walk((x, y), steps), width=2 * half, pathtype=2 if first and half else 0), bool(i & 4))  # type: ignore[arg-type]

    def path_ends(b: Bytes, half: int) -> Point:
        how = b.unsigned()
        pick = lambda k: (None, lambda: 0, lambda: half, b.signed)[k]
        was = state["modal"].values.get("path ends", (0, 0))  # type: ignore[union-attr]
        return tuple(pick(k)() if pick(k) else was[j] for j, k in enumerate((how >> 2 & 3, how & 3)))  # type: ignore[misc, index]

    def prop(b: Bytes, kind: int) -> None:
        if kind == PROPERTY[1]:  # the last property once more
            key, values = state["modal"].values.get("property", ("", []))  # type: ignore[union-attr]
        else:
            i = b.byte()
            key = ""
            if i & 4:
                key = f"#{b.unsigned()}" if i & 2 else b.string()
            values = []
            if not i & 8:
                n = i >> 4
                for _ in range(b.unsigned() if n == 15 else n):
                    values.append(value(b))
            state["modal"].values["property"] = (key, values)  # type: ignore[union-attr]
        for e in state["last"]:  # type: ignore[union-attr]
            e.properties += [(len(e.properties) + 1, f"{key}={v}") for v in values]

    def value(b: Bytes) -> str:
        how = b.unsigned()
        if how < 8:
            b.at -= 1
            return repr(b.real())
        if how in (8, 9):
            return str(b.unsigned() if how == 8 else b.signed())
        if how in (10, 11, 12):
            return b.string()
        return f"#{b.unsigned()}"

    run(Bytes(data, len(MAGIC)))
    if not state["done"]:
        raise LayoutError("no end of stream", len(data))
    return lib


def walk(first: Point, steps: list[Point]) -> list[Point]:
    out = [first]
    for dx, dy in steps:
        out.append((out[-1][0] + dx, out[-1][1] + dy))
    return out


def _unsigned(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    return bytes([*out, v])


def _signed(v: int) -> bytes:
    return _unsigned(abs(v) << 1 | (v < 0))


def _string(s: str) -> bytes:
    raw = s.encode("latin-1")
    return _unsigned(len(raw)) + raw


def _steps(ring: list[Point], closed: bool) -> bytes:
    """All steps as g-deltas of two numbers."""
    out = bytearray(_unsigned(4) + _unsigned(len(ring) - 1))
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        dx, dy = bx - ax, by - ay
        out += _unsigned(abs(dx) << 2 | (2 if dx < 0 else 0) | 1) + _signed(dy)
    return bytes(out)


def _element(e: Element) -> Iterator[bytes]:
    if e.kind in ("boundary", "box"):
        ring = e.xy[:-1] if e.xy[0] == e.xy[-1] else e.xy
        xs, ys = {p[0] for p in ring}, {p[1] for p in ring}
        straight = all(a[0] == b[0] or a[1] == b[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
        if len(ring) == 4 and len(xs) == len(ys) == 2 and straight:
            yield _unsigned(RECTANGLE) + bytes([0x7B]) + _unsigned(e.layer) + _unsigned(e.datatype) + _unsigned(max(xs) - min(xs)) + _unsigned(max(ys) - min(ys)) + _signed(min(xs)) + _signed(min(ys))
        else:
            yield _unsigned(POLYGON) + bytes([0x3B]) + _unsigned(e.layer) + _unsigned(e.datatype) + _steps(ring, True) + _signed(ring[0][0]) + _signed(ring[0][1])
    elif e.kind == "path":
        if e.width % 2 or e.pathtype not in (0, 2):
            raise ValueError("only paths of even width with flat or half-width ends can be written")
        ends = 0b1010 if e.pathtype == 2 else 0b0101
        yield _unsigned(PATH) + bytes([0xFB]) + _unsigned(e.layer) + _unsigned(e.datatype) + _unsigned(e.width // 2) + _unsigned(ends) + _steps(e.xy, False) + _signed(e.xy[0][0]) + _signed(e.xy[0][1])
    elif e.kind == "text":
        yield _unsigned(TEXT) + bytes([0x5B]) + _string(e.text) + _unsigned(e.layer) + _unsigned(e.datatype) + _signed(e.xy[0][0]) + _signed(e.xy[0][1])
    elif e.kind in ("sref", "aref"):
        from .gds import pitch

        (x, y), shifts = e.xy[0], [(0, 0)]
        if e.kind == "aref":
            (cx, cy), (rx, ry) = e.xy[1], e.xy[2]
            col, row = (pitch(cx, x, e.columns), pitch(cy, y, e.columns)), (pitch(rx, x, e.rows), pitch(ry, y, e.rows))
            shifts = [(i * col[0] + j * row[0], i * col[1] + j * row[1]) for j in range(e.rows) for i in range(e.columns)]
        plain = e.mag == 1.0 and e.angle % 90 == 0
        for dx, dy in shifts:
            flags = 0xB0 | (1 if e.reflect else 0)
            if plain:
                yield _unsigned(PLACEMENT[0]) + bytes([flags | int(e.angle % 360 // 90) << 1]) + _string(e.sname) + _signed(x + dx) + _signed(y + dy)
            else:
                real = lambda v: _unsigned(7) + struct.pack("<d", v)
                yield _unsigned(PLACEMENT[1]) + bytes([flags | 6]) + _string(e.sname) + real(e.mag) + real(e.angle) + _signed(x + dx) + _signed(y + dy)
    else:
        raise ValueError(f"a {e.kind} can't be written")


def write(lib: Library, compress: bool = False) -> bytes:
    """The library as a stream; ``compress`` packs each cell's elements into a block."""
    out = bytearray(MAGIC + _unsigned(START) + _string("1.0") + _unsigned(7) + struct.pack("<d", 1e-6 / lib.metre_unit) + _unsigned(0) + bytes(12))
    for cell in lib.structures.values():
        out += _unsigned(CELL[1]) + _string(cell.name)
        body = b"".join(x for e in cell.elements for x in _element(e))
        if compress and body:
            packer = zlib.compressobj(wbits=-15)
            packed = packer.compress(body) + packer.flush()
            body = _unsigned(CBLOCK) + _unsigned(0) + _unsigned(len(body)) + _unsigned(len(packed)) + packed
        out += body
    end = _unsigned(END)
    return bytes(out + end + bytes(256 - len(end) - 1) + _unsigned(0))

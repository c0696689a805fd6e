"""Hierarchical layouts as tables: cells' own shapes and placements, expanded by joins, whole or within a window.

``shapes(file, cell, layer, datatype, ring, text)`` and ``places(file, cell,
child, a, b, c, d, x, y)``: a placement moves a point to (a x + b y + x, c x +
d y + y). A layout of any size is rows of two tables; only the hierarchy's depth
is a loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import stroke
from ..plans.stage import staged
from . import gds, oasis
from .layout import RING

SHAPES = "file string, cell string, layer int, datatype int, ring array<struct<x:int,y:int>>, text string"
PLACES = "file string, cell string, child string, a double, b double, c double, d double, x double, y double"
MATRIX = ["a", "b", "c", "d", "x", "y"]
BOX = ["x0", "y0", "x1", "y1"]


def library(data: bytes, strict: bool = True) -> gds.Library:
    """A file's library, whichever of both formats it has."""
    return oasis.read(data) if oasis.is_oasis(data) else gds.read(data, strict)


def tables(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(shapes, places)`` of the layout files at a path: each cell once, arrays of cells as one placement each."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for cell in library(data, strict).structures.values():
                    rows = []
                    for e in cell.elements:
                        if e.kind in ("sref", "aref", "node"):
                            continue
                        rings = stroke(e.xy, e.width, e.pathtype) if e.kind == "path" else [e.xy if e.kind == "text" or e.xy[0] != e.xy[-1] else e.xy[:-1]]
                        rows += [(e.layer, e.datatype, [{"x": x, "y": y} for x, y in ring], e.text if e.kind == "text" else None) for ring in rings]
                    for at in range(0, len(rows), 10_000):
                        part = rows[at : at + 10_000]
                        cols = list(zip(*part, strict=True))
                        kinds = [pa.int32(), pa.int32(), RING, pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([cell.name] * len(part)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["file", "cell", "layer", "datatype", "ring", "text"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for cell in library(data, strict).structures.values():
                    for e in cell.elements:
                        if e.kind not in ("sref", "aref"):
                            continue
                        shifts = [e.xy[0]]
                        if e.kind == "aref":
                            (x, y), (cx, cy), (rx, ry) = e.xy[:3]
                            col = (gds.pitch(cx, x, e.columns), gds.pitch(cy, y, e.columns))
                            row = (gds.pitch(rx, x, e.rows), gds.pitch(ry, y, e.rows))
                            shifts = [(x + i * col[0] + j * row[0], y + i * col[1] + j * row[1]) for i in range(e.columns) for j in range(e.rows)]
                        for at in shifts:
                            rows.append((name, cell.name, e.sname, *gds.instance(e, at)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 3 + [pa.float64()] * 6, strict=True)], names=[f.split()[0] for f in PLACES.split(", ")])

    return files.mapInArrow(shapes, SHAPES), files.mapInArrow(places, PLACES)


def _moved(x: Column, y: Column) -> tuple[Column, Column]:
    return F.col("a") * x + F.col("b") * y + F.col("x"), F.col("c") * x + F.col("d") * y + F.col("y")


def cell_boxes(shapes: DataFrame, places: DataFrame, max_depth: int = 1024) -> DataFrame:
    """``file, cell, x0, y0, x1, y1``: the box of all that a cell holds, at any depth; empty cells have none. A cycle raises. Eager."""
    xs, ys = F.transform("ring", lambda p: p["x"].cast("double")), F.transform("ring", lambda p: p["y"].cast("double"))
    own = shapes.select("file", "cell", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    span = lambda t: t.groupBy("file", "cell").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    now = staged(span(own), "cell-boxes")
    for _ in range(max_depth):
        child = now.select(F.col("file").alias("f"), F.col("cell").alias("k"), *[F.col(c).alias(f"b{c}") for c in BOX])
        on = places.join(child, (F.col("file") == F.col("f")) & (F.col("child") == F.col("k")))
        corners = [_moved(F.col(f"b{x}"), F.col(f"b{y}")) for x in ("x0", "x1") for y in ("y0", "y1")]
        up = on.select("file", "cell", F.least(*[p[0] for p in corners]).alias("x0"), F.least(*[p[1] for p in corners]).alias("y0"), F.greatest(*[p[0] for p in corners]).alias("x1"), F.greatest(*[p[1] for p in corners]).alias("y1"))
        new = staged(span(now.union(up)), "cell-boxes")
        if not new.exceptAll(now).head(1):
            return new
        now = new
    raise ValueError(f"cells nest deeper than {max_depth}, or in a cycle")


def expand(shapes: DataFrame, places: DataFrame, top: str | None = None, window: tuple[int, int, int, int] | None = None, max_depth: int = 256) -> DataFrame:
    """``file, top, cell, layer, datatype, ring, text, depth``: every shape below ``top`` (or each cell that nothing places), in its coordinates.

    Placements go down level by level, a join and a matrix product each. With
    ``window``, only what meets it is expanded: a placement whose cell's box
    stays outside is dropped at once, and shapes are held against it at the end.
    Points off the grid, missing cells and cycles raise. Eager up to the placements.
    """
    if top is None:
        used = places.select(F.col("file").alias("f"), F.col("child").alias("k")).distinct()
        names = shapes.select("file", "cell").union(places.select("file", "cell")).distinct()
        roots = names.join(used, (F.col("file") == F.col("f")) & (F.col("cell") == F.col("k")), "left_anti")
    else:
        roots = shapes.select("file").union(places.select("file")).distinct().withColumn("cell", F.lit(top))
    one = {c: F.lit(1.0 if c in "ad" else 0.0) for c in MATRIX}
    level = staged(roots.select("file", F.col("cell").alias("top"), "cell", *[v.alias(c) for c, v in one.items()], F.lit(0).alias("depth")), "placed")
    boxes = cell_boxes(shapes, places) if window is not None else None
    known = staged(shapes.select("file", "cell").union(places.select("file", "cell")).distinct(), "cells")
    lost = places.join(known.select(F.col("file").alias("f"), F.col("cell").alias("k")), (F.col("file") == F.col("f")) & (F.col("child") == F.col("k")), "left_anti").head(1)
    if lost:
        raise ValueError(f"no cell {lost[0]['child']}")
    all_ = level
    for depth in range(1, max_depth + 1):
        inner = places.select(F.col("file").alias("f"), F.col("cell").alias("k"), "child", *[F.col(c).alias(f"i{c}") for c in MATRIX])
        on = level.join(inner, (F.col("file") == F.col("f")) & (F.col("cell") == F.col("k")))
        x, y = _moved(F.col("ix"), F.col("iy"))
        product = [
            (F.col("a") * F.col("ia") + F.col("b") * F.col("ic")).alias("a"), (F.col("a") * F.col("ib") + F.col("b") * F.col("id")).alias("b"),
            (F.col("c") * F.col("ia") + F.col("d") * F.col("ic")).alias("c"), (F.col("c") * F.col("ib") + F.col("d") * F.col("id")).alias("d"), x.alias("x"), y.alias("y"),
        ]
        down = on.select("file", "top", F.col("child").alias("cell"), *product, F.lit(depth).alias("depth"))
        if boxes is not None:
            own = boxes.select(F.col("file").alias("f"), F.col("cell").alias("k"), *[F.col(c).alias(f"b{c}") for c in BOX])
            down = down.join(own, (F.col("file") == F.col("f")) & (F.col("cell") == F.col("k")))
            corners = [_moved(F.col(f"b{p}"), F.col(f"b{q}")) for p in ("x0", "x1") for q in ("y0", "y1")]
            px, py = [p[0] for p in corners], [p[1] for p in corners]
            down = down.where((F.least(*px) <= window[2]) & (F.greatest(*px) >= window[0]) & (F.least(*py) <= window[3]) & (F.greatest(*py) >= window[1])).select(*level.columns)
        level = staged(down, "placed")
        if not level.head(1):
            break
        all_ = all_.union(level)
    else:
        raise ValueError(f"cells nest deeper than {max_depth}, or in a cycle")
    on = all_.join(shapes.withColumnsRenamed({"file": "f", "cell": "k"}), (F.col("file") == F.col("f")) & (F.col("cell") == F.col("k")))

    def whole(v: Column) -> Column:
        near = F.rint(v)
        return F.when(F.abs(v - near) <= 1e-6, near.cast("int")).otherwise(F.raise_error(F.concat(F.lit("off the grid: "), v.cast("string"))).cast("int"))

    ring = F.transform("ring", lambda p: F.struct(whole(F.col("a") * p["x"] + F.col("b") * p["y"] + F.col("x")).alias("x"), whole(F.col("c") * p["x"] + F.col("d") * p["y"] + F.col("y")).alias("y")))
    out = on.select("file", "top", "cell", "layer", "datatype", ring.alias("ring"), "text", "depth")
    if window is not None:
        low, high = (lambda c: F.array_min(F.transform("ring", lambda p: p[c]))), (lambda c: F.array_max(F.transform("ring", lambda p: p[c])))
        out = out.where((low("x") <= window[2]) & (high("x") >= window[0]) & (low("y") <= window[3]) & (high("y") >= window[1]))
    return out


def unmapped(shapes: DataFrame, known: DataFrame) -> DataFrame:
    """``layer, datatype, elements`` that ``known(layer, datatype)`` lacks."""
    k = known.select(F.col("layer").alias("kl"), F.col("datatype").alias("kd")).distinct()
    return shapes.groupBy("layer", "datatype").agg(F.count(F.lit(1)).alias("elements")).join(k, (F.col("layer") == F.col("kl")) & (F.col("datatype") == F.col("kd")), "left_anti")


# --- tiles ------------------------------------------------------------------------------


def tile_grid(boxes: DataFrame, size: int, most: int = 10_000_000) -> DataFrame:
    """``tx, ty, x0, y0, x1, y1``: square tiles from the boxes' lower-left corner that cover them all. Eager; more than ``most`` raise."""
    r = boxes.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    spark = boxes.sparkSession
    if r["x0"] is None:
        return spark.createDataFrame([], "tx long, ty long, x0 long, y0 long, x1 long, y1 long")
    nx, ny = max(-(-(r["x1"] - r["x0"]) // size), 1), max(-(-(r["y1"] - r["y0"]) // size), 1)
    if nx * ny > most:
        raise ValueError(f"{nx * ny} tiles of more than {most}")
    t = spark.range(nx * ny).select((F.col("id") % nx).alias("tx"), F.expr(f"id div {nx}").alias("ty"))
    x, y = F.lit(r["x0"]) + F.col("tx") * size, F.lit(r["y0"]) + F.col("ty") * size
    return t.select("tx", "ty", x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"))


def halo(reaches: list[int]) -> int:
    """How far beyond its border a tile must see: the farthest reach of its rules, in database units."""
    return max(reaches, default=0)


def in_tiles(boxes: DataFrame, size: int, halo_: int, origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """``boxes`` with ``tx, ty``, once for each tile whose border, moved out by the halo, they meet, and ``owned``: whether their lower-left corner is the tile's."""
    at = lambda c, o, d: F.floor((F.col(c) - o + d) / size).cast("long")
    t = boxes.withColumn("tx", F.explode(F.sequence(at("x0", origin[0], -halo_), at("x1", origin[0], halo_)))).withColumn("ty", F.explode(F.sequence(at("y0", origin[1], -halo_), at("y1", origin[1], halo_))))
    return t.withColumn("owned", (F.col("tx") == at("x0", origin[0], 0)) & (F.col("ty") == at("y0", origin[1], 0)))


def tile_hashes(tiled: DataFrame, columns: list[str]) -> DataFrame:
    """``tx, ty, n, hash``: what a tile holds, whatever its order: the number of rows and the sum of their hashes."""
    return tiled.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("hash"))

"""Layout files as tables, of either format: one task per file, any path that Spark reads.

Large hierarchical files go by :mod:`lithoscan.sources.hierarchy`, which
expands placements by joins instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import decompose, validity
from . import gds, oasis

RING = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
SCHEMA = "file string, cell string, layer int, datatype int, ring array<struct<x:int,y:int>>, text string, path array<string>"


def detect(data: bytes) -> str:
    """``oasis`` by the stream's first bytes, else ``gds``."""
    return "oasis" if oasis.is_oasis(data) else "gds"


def write_layout(polygons: DataFrame, path: str, dbu_nm: float = 1.0, form: str = "gds") -> None:
    """Write ``polygons(cell, layer, datatype, ring)`` as one file a partition, each cell whole within one; Spark's writer commits them, as rows of bytes.

    The files hold the column ``content`` (Parquet) beside the cell's name, as no
    Spark writer makes raw binary files; :func:`contents` gives a file's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, gds.Structure] = {}
        for b in batches:
            for cell, layer, datatype, ring in zip(*(c.to_pylist() for c in b.columns), strict=True):
                points = [(p["x"], p["y"]) for p in ring]
                cells.setdefault(cell, gds.Structure(cell)).elements.append(gds.Element("boundary", layer, datatype, [*points, points[0]]))
        for name, cell in sorted(cells.items()):
            lib = gds.Library(name, dbu_nm * 1e-3, dbu_nm * 1e-9, {name: cell})
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([oasis.write(lib) if form == "oasis" else gds.write(lib)])], names=["cell", "content"])

    rows = polygons.select("cell", F.col("layer").cast("int"), F.col("datatype").cast("int"), "ring").repartition("cell").sortWithinPartitions("cell")
    rows.mapInArrow(run, "cell string, content binary").write.mode("overwrite").parquet(path)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """``cell, content`` of what :func:`write_layout` wrote."""
    return spark.read.parquet(path).select("cell", "content")


def read_layout(spark: SparkSession, path: str, top: str | None = None, strict: bool = True, dbu_nm: float | None = None) -> DataFrame:
    """Polygons and texts of GDSII and OASIS files: ``file, cell, layer, datatype, ring, text, path``; a fault of a file fails the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lib = oasis.read(data) if detect(data) == "oasis" else gds.read(data, strict)
                if dbu_nm is not None:
                    gds.check_units(lib, dbu_nm)
                part: list[gds.Shape] = []
                for shape in gds.flatten(lib, top):
                    part.append(shape)
                    if len(part) == 10_000:
                        yield _batch(name, part)
                        part = []
                if part:
                    yield _batch(name, part)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def _batch(name: str, part: list[gds.Shape]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(part)), pa.array([s.cell for s in part]), pa.array([s.layer for s in part], pa.int32()), pa.array([s.datatype for s in part], pa.int32()),
            pa.array([[{"x": x, "y": y} for x, y in s.ring] for s in part], RING), pa.array([s.text for s in part], pa.string()), pa.array([list(s.path) for s in part], pa.list_(pa.string())),
        ],
        names=["file", "cell", "layer", "datatype", "ring", "text", "path"],
    )


def polygon_rects(polygons: DataFrame) -> DataFrame:
    """``id, ri, layer, x0, y0, x1, y1``: disjoint boxes of ``polygons(id, layer, ring)``; a ring that isn't rectilinear fails the read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, layer, ring in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(i, k, layer, *box) for k, box in enumerate(decompose([(p["x"], p["y"]) for p in ring]))]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "ri", "layer", "x0", "y0", "x1", "y1"])

    return polygons.select(F.col("id").cast("long"), F.col("layer").cast("int"), "ring").mapInArrow(run, "id long, ri int, layer int, x0 long, y0 long, x1 long, y1 long")


def polygon_validity(polygons: DataFrame) -> DataFrame:
    """``id, kind, measured`` of polygons with no area or that cross themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, validity([(p["x"], p["y"]) for p in ring])) for i, ring in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            bad = [(i, *v) for i, v in found if v]
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*bad, strict=True)], names=["id", "kind", "measured"])

    return polygons.select(F.col("id").cast("long"), "ring").mapInArrow(run, "id long, kind string, measured long")

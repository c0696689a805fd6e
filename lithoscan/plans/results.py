"""Results as tables: fingerprints, waivers, tile merges and what a change invalidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import closure
from ..operators.spatial import candidates

FIELDS = ["rule_id", "kind", "layer", "measured", "limit", "x", "y"]


def fingerprint(fields: list[str] = FIELDS) -> Column:
    """SHA-256 over the fields' canonical text; nulls differ from empty text."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(f).cast("string"), F.lit("\u0000")) for f in fields]), 256)


def insert(known: DataFrame, new: DataFrame) -> DataFrame:
    """``known(fingerprint, ...)`` and the rows of ``new`` whose fingerprint it lacks, each once."""
    found = new.withColumn("fingerprint", fingerprint()).dropDuplicates(["fingerprint"])
    return known.unionByName(found.join(known.select("fingerprint"), "fingerprint", "left_anti").select(*known.columns))


def apply_waivers(found: DataFrame, waivers: DataFrame, today: str) -> DataFrame:
    """``found(fingerprint, ...)`` with ``status``: Waived by a row of ``waivers(fingerprint, expires_on)``, Expired if all of its waivers ended before ``today``, else Open."""
    last = waivers.groupBy("fingerprint").agg(F.max(F.coalesce(F.col("expires_on").cast("date"), F.lit("9999-12-31").cast("date"))).alias("until"))
    status = F.when(F.col("until").isNull(), "Open").when(F.col("until") < F.lit(today).cast("date"), "Expired").otherwise("Waived")
    return found.join(last, "fingerprint", "left").withColumn("status", status).drop("until")


def unmatched_waivers(found: DataFrame, waivers: DataFrame) -> DataFrame:
    return waivers.join(found.select("fingerprint").distinct(), "fingerprint", "left_anti")


def merge_tiles(tiles: DataFrame) -> DataFrame:
    """One row per fingerprint of ``tiles(tile, ...)``: the lowest tile's."""
    return tiles.withColumn("fingerprint", fingerprint()).groupBy("fingerprint").agg(F.min("tile").alias("tile"), *[F.first(c).alias(c) for c in FIELDS])


def verify_complete(tiles: DataFrame, done: DataFrame) -> DataFrame:
    """Tiles without a record of having been run."""
    return tiles.select("tile").distinct().join(done.select("tile").distinct(), "tile", "left_anti")


def invalidated(changes: DataFrame, rules: DataFrame, depends: DataFrame) -> DataFrame:
    """``(item)``: rules that a change touches, and all that depend on them.

    ``changes(layer, path, x0..y1)`` and ``rules(rule, layer, prefix, x0..y1)``:
    a rule is touched if the layer is the same, the boxes meet and the path
    begins with the prefix. ``depends(src, dst)``: dst reads src's result.
    """
    box = ["x0", "y0", "x1", "y1"]
    pairs = candidates(rules.select("rule", "layer", "prefix", *box), changes.select("layer", "path", *box).distinct(), 0, ("layer",))
    hit = pairs.where(F.col("b_path").startswith(F.col("a_prefix"))).withColumnRenamed("a_rule", "rule")
    return closure(hit.select(F.col("rule").alias("item")), depends)


def canonical_json(found: DataFrame) -> DataFrame:
    """The report's rows in order, one JSON text each."""
    return found.orderBy("rule_id", "kind", "layer", "measured", "x", "y").select(F.to_json(F.struct(*FIELDS)).alias("json"))

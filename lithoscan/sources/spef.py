"""Parasitics as text: SPEF (IEEE 1481) and DSPF, a block for each net made by expressions and written in order of nets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.pex import pi_model


def _number(c: Column) -> Column:
    return F.format_string("%.6g", c.cast("double"))


def _named(per_net: DataFrame, names: DataFrame | None) -> DataFrame:
    """The pi model of each net in fF and ohm, with its name from ``names(net, name)``, else ``net_<number>``."""
    d = pi_model(per_net).withColumns({"near": F.col("c_near") / 1000, "far": F.col("c_far") / 1000})
    plain = F.concat(F.lit("net_"), F.col("net").cast("string"))
    if names is None:
        return d.withColumn("name", plain)
    given = names.select(F.col("net").alias("given_net"), F.col("name").alias("given"))
    return d.join(given, F.col("net") == F.col("given_net"), "left").withColumn("name", F.coalesce("given", plain))


def spef(per_net: DataFrame, cell: str, names: DataFrame | None = None) -> DataFrame:
    """``(net, block)``: a D_NET of a pi model for each row of ``by_net``; the header's net is null.

    ``names`` has a row a net at most. An empty table gives the header alone.
    """
    head = "\n".join(
        ['*SPEF "IEEE 1481-1998"', f'*DESIGN "{cell}"', "*DIVIDER /", "*DELIMITER :", "*BUS_DELIMITER [ ]", "*T_UNIT 1 NS", "*C_UNIT 1 FF", "*R_UNIT 1 OHM", "*L_UNIT 1 HENRY", ""]
    )
    d = _named(per_net, names)
    n = F.col("name")
    resistor = F.when(F.col("ohm") > 0, F.concat(F.lit("*RES\n1 "), n, F.lit(":1 "), n, F.lit(":2 "), _number(F.col("ohm")), F.lit("\n"))).otherwise("")
    block = F.concat(
        F.lit("*D_NET "), n, F.lit(" "), _number(F.col("near") + F.col("far")), F.lit("\n*CAP\n1 "), n, F.lit(":1 "), _number(F.col("near")),
        F.lit("\n2 "), n, F.when(F.col("ohm") > 0, ":2 ").otherwise(":1 "), _number(F.col("far")), F.lit("\n"), resistor, F.lit("*END\n"),
    )
    return _headed(d.select(F.col("net").cast("long").alias("net"), block.alias("block")), head)


def dspf(per_net: DataFrame, cell: str, names: DataFrame | None = None) -> DataFrame:
    """``(net, block)`` as of :func:`spef`: a ``*|NET`` with its capacitors to node 0 and its resistor; ends with ``.ENDS``."""
    head = f"*|DSPF 1.5\n*|DESIGN {cell}\n*|DIVIDER /\n*|DELIMITER :\n*|GROUND_NET 0\n.SUBCKT {cell}\n"
    d = _named(per_net, names)
    n, key = F.col("name"), F.col("net").cast("string")
    far = F.when(F.col("ohm") > 0, ":2").otherwise(":1")
    resistor = F.when(F.col("ohm") > 0, F.concat(F.lit("R"), key, F.lit(" "), n, F.lit(":1 "), n, F.lit(":2 "), _number(F.col("ohm")), F.lit("\n"))).otherwise("")
    block = F.concat(
        F.lit("*|NET "), n, F.lit(" "), _number(F.col("near") + F.col("far")), F.lit("f\nCn"), key, F.lit(" "), n, F.lit(":1 0 "), _number(F.col("near")),
        F.lit("f\nCf"), key, F.lit(" "), n, far, F.lit(" 0 "), _number(F.col("far")), F.lit("f\n"), resistor,
    )
    out = _headed(d.select(F.col("net").cast("long").alias("net"), block.alias("block")), head)
    return out.union(out.sparkSession.range(1).select(F.lit((1 << 63) - 1).alias("net"), F.lit(".ENDS\n").alias("block")))


def _headed(blocks: DataFrame, head: str) -> DataFrame:
    return blocks.sparkSession.range(1).select(F.lit(None).cast("long").alias("net"), F.lit(head).alias("block")).union(blocks)


def write(blocks: DataFrame, path: str) -> None:
    """Write blocks in order of nets as text parts; the parts in order of their names are the file."""
    lines = F.regexp_replace("block", "\\n\\z", "").alias("block")  # the writer ends each with a line break
    blocks.sort(F.asc_nulls_first("net")).select(lines).write.text(path)

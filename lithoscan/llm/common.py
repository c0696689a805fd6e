"""Shared helpers of the training-data operators.

Every helper is lazy unless its docstring says otherwise. Intermediate tables
that are read more than once go to the shared checkpoint folder as Parquet, so
a lost executor costs a re-read, never a recomputation from the texts.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.stage import discard
from ..plans.stage import staged as materialize

__all__ = ["discard", "materialize"]

#: Rows per Arrow batch where whole texts cross to Python: 256 texts of 1 MB
#: still fit in a worker's memory.
TEXT_BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what a Python worker has freed to the system at a task's end: idle workers are kept, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more, before a stage that needs the room."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_text_batches(spark: SparkSession) -> None:
    """Hold down the Arrow batches that carry whole texts.

    Plans read the setting when they run, so it stays; a smaller one, set by
    the caller, is left as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(df: DataFrame, keys: list[str], order: list[str], salts: int | Column, name: str = "rank") -> DataFrame:
    """Gapless rank from 0 within ``keys``, without one task per key.

    Rows of a key are dealt to ``salts`` salts, a number or a column that is the
    same for all rows of a key, by a hash of ``order``; counts
    per (key, salt) are prefix-summed (a row for each salt of a key), and only
    rows within one salt are sorted together. Ties take any order among
    themselves; ranks stay gapless. A null key is a key like any other.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), salts if isinstance(salts, Column) else F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__salt").alias("__s"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"),
    )
    within = W.partitionBy(*keys, "__salt").orderBy(*order)
    ranked = salted.withColumn("__rn", F.row_number().over(within) - 1)
    on = [ranked[k].eqNullSafe(base[f"__k_{k}"]) for k in keys] + [ranked["__salt"] == base["__s"]]
    joined = ranked.join(base, on)
    return joined.select(*df.columns, (F.col("__base") + F.col("__rn")).cast("long").alias(name))


def fresh(columns: list[str], name: str) -> str:
    """``name``, or the same with underscores before it, so that it clashes with none."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(docs: DataFrame) -> Column:
    """All columns as one struct ``row``, so that no name of theirs meets an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in columns]


def utf8(text: Column) -> Column:
    """A text's UTF-8 bytes; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")

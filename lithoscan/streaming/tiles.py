"""Changed tiles as a stream: late and repeated changes settle per tile, and each batch re-checks what it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def settled_tiles(changes: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``window, layer, tx, ty, n`` of a stream ``changes(ts, layer, tx, ty)``: changes of each tile by window of event time, dropped from state after ``late``."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", window), "layer", "tx", "ty").agg(F.count(F.lit(1)).alias("n"))


def recheck(changes: DataFrame, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """For every batch of changed tiles, write ``check`` of the distinct tiles to ``out/batch=...``; replayed batches overwrite their own folder."""

    def each(batch: DataFrame, number: int) -> None:
        tiles = batch.select("layer", "tx", "ty").distinct()
        check(tiles).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

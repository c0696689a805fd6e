"""Bucket-wise link search without emitting all pairs, and the components of the links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import give_back

__all__ = ["connected_components", "link_buckets"]


def link_buckets(
    rows: DataFrame,
    key: list[str],
    spread: str,
    payload: list[str],
    link: Callable[[dict[str, list | np.ndarray]], list[tuple[int, int]]],
    block: int = 2048,
    schema: str = "a long, b long",
    with_payload: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Edges that ``link`` finds within each bucket of ``rows``.

    ``link`` gets the payload columns of one bucket and returns a spanning
    forest of its true links, so a bucket of k rows gives fewer than k edges. A
    bucket of more than ``block`` rows is dealt to blocks by ``spread``; each
    pair of blocks is a task's work of its own, so no task holds more than two
    blocks and no pair is missed. A null in a key is a value like any other; no
    row gives no edge; equal rows are linked like any two. Where the payload comes by a join,
    ``with_payload`` adds it after the buckets are counted. Eager only in that count.
    """
    heavy = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(f"__n > {block}")
    heavy = heavy.select(*[F.col(k).alias(f"__h_{k}") for k in key], F.ceil(F.col("__n") / F.lit(block // 2)).cast("int").alias("__nb"))
    is_heavy = bool(heavy.head(1))
    rows = with_payload(rows)
    if is_heavy:
        on = [F.col(k) == F.col(f"__h_{k}") for k in key]
        marked = rows.join(heavy, on, "left").withColumn(
            "__i", F.when(F.col("__nb").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("__nb")).cast("int"))
        )
        cells = marked.withColumn("__j", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__nb"), F.lit(1)) - 1)))
        cells = cells.select(*key, *payload, F.least("__i", "__j").alias("__ci"), F.greatest("__i", "__j").alias("__cj"))
    else:
        cells = rows.select(*key, *payload, F.lit(0).alias("__ci"), F.lit(0).alias("__cj"))
    keys = [*key, "__ci", "__cj"]
    dealt = cells.withColumn("__g", F.xxhash64(*keys)).repartition("__g").sortWithinPartitions("__g", *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < 20_000:
                continue
            whole = pa.Table.from_batches(kept).combine_chunks()
            ends = _starts(whole, keys)
            cut = int(ends[-1])
            if cut:
                yield from _linked(whole.slice(0, cut), keys, payload, link, ends[:-1])
            kept = whole.slice(cut).combine_chunks().to_batches()
        if kept:
            whole = pa.Table.from_batches(kept).combine_chunks()
            if whole.num_rows:
                yield from _linked(whole, keys, payload, link, _starts(whole, keys))
        give_back()

    return dealt.drop("__g").mapInArrow(run, schema)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _linked(t: pa.Table, keys: list[str], payload: list[str], link: Callable, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    ends = np.append(starts[1:], t.num_rows)
    multi = np.flatnonzero(ends - starts > 1)
    out: set[tuple[int, int]] = set()
    if multi.size:
        flat = {
            p: t.column(p).to_numpy() if pa.types.is_primitive(t.column(p).type) else t.column(p).to_pylist()
            for p in payload
        }
        for g in multi:
            s, e = starts[g], ends[g]
            out.update(link({p: v[s:e] for p, v in flat.items()}))
    if out:
        a, b = zip(*sorted(out), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

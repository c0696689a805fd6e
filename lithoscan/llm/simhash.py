"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes of 3-word shingles. The 64 bits are divided
into a few partitions of correlated bits; each partition gets a threshold of its
own, chosen by dynamic programming on estimated candidate counts under
``sum(threshold + 1) = distance + 1``. Two fingerprints within the distance
agree, within the threshold, on at least one partition, so probing every
partition finds every link whatever the estimates are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, small_text_batches, table, utf8
from .components import connected_components, link_buckets
from .substrings import similar_texts

BITS = 64
SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text's ``width``-word shingles; no word: 0."""
    words = text.lower().split()  # bytes: A-Z only, and splits at 0x20 and 0x09-0x0D only
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return int.from_bytes(xxhash.xxh64_digest(joined, SEED))
    ends = [e + i for i, e in enumerate(itertools.accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: n - width])]
    digest, total = xxhash.xxh64_digest, n - width + 1
    counts = np.zeros(BITS, dtype=np.int64)
    spans = zip(starts, ends[width - 1 :], strict=True)
    while chunk := b"".join(digest(joined[s:e], SEED) for s, e in itertools.islice(spans, 1 << 15)):
        bits = np.unpackbits(np.frombuffer(chunk, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes())


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` of every row of ``docs``; a null text counts as empty.

    ``fp`` holds the 64 bits as a signed long.
    """
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("t")).mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Partition:
    """Bit positions (0: lowest) and the threshold within them."""

    bits: tuple[int, ...]
    threshold: int


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows of ``fps(fp)`` and, for each two bits, the rows that have both.

    Each task sends one 64 x 64 matrix at most; 4,096 sums reach the driver
    whatever the input's size. Eager.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = ((x[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both += bits.T @ bits
            n += len(x)
        if n:
            cell = np.append(np.arange(BITS * BITS), -1)
            count = np.append(both.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count)], names=["cell", "c"])

    rows = fps.select("fp").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect()
    found = {r["cell"]: r["c"] for r in rows}
    n = found.pop(-1, 0)
    out = np.zeros(BITS * BITS)
    for cell, c in found.items():
        out[cell] = c
    return n, out.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Divide the bits into ``parts`` groups of near equal width, correlated bits together."""
    p = both / max(n, 1)
    f = np.diag(p)
    var = f * (1 - f)
    scale = np.sqrt(np.outer(var, var))
    corr = np.abs(np.divide(p - np.outer(f, f), scale, out=np.zeros_like(p), where=scale > 1e-12))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        sub = corr[np.ix_(free, free)]
        own = [free[int(sub.sum(axis=1).argmax())]]
        free.remove(own[0])
        while len(own) < width:
            best = max(free, key=lambda b: (corr[b, own].mean(), -b))
            own.append(best)
            free.remove(best)
        groups.append(own)
    return groups


def agreement(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated chance that two rows differ in at most 0..``most`` of ``bits``.

    The disagreements of successive bits are taken as a Markov chain whose pair
    distributions come from the joint counts of the bits.
    """
    p = both / max(n, 1)
    dist: np.ndarray | None = None  # [last bit differs, number that differ]
    for i, b in enumerate(bits):
        f = p[b, b]
        differ = 2 * f * (1 - f)
        if dist is None:
            dist = np.zeros((2, most + 2))
            dist[0, 0], dist[1, 1] = 1 - differ, differ
            continue
        a = bits[i - 1]
        fa, j = p[a, a], p[a, b]
        p11, p10, p01 = j, fa - j, f - j
        p00 = 1 - p11 - p10 - p01
        both_differ = 2 * (p11 * p00 + p10 * p01)
        a_differs = 2 * fa * (1 - fa)
        given1 = both_differ / a_differs if a_differs > 0 else differ
        given0 = (differ - both_differ) / (1 - a_differs) if a_differs < 1 else differ
        new = np.zeros_like(dist)
        for last, chance in ((0, min(max(given0, 0), 1)), (1, min(max(given1, 0), 1))):
            new[0] += dist[last] * (1 - chance)
            new[1, 1:] += dist[last, :-1] * chance
            new[1, -1] += dist[last, -1] * chance
        dist = new
    total = dist.sum(axis=0) if dist is not None else np.ones(most + 2)
    return list(np.cumsum(total)[: most + 1])


def variants(width: int, threshold: int) -> int:
    return sum(comb(width, k) for k in range(threshold + 1))


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int, row_cost: float = 40.0) -> tuple[float, list[int]]:
    """Thresholds of least cost with ``sum(threshold + 1) = distance + 1``.

    Cost of a threshold: the rows that it probes with, each worth ``row_cost``
    comparisons, plus the candidate pairs it is estimated to give; -1 leaves the
    partition out. Dynamic programming over partitions and what is left to give.
    """
    best = {0: (0.0, [])}
    for bits in groups:
        near = agreement(n, both, bits, distance)
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, distance - used + 1):
                if t > len(bits):
                    continue
                own = 0.0 if t < 0 else row_cost * n * variants(len(bits), t) + 0.5 * n * n * near[t]
                key = used + t + 1
                if key <= distance + 1 and (key not in new or cost + own < new[key][0]):
                    new[key] = (cost + own, [*ts, t])
        best = new
    return best[distance + 1]


def plan_partitions(n: int, both: np.ndarray, distance: int = 3) -> list[Partition]:
    """The cheapest of the divisions into 1 to distance + 1 partitions, by :func:`allocate`."""
    found = []
    for parts in range(1, distance + 2):
        groups = group_bits(n, both, parts)
        cost, ts = allocate(n, both, groups, distance)
        found.append((cost, parts, [Partition(tuple(g), t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found)[2]


def probe_keys(fp: Column, partition: Partition) -> Column:
    """Array of the partition's value with up to ``threshold`` of its bits flipped, itself first."""
    masks = [sum(1 << b for b in flip) for k in range(partition.threshold + 1) for flip in itertools.combinations(partition.bits, k)]
    value = fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in partition.bits))))
    return F.array(*[value.bitwiseXOR(F.lit(_signed(m))) for m in masks]) if len(masks) <= 64 else F.transform(
        F.lit([_signed(m) for m in masks]), lambda m: value.bitwiseXOR(m)
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hamming_links(reps: DataFrame, partitions: list[Partition], distance: int, block: int = 2048) -> DataFrame:
    """Spanning forests ``(a, b)`` of the links between rows of ``reps(id, fp)``, fp distinct.

    A row meets another in a bucket (partition, value): with its own value, or
    with one that differs within the threshold. Buckets without a row's own
    value are skipped; all others are verified on the whole 64 bits.
    """
    probes = None
    for i, part in enumerate(partitions):
        rows = reps.select("id", "fp", F.posexplode(probe_keys(F.col("fp"), part)).alias("flip", "value"))
        rows = rows.select(F.lit(i).alias("part"), "value", (F.col("flip") == 0).cast("int").alias("own"), "id", "fp")
        probes = rows if probes is None else probes.union(rows)

    def link(g: dict) -> list[tuple[int, int]]:
        if not g["own"].any():
            return []
        fps, ids = g["fp"].view(np.uint64), g["id"]
        if len(fps) == 2:
            return [(int(ids.max()), int(ids.min()))] if int(fps[0] ^ fps[1]).bit_count() <= distance and ids[0] != ids[1] else []
        edges, rest = [], np.arange(len(fps))
        while rest.size > 1:
            root, rest = rest[0], rest[1:]
            todo = [root]
            while todo and rest.size:
                hit = np.bitwise_count(fps[rest] ^ fps[todo.pop()]) <= distance
                if hit.any():
                    new, rest = rest[hit], rest[~hit]
                    todo.extend(new)
                    edges += [(int(max(ids[x], ids[root])), int(min(ids[x], ids[root]))) for x in new]
        return edges

    return link_buckets(probes, ["part", "value"], "fp", ["own", "id", "fp"], link, block)


def _to_reps(fps: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges from documents to the smallest doc_id of their fingerprints."""
    return fps.join(reps, "fp").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3, block: int = 2048, similarity: float | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)``: every row's fingerprint and the smallest doc_id it is linked to.

    Rows of equal fingerprints are one node from the start, so a group of
    copies costs one row; links between different fingerprints come from
    :func:`hamming_links`. A null or empty text has fingerprint 0 and links like
    any other. With ``similarity``, documents whose 5-word shingles have that
    Jaccard likeness are linked as well, whatever their fingerprints' distance.
    Rows of one doc_id are one document. A null doc_id keeps its row,
    takes no part in linking, and has a null component. An empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    fps = materialize(fingerprints(docs, width), "simhash")
    reps = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-reps")
    n, both = bit_counts(reps)
    if n > 1:
        edges = hamming_links(reps, plan_partitions(n, both, distance), distance, block)
        # a document of several rows with different texts joins their fingerprints
        several = fps.groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
        edges = edges.union(_to_reps(fps.join(several.select("doc_id"), "doc_id", "left_semi"), reps))
        if similarity is not None:
            alike = materialize(similar_texts(docs, similarity), "simhash-alike")
            ends = alike.select(F.col("a").alias("doc_id")).union(alike.select("b")).distinct()
            edges = edges.union(alike).union(_to_reps(fps.join(ends, "doc_id", "left_semi"), reps))
        roots = connected_components(edges)
        owner = reps.join(roots, reps["id"] == roots["node"], "left").select(F.col("fp").alias("f"), F.coalesce("root", "id").alias("component_id"))
    else:
        owner = reps.select(F.col("fp").alias("f"), F.col("id").alias("component_id"))
    joined = fps.join(owner, fps["fp"] == owner["f"], "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each component of :func:`near_duplicates`.

    Rows of a null doc_id stay. Of several rows of one kept doc_id, all stay.
    """
    gone = near_duplicates(docs, distance, similarity=similarity).where("component_id is not null and component_id <> doc_id")
    ids = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["__gone"], "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

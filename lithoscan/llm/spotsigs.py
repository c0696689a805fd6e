"""SpotSigs fingerprints: chains of content words that follow common words.

A spot is a common word (the anchor) with the next content words after it; a
text's fingerprint is the set of its spots' hashes. Texts are compared by the
Jaccard likeness of their sets, which set lengths alone bound from above.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, small_text_batches, table
from .components import connected_components, link_buckets
from .substrings import _colliding

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    """the of and to a in is it that was for on with as be by at this have from or an are not but they which you had his
    der die das und in zu den ist von mit auf für im nicht ein eine als auch dem des sich wird
    le la les de des du un une et en que qui est dans pour par sur au avec ce pas plus
    el los las una y por con para su al lo del como más se no es""".split()
)
CHAIN = 2
#: Of a text's 3-word windows, those whose hash is divisible by this are spots
#: too, in every text, so that short texts and tables have some to compare and
#: a small edit never changes the kinds of spots.
EVERY = 2
WORD = re.compile(r"\w+")


def spots(text: str, chain: int = CHAIN, every: int = EVERY) -> np.ndarray:
    """Sorted 32-bit hashes of a text's spots; of the whole text where it has none."""
    words = WORD.findall(text.lower())
    content, anchors = [], []
    for w in words:
        if w in ANCHORS:
            anchors.append((w, len(content)))
        else:
            content.append(w)
    end = len(content) - chain
    digest = xxhash.xxh32_intdigest
    found = {digest(f"{a} {' '.join(content[c : c + chain])}") for a, c in anchors if c <= end}
    found.update(h for h in map(digest, map(" ".join, zip(*(words[i:] for i in range(chain + 1))))) if h % every == 0)
    if not found and text.strip():
        found = {digest(" ".join(words) or text)}
    return np.unique(np.fromiter(found, np.uint32, len(found)))


def fingerprint(found: np.ndarray) -> str:
    """The set as text: base64 of its hashes in order, four bytes each."""
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets, 1 for two empty ones.

    0 without a comparison where the lengths alone keep it below ``least``.
    """
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, block: int = 512) -> DataFrame:
    """``(doc_id, fingerprint, class_id)``: the class of every row by likeness of ``similarity`` or more.

    Sets are partitioned by length so that likely pairs lie in the same or in
    neighbouring partitions; within them, two sets can only be alike enough if
    they share one of the first hashes of each, so these are the buckets, and
    pairs in them are compared after pruning by length. Equal fingerprints are
    one set from the start. ``class_id`` is the smallest doc_id of the class.

    Null and empty texts have the empty fingerprint and are one class; a null
    doc_id keeps its row with a null class; rows of one doc_id are one document;
    an empty table gives an empty result; other columns are ignored. Eager.
    """
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(spots(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")
    rows = materialize(rows, "spots")
    sets = rows.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("unit"))
    sets = materialize(sets, "spot-sets")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, keys = [], []
            for fp, unit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(base64.b64decode(fp), "<u4").astype(np.int64)
                if not len(s):
                    continue
                own = int(np.floor(np.log(len(s)) / -np.log(similarity))) if similarity < 1 else len(s)
                first = s[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]
                units.append(unit)
                keys.append(np.concatenate([first * 1_000_003 + own, first * 1_000_003 + own + 1]))
            if units:
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["unit", "bands"])

    near = materialize(_colliding(sets.mapInArrow(keyed, "unit long, bands array<long>")), "spot-keys")
    pairs = near.join(sets, "unit")

    def link(g: dict) -> list[tuple[int, int]]:
        own = [np.frombuffer(base64.b64decode(f), "<u4") for f in g["fingerprint"]]
        ids, edges, rest = g["unit"], [], list(range(len(own)))
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            todo = [root]
            while todo and rest:
                at = own[todo.pop()]
                new = [x for x in rest if likeness(at, own[x], similarity) >= similarity]
                gone = set(new)
                rest = [x for x in rest if x not in gone]
                todo += new
                edges += [(int(max(ids[x], ids[root])), int(min(ids[x], ids[root]))) for x in new if ids[x] != ids[root]]
        return edges

    roots = connected_components(link_buckets(pairs, ["key"], "unit", ["unit", "fingerprint"], link, block))
    owner = sets.join(roots, sets["unit"] == roots["node"], "left").select(F.col("fingerprint").alias("f"), F.coalesce("root", "unit").alias("class_id"))
    joined = rows.join(owner, rows["fingerprint"] == owner["f"], "left")
    return joined.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


LOWEST = -(1 << 63)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``(block, guest, place, doc_id, text)``, sorted so that every document is followed by the next one.

    Documents go down in doc_id by blocks of about equal counts, one task each.
    The first document of the block below comes as a guest at the end of each
    block (of the last one: the very first document), so that no order over the
    whole table is needed. Only the blocks' bounds reach the driver. A null
    doc_id comes last; equal doc_ids are in order of their texts. Eager in the bounds.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    base = docs.select(place.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = base.select("place")
    cuts = np.unique(np.array(ids.approxQuantile("place", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else [], dtype=np.float64))

    @F.pandas_udf("int")
    def block(p):  # noqa: ANN001
        return p.astype("float64").map(lambda v: v).pipe(lambda s: s.__class__(np.searchsorted(cuts, s.to_numpy(), side="right").astype(np.int32)))

    tops = sorted((r["block"], r["top"]) for r in ids.withColumn("block", block("place")).groupBy("block").agg(F.max("place").alias("top")).collect())
    guests = spark.createDataFrame([(b, tops[i - 1][1]) for i, (b, _) in enumerate(tops)], "block int, top long")
    own = base.withColumn("block", block("place")).withColumn("guest", F.lit(0))
    visiting = base.join(F.broadcast(guests), F.col("place") == F.col("top")).withColumn("guest", F.lit(1))
    cols = ["block", "guest", "place", "doc_id", "text"]
    both = own.select(*cols).union(visiting.select(*cols))
    return both.repartitionById(parts, "block").sortWithinPartitions(F.desc("block"), "guest", F.desc("place"), "text")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint beside that of its edited text and of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``: the edited text has the last third of its code
    points replaced by as many of the first ones of the next document, downward
    in doc_id and round again. A null text is empty; a single document is its
    own next one; ties and null ids as :func:`with_next` orders them; an empty
    table gives an empty result; other columns are ignored.
    """
    small_text_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def row(one: tuple, after: tuple) -> tuple:
        doc, text, own = one
        m = len(text) // 3
        edited = text[: len(text) - m] + after[1][:m]
        changed = spots(edited)
        return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, after[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, None
        for b in batches:
            out = []
            for block, guest, doc, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if guest and (last is None or block != at):
                    continue
                now = (doc, text, spots(text))
                if last is not None:
                    out.append(row(last, now))
                last, at = (None if guest else now), block
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return with_next(docs).mapInArrow(run, schema)


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))

"""Substring dedup: paragraph MinHash banding, exact verification, removal by components.

Paragraphs are a text's lines of at least ``WORDS`` words, long ones cut by
content into stretches of at least ``LONG`` words, so that one changed word in
them leaves 0.8 alike, and the whole of a shorter text: MinHash bands find them, their shingles' exact Jaccard
likeness verifies them, and components of links are removed together.

Passages also repeat inside lines. For these, windows of ``WORDS`` words start
where the text itself says: at the least 5-word shingle of every ``WINDOW``
successive ones. Any passage of more than ``WORDS + WINDOW`` words that two
documents share gives both at least one equal window, wherever it stands. Of two
successive windows the stretch from the one's first to the other's last word is
compared as well, so a shared passage is found whole between its windows, and
where it goes on before the first or after the last of them, it is extended word
by word to all that two documents share.

Texts that are equal as a whole are one class from the start: only the first
document's is looked into.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, packed, release, shuffle_partitions, small_text_batches, table, unpacked, utf8
from .components import connected_components, link_buckets

SHINGLE, WORDS, WINDOW = 5, 20, 30
#: Least words of the stretches that a line of more than twice as many is cut into.
LONG = 50
#: Paragraphs whose shingles a task remembers having sent; never changes results.
SENT = 200_000
#: Copies of whole texts up to which they are broadcast; beyond, they are joined.
BROADCAST_COPIES = 1_000_000
SIMILARITY, RECALL, BACKGROUND, FALSE = 0.8, 0.98, 0.1, 0.05
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tune(similarity: float = SIMILARITY, recall: float = RECALL, background: float = BACKGROUND, most_false: float = FALSE) -> tuple[int, int]:
    """``(bands, rows)``: the fewest bands of the fewest rows that find a pair of
    ``similarity`` with chance ``recall`` and one of ``background`` with at most ``most_false``."""
    for bands in range(1, 65):
        for rows in range(1, 17):
            hit = lambda s: 1 - (1 - s**rows) ** bands  # noqa: B023, E731
            if hit(similarity) >= recall and hit(background) <= most_false:
                return bands, rows
    raise ValueError("no such bands")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2^64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            more = pow(self.base, len(self.known), 1 << 64)
            self.known = np.concatenate([self.known, self.known * np.uint64(more)])
        return self.known[:n]


_powers = _Powers(int(_BASE))
_inverse_powers = _Powers(pow(int(_BASE), -1, 1 << 64))


class Pieces(NamedTuple):
    """Paragraphs of a text: where they start (in words), their lengths and hashes, and the hashes of their shingles."""

    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    sets: list[np.ndarray]


NONE = Pieces(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), [])


class Words:
    """A text's words, and hashes of any run of them from sums over its beginnings."""

    def __init__(self, text: bytes):
        words = text.lower().split()
        self.n = n = len(words)
        w = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(w * _powers(n), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hashes of the runs of ``length`` words at ``starts``; equal runs have equal ones wherever they stand."""
        return _mix((self.sums[starts + length] - self.sums[starts]) * _inverse_powers(self.n)[starts] + np.asarray(length).astype(np.uint64))

    def shingles(self) -> np.ndarray:
        return self.hashes(np.arange(self.n - SHINGLE + 1), SHINGLE)


def whole_text(text: bytes) -> Pieces:
    """A whole text as its one paragraph; one without a shingle has none."""
    words = Words(text)
    if words.n < SHINGLE:
        return NONE
    shingles = words.shingles()
    return Pieces(np.zeros(1, np.int64), np.array([words.n]), np.array([xxhash.xxh64_intdigest(shingles.tobytes())], np.uint64), [shingles])


def _sliding(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``span`` successive values, by doubling."""
    out, done = x, 1
    while done < span:
        step = min(done, span - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def window_starts(shingles: np.ndarray, n: int) -> np.ndarray:
    """Where the windows of a text of ``n`` words start.

    A shingle starts one where it is the least of any ``WINDOW`` successive ones
    and the window ends within the text. Words that repeat in turn, where each
    of many is the least, start one per ``WINDOW`` only.
    """
    if n < WORDS:
        return np.empty(0, np.int64)
    span = min(WINDOW, len(shingles))
    least = _sliding(shingles, span, np.minimum)
    wide = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    starts = np.flatnonzero(_sliding(wide, span, np.maximum) == shingles)
    if (shingles[starts[1:]] == shingles[starts[:-1]]).any():
        kept = [int(starts[0])]
        for s, after in zip(starts[1:].tolist(), [*starts[2:].tolist(), n], strict=True):
            if shingles[s] != shingles[kept[-1]] or after - kept[-1] > WINDOW:
                kept.append(s)
        starts = np.array(kept)
    starts = starts[starts + WORDS <= n]
    return starts if starts.size else np.zeros(1, np.int64)


def lines(text: bytes, words: Words | None = None) -> Pieces:
    """A text's lines of at least ``WORDS`` words, or the stretches of a long one; a text of fewer words is one line.

    A line of more than ``2 * LONG`` words is cut where a shingle is the least
    one of the ``LONG`` before and after it, so equal text is cut equally.
    """
    counts = np.array([len(x.split()) for x in text.split(b"\n")])
    ends = np.cumsum(counts)
    spans = [(int(e - n), int(e)) for n, e in zip(counts, ends, strict=True) if n >= WORDS]
    if SHINGLE <= ends[-1] < WORDS:
        spans = [(0, int(ends[-1]))]
    if not spans:
        return NONE
    shingles = (words or Words(text)).shingles()
    starts, stops = [], []
    for s, e in spans:
        cuts = [s]
        if e - s > 2 * LONG:
            own = shingles[s : e - SHINGLE + 1]
            if len(own) > 2 * LONG:
                least, before = _sliding(own, 2 * LONG + 1, np.minimum), _sliding(own, LONG, np.minimum)[: len(own) - 2 * LONG]
                at = np.flatnonzero((least == own[LONG:-LONG]) & (before > own[LONG:-LONG])) + LONG + s  # of equal ones the first
                cuts += [c for c in at.tolist() if e - c >= LONG]
        starts += cuts
        stops += [*cuts[1:], e]
    sets = [shingles[a : b - SHINGLE + 1] for a, b in zip(starts, stops, strict=True)]
    hashes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
    return Pieces(np.array(starts), np.array(stops) - np.array(starts), hashes, sets)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of MinHash band keys for each set of shingle hashes, which are mixed well enough to be only multiplied here."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    factors = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    keys = np.zeros((len(sets), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = _mix(key * _BASE + np.minimum.reduceat(flat * factors[b * rows + r], starts))
        keys[:, b] = key
    return keys


def _texts(docs: DataFrame) -> DataFrame:
    small_text_batches(docs.sparkSession)
    t = utf8(F.col("text"))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("t"))


SCAN = "doc_id long, text_hash long, text_words int, start int, n_words int, unit long, stretch long, stretch_words int, bands array<long>"


def scan(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Every window and line of ``docs(doc_id, text_hash, t)``, a row each.

    ``unit``: its words' hash; a line has band keys in ``bands``, a window null.
    ``stretch``: the hash of the ``stretch_words`` words from a window's first to
    the next one's last; of the last window and of lines ``stretch_words`` is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = []
            sets: list[np.ndarray] = []
            for at, t in enumerate(b.column(2).to_pylist()):
                words = Words(t)
                if words.n < SHINGLE:
                    continue
                starts = window_starts(words.shingles(), words.n)
                reach = np.zeros(len(starts), np.int64)
                reach[:-1] = np.diff(starts) + WORDS
                found = lines(t, words)
                k, m = len(starts), len(found.starts)
                out.append([
                    np.full(k + m, at), np.full(k + m, words.n), np.concatenate([starts, found.starts]), np.concatenate([np.full(k, WORDS), found.lengths]),
                    np.concatenate([words.hashes(starts, WORDS), found.hashes]), np.concatenate([words.hashes(starts, reach), np.zeros(m, np.uint64)]),
                    np.concatenate([reach, np.zeros(m, np.int64)]), np.concatenate([np.zeros(k, bool), np.ones(m, bool)]),
                ])
                sets += found.sets
            if not out:
                continue
            row, n, start, length, unit, stretch, reach, is_line = (np.concatenate(c) for c in zip(*out, strict=True))
            keys = band_keys(sets, bands, rows) if sets else np.empty((0, bands), np.uint64)
            ends = np.concatenate([[0], np.cumsum(is_line * bands)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)), mask=pa.array(~is_line))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), *(pa.array(c.astype(np.int32)) for c in (n, start, length)),
                    pa.array(unit.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(reach.astype(np.int32)), listed,
                ],
                names=[c.split()[0] for c in SCAN.split(", ")],
            )
        give_back()

    return docs.mapInArrow(run, SCAN)


def _colliding(found: DataFrame) -> DataFrame:
    """``(key, unit)`` once for every unit of the band keys that different units have.

    Rows come sorted, so a task streams through and holds two rows.
    """
    spark = found.sparkSession
    dealt = found.select(F.explode("bands").alias("key"), "unit").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray, bool] = (np.empty(0, np.int64), np.empty(0, np.int64), False)
        for b in batches:
            k = np.concatenate([last[0], b.column(0).to_numpy()])
            u = np.concatenate([last[1], b.column(1).to_numpy()])
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (u[1:] != u[:-1])
            k, u = k[new], u[new]
            if not k.size:
                continue
            same = np.zeros(len(k) + 1, dtype=bool)  # same[i]: row i has the key of the row before
            same[0] = last[2]
            same[1:-1] = k[1:] == k[:-1]
            hit = (same[:-1] | same[1:])[:-1]
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[:-1][hit]), pa.array(u[:-1][hit])], names=["key", "unit"])
            last = (k[-1:], u[-1:], bool(same[-2]))
        if last[2]:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], names=["key", "unit"])

    return dealt.mapInArrow(run, "key long, unit long")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, pieces: Callable[[bytes], Pieces]) -> DataFrame:
    """``(unit, shingles)`` of at least the ``wanted(unit)`` units of ``docs(doc_id, text_hash, t)``; shingles: their hashes as bytes.

    The texts are read again rather than shuffled: a bitmap of the wanted hashes,
    8 to 16 bits for each and at most 8 MB, goes to the tasks, and what passes it
    by chance is dropped by the later join. A task sends a unit that it has
    just sent only once more after ``SENT`` others.
    """
    log = min(26, max(16, (8 * n_wanted).bit_length()))
    at = wanted.select(F.pmod("unit", F.lit(1 << log)).alias("h"))
    words = at.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (log - 6), dtype=np.uint64)
    bitmap[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = sent.value, set()
        for b in batches:
            ids, sets = [], []
            for t in b.column(2).to_pylist():
                _, _, hashes, shingles = pieces(t)
                h = hashes & np.uint64((1 << log) - 1)
                hit = (bits[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)
                for i in np.flatnonzero(hit):
                    if (unit := int(hashes[i].view(np.int64))) not in known:
                        known.add(unit)
                        ids.append(unit)
                        sets.append(np.unique(shingles[i]).tobytes())
            if len(known) > SENT:
                known.clear()
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["unit", "shingles"])
        give_back()

    return docs.mapInArrow(run, "unit long, shingles binary")


def _similar(similarity: float):
    def link(g: dict) -> list[tuple[int, int]]:
        ids, sets = g["unit"], [frozenset(np.frombuffer(s, np.uint64).tolist()) for s in g["shingles"]]
        edges, rest = [], list(range(len(sets)))
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            todo = [root]
            while todo and rest:
                own, new = sets[todo.pop()], []
                for x in rest:
                    both = len(own & sets[x])
                    if both >= similarity * (len(own) + len(sets[x]) - both):
                        new.append(x)
                if new:
                    gone = set(new)
                    rest = [x for x in rest if x not in gone]
                    todo += new
                    edges += [(int(max(ids[x], ids[root])), int(min(ids[x], ids[root]))) for x in new if ids[x] != ids[root]]
        return edges

    return link


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY, recall: float = 0.9999, block: int = 512) -> DataFrame:
    """Edges ``(a, b)`` between doc_ids whose texts' 5-word shingles have a Jaccard likeness of ``similarity`` or more.

    Candidates come by MinHash bands that meet a pair of just ``similarity``
    with chance ``recall``, and each is verified exactly; the edges are spanning
    forests of the links. Of texts with equal words only the smallest doc_id has
    edges. Texts of fewer than five words have no shingle and no
    edge. Eager up to the edges.
    """
    bands, rows = tune(similarity, recall)
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, keys = [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                _, _, h, sets = whole_text(t)
                if len(h):
                    ids.append(doc)
                    hashes.append(h)
                    keys.append(band_keys(sets, bands, rows)[0].view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "unit", "bands"])
        give_back()

    found = materialize(_texts(docs).mapInArrow(run, "doc_id long, unit long, bands array<long>"), "texts")
    ids = found.groupBy("unit").agg(F.min("doc_id").alias("id"))
    near = materialize(_colliding(found), "texts-near")
    wanted = near.select("unit").distinct()
    if not (n_wanted := wanted.count()):
        return docs.sparkSession.createDataFrame([], "a long, b long")
    sets = _shingle_sets(_texts(docs), wanted, n_wanted, whole_text).dropDuplicates(["unit"])
    links = link_buckets(near, ["key"], "unit", ["unit", "shingles"], _similar(similarity), block, with_payload=lambda rows: rows.join(sets, "unit"))
    named = links.join(ids.select(F.col("unit").alias("a"), F.col("id").alias("ia")), "a").join(ids.select(F.col("unit").alias("b"), F.col("id").alias("ib")), "b")
    return named.where("ia <> ib").select(F.col("ia").alias("a"), F.col("ib").alias("b"))


def _distinct(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(texts, equal)``: the rows of :func:`_texts` but for those whose text a smaller doc_id has too, and
    ``equal(doc_id, text_hash, keeper)``: the rows whose text several doc_ids have. Eager but for the texts."""
    texts = _texts(docs)
    rows = materialize(texts.select("doc_id", "text_hash").distinct(), "texts-rows")
    first = materialize(rows.groupBy(F.col("text_hash").alias("h")).agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last"), "texts-first")
    equal = materialize(rows.join(first, F.col("text_hash") == F.col("h")).select("doc_id", "text_hash", "keeper"), "texts-equal")
    gone = equal.where("doc_id <> keeper").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    gone = F.broadcast(gone) if equal.count() <= BROADCAST_COPIES else gone
    return texts.join(gone, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h")), "left_anti"), equal


def _line_classes(texts: DataFrame, found: DataFrame, similarity: float, block: int) -> DataFrame:
    """``(unit, class_id, keeper)`` of the lines of the scan ``found`` that several documents have, or lines like them.

    Equal lines are one row before their bands are compared. Eager.
    """
    each = found.where("bands is not null").groupBy("unit").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("bands").alias("bands"))
    each = materialize(each, "lines")
    near = materialize(_colliding(each), "lines-near")
    wanted = near.select("unit").distinct()
    named = each.select("unit", "lo", "hi", F.col("unit").alias("class_id"))
    if n_wanted := wanted.count():
        sets = materialize(_shingle_sets(texts, wanted, n_wanted, lines).dropDuplicates(["unit"]), "lines-sets")
        edges = link_buckets(near, ["key"], "unit", ["unit", "shingles"], _similar(similarity), block, with_payload=lambda rows: rows.join(sets, "unit"))
        roots = connected_components(edges).select(F.col("node").alias("u"), "root")
        named = each.join(roots, F.col("unit") == F.col("u"), "left").select("unit", "lo", "hi", F.coalesce("root", "unit").alias("class_id"))
        discard(sets)
    named = materialize(named, "lines-named")
    across = materialize(named.groupBy(F.col("class_id").alias("c")).agg(F.min("lo").alias("keeper"), F.max("hi").alias("last")).where("keeper < last"), "lines-across")
    out = materialize(named.join(across, F.col("class_id") == F.col("c")).select("unit", "class_id", "keeper"), "lines-classes")
    for t in (each, near, named, across):
        discard(t)
    release(texts.sparkSession)
    return out


def _shared(rows: DataFrame, key: str, tag: str) -> DataFrame:
    """``(k, first)``: the values of ``key`` that several documents have, and the smallest doc_id."""
    by = rows.groupBy(F.col(key).alias("k")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return materialize(by.where("first < last").select("k", "first"), tag)


def _windows(found: DataFrame) -> DataFrame:
    """The windows of the scan ``found`` that several documents have, and what of them stands alone.

    ``keeper``, ``stretch_keeper`` and ``before_keeper``: the smallest doc_id with
    the window, with the stretch to the next window, and with the one from the
    window before; null where no other document has that stretch. Eager.
    """
    shared = _shared(found.where("bands is null"), "unit", "windows-shared")
    rows = found.where("bands is null").select("doc_id", "text_hash", "start", "n_words", "unit", "stretch", "stretch_words")
    seeds = materialize(rows.join(shared, F.col("unit") == F.col("k")).drop("k").withColumnRenamed("first", "keeper"), "windows-seeds")
    discard(shared)
    release(found.sparkSession)
    # the last window of a text has no stretch: a key of its own keeps them from meeting
    key = F.when(F.col("stretch_words") > 0, F.col("stretch")).otherwise(F.xxhash64("doc_id", "text_hash", "start"))
    along = _shared(seeds.where("stretch_words > 0"), "stretch", "windows-stretches")
    marked = seeds.withColumn("key", key).join(along, F.col("key") == F.col("k"), "left")
    marked = marked.withColumn("stretch_keeper", F.when(F.col("stretch_words") > 0, F.col("first"))).drop("key", "k", "first")
    order = W.partitionBy("doc_id", "text_hash").orderBy("start")
    next_to = F.lag("start").over(order) + F.lag("stretch_words").over(order) - F.lag("n_words").over(order) == F.col("start")
    marked = materialize(marked.withColumn("before_keeper", F.when(next_to, F.lag("stretch_keeper").over(order))), "windows-marked")
    discard(seeds)
    discard(along)
    return marked


def _extended(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """What documents share before and after the windows ``marked`` as of :func:`_windows`, where a stretch doesn't have it.

    Successive windows of a shared passage start at most ``WINDOW`` words apart,
    and its first and last ones stand less than that from its ends, so ``WINDOW``
    words to each side complete it. Of these words the longest run from the
    window on that another document has, and the longest one that an earlier
    document has, give a row each, of the window and the run:
    ``doc_id, text_hash, start, n_words, class_id, keeper, removed``. Of the
    documents that share a whole stretch only the first one's words are held
    against others'. Equal sides are one row before their prefixes are compared.
    """
    spark = texts.sparkSession
    side = lambda keeper: F.when(F.col(keeper).isNull(), 2).when(F.col(keeper) == F.col("doc_id"), 1).otherwise(0)
    own = marked.withColumns({"left": side("before_keeper"), "right": side("stretch_keeper")}).where("left + right > 0")
    own = own.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set(F.struct("start", "n_words", "unit", "left", "right")).alias("seeds"))
    both = texts.join(own, (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", "t", "seeds")
    schema = "doc_id long, text_hash long, seed int, n int, unit long, after boolean, open boolean, side binary"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text_hash, t, found in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = t.lower().split()
                for x in found:
                    s, n = x["start"], x["n_words"]
                    for after, use, near in ((False, x["left"], words[max(0, s - WINDOW) : s][::-1]), (True, x["right"], words[s + n : s + n + WINDOW])):
                        if use and near:
                            out.append((doc, text_hash, s, n, x["unit"], after, use == 2, b"".join(map(xxhash.xxh32_digest, near))))
            for at in range(0, len(out), 8192):
                cols = zip(*out[at : at + 8192], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    sides = materialize(both.mapInArrow(run, schema), "sides")
    release(spark)
    equal = sides.groupBy("unit", "after", "side").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bool_or("open").alias("open"))
    equal = materialize(equal, "sides-equal")
    several = equal.groupBy(F.col("unit").alias("u"), F.col("after").alias("f")).agg(F.count(F.lit(1)).alias("sides"), F.bool_or("open").alias("any_open"))
    equal = equal.join(several.where("any_open"), (F.col("unit") == F.col("u")) & (F.col("after") == F.col("f")))
    key = F.xxhash64("unit", "after", "side").alias("key")
    full = F.expr("length(side) div 4").cast("int").alias("k")
    alone = equal.where("sides = 1 and lo < hi").select(key, F.array(F.struct(full, F.col("lo"), key.alias("class_id"))).alias("runs"))
    each = equal.where("sides > 1").select(key, "unit", "after", "side", "lo", "hi", "open", F.explode(F.sequence(F.lit(1), full)).alias("k"))
    each = each.select("key", "k", F.expr("xxhash64(unit, after, substring(side, 1, 4 * k))").alias("prefix"), "lo", "hi", "open")
    shared = each.groupBy(F.col("prefix").alias("class_id")).agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last").select("class_id", "first")
    shared = materialize(shared, "sides-shared")
    runs = each.where("open").join(shared, F.col("prefix") == F.col("class_id")).groupBy("key").agg(F.collect_list(F.struct("k", F.col("first").alias("lo"), "class_id")).alias("runs"))
    runs = materialize(alone.union(runs), "sides-runs")
    discard(equal)
    release(spark)
    found = sides.where("open").withColumn("key", key).drop("unit", "side", "open").join(runs, "key")
    found = found.withColumn("all", F.array_max("runs")).withColumn("gone", F.array_max(F.filter("runs", lambda r: r["lo"] < F.col("doc_id"))))
    found = found.select("*", F.explode(F.array_distinct(F.array_compact(F.array("all", "gone")))).alias("x"))
    return found.select(
        "doc_id", "text_hash", F.when(F.col("after"), F.col("seed")).otherwise(F.col("seed") - F.col("x.k")).alias("start"), (F.col("n") + F.col("x.k")).alias("n_words"),
        "x.class_id", F.col("x.lo").alias("keeper"), (F.col("doc_id") != F.col("x.lo")).alias("removed"),
    )


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = 512) -> DataFrame:
    """Paragraphs that another document has too: ``doc_id, text_hash, start, n_words, class_id, keeper, removed``.

    ``start`` and ``n_words`` count words as ``[^\\x20\\x09-\\x0D]+`` of the
    whole text, A-Z read as a-z. Texts that are equal as a whole are one class, and
    but for the first document's no paragraphs of theirs follow. Lines whose bands
    collide are verified by the exact Jaccard likeness of their 5-word shingles, and
    components of links are a class, with all lines equal to theirs. Equal windows are
    extended to all words that two documents share around them; such a stretch
    is a class of its own. A class within one document is left alone. The smallest doc_id of a class keeps its
    paragraphs, ``removed`` is true for all others.

    Rows of one doc_id are one document; rows of a null doc_id aren't compared;
    null and empty texts, and those of fewer than five words, have no paragraph;
    an empty table gives an empty result; other columns of ``docs`` are ignored.
    Eager up to the classes.
    """
    bands, rows = tune(similarity, recall)
    texts, copies = _distinct(docs)
    found = materialize(scan(texts, bands, rows), "paragraphs")
    cols = ["doc_id", "text_hash", "start", "n_words", "class_id", "keeper"]
    classes = _line_classes(texts, found, similarity, block)
    of_lines = found.where("bands is not null").withColumnRenamed("unit", "u").join(classes, F.col("u") == F.col("unit")).select(cols)
    of_lines = materialize(of_lines, "paragraphs-lines")
    lengths = found.join(copies.select("text_hash").distinct(), "text_hash", "left_semi").groupBy(F.col("text_hash").alias("h")).agg(F.first("text_words").alias("n"))
    of_copies = copies.join(lengths, F.col("text_hash") == F.col("h")).select("doc_id", "text_hash", F.lit(0).alias("start"), F.col("n").alias("n_words"), F.col("text_hash").alias("class_id"), "keeper")
    of_copies = materialize(of_copies, "paragraphs-copies")
    marked = _windows(found)
    discard(found)
    release(docs.sparkSession)
    single = marked.where("stretch_keeper is null and before_keeper is null").withColumn("class_id", F.col("unit")).select(cols)
    long = marked.where("stretch_keeper is not null").select("doc_id", "text_hash", "start", F.col("stretch_words").alias("n_words"), F.col("stretch").alias("class_id"), F.col("stretch_keeper").alias("keeper"))
    out = of_copies.union(of_lines).union(single).union(long)
    return out.withColumn("removed", F.col("doc_id") != F.col("keeper")).union(_extended(texts, marked))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (start, length) and what stands between these words."""
    data = text.encode()
    gone = np.zeros(max(s + n for s, n in spans) + 1, dtype=bool)
    for s, n in spans:
        gone[s : s + n] = True
    out, at, start = [], 0, None
    for i, m in enumerate(WORD.finditer(data)):
        cut = i < len(gone) and gone[i]
        if cut and start is None:
            start = m.start()
            out.append(data[at:start])
        elif not cut and start is not None:
            at, start = m.start(), None
    if start is None:
        out.append(data[at:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the paragraphs that :func:`repeated_paragraphs` removes; ``n_chars`` follows where there is one.

    A row of which no word is left goes, other rows stay with all columns.
    """
    gone = repeated_paragraphs(docs, similarity).where("removed")
    spans = gone.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n_words")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("text_hash").alias("span_hash"), "spans")
    base = docs.select(packed(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(utf8(F.col("text"))).alias("hash"))
    both = base.join(spans, (F.col("id") == F.col("span_id")) & (F.col("hash") == F.col("span_hash")), "left")

    @F.pandas_udf("string")
    def shorter(text, cuts):  # noqa: ANN001
        return text.combine(cuts, lambda t, c: t if c is None else cut_words(t, [(x["start"], x["n_words"]) for x in c]))

    small_text_batches(docs.sparkSession)
    changed = F.col("spans").isNotNull()
    both = both.select("row", "spans", shorter(F.col("row.text"), "spans").alias("new")).where(~changed | F.col("new").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.when(changed, F.col("new")).otherwise(F.col("row.text")).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("new")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return both.select(*[new.get(c, same) for c, same in zip(docs.columns, unpacked(docs.columns), strict=True)])


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_words", "class_id", "keeper", "removed")

"""Best-fit packing of tokenised documents into sequences, by bin completion.

Only the number of pieces of each length reaches the driver, at most as many
numbers as a sequence has tokens, so the search is the same size for any corpus.
It works on lengths with multiplicities: the longest remaining length is
completed by undominated fillings of the room beside it, depth first, with
best-fit decreasing as the incumbent and the waste that a better solution may
still have as the bound.
"""

from __future__ import annotations

import itertools
import logging
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, small_text_batches, table, with_rank

LENGTH = 2048
END_ID = 0
#: Words whose ids a worker remembers, at most twice as many: when so many are
#: known they become the older half, and the older half goes. Never changes ids.
REMEMBERED = 200_000
#: Steps of the search beyond best-fit decreasing, about two seconds on the
#: driver, unless the caller gives others.
STEPS = 100_000
#: Choices that the search keeps open at once; older ones are made again when it comes back. Never changes results.
OPEN = 32
#: Pieces of one length that are ranked in one task, about.
RANKED = 250_000
#: Runs up to which their table is broadcast; beyond, it is joined.
BROADCAST_RUNS = 500_000

# The pre-tokenizer's classes within Latin letters and common punctuation.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼½¾"
BLANKS = " \\t\\n\\r"
OTHERS = "–—‘’“”…"
PLAIN = re.compile(f"[{BLANKS}\x21-\x7e¡-ɏ{OTHERS}]*")
SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)


class Ids:
    """Token ids of texts as little-endian 32-bit bytes, equal to the tokenizer's own.

    Pre-tokens are encoded independently of each other, so texts of plain
    characters are split here and each pre-token's ids are remembered; any other
    text, or one with a special token's string, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        words, known = SPLIT.findall(text), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                self.older, self.known = known, {}
                known = self.known
            new = set(words).difference(known)
            for w in new & self.older.keys():
                known[w] = self.older[w]
            new = list(new.difference(self.older))
            for w, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[w] = array("I", found.ids).tobytes()
            return b"".join(map(known.__getitem__, words))


@cache
def shared_ids(path: str) -> Ids:
    """The worker process's own :class:`Ids`, so that tasks after its first one know words already."""
    return Ids(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and the end id, cut where longer than ``length``.

    All pieces but the first have ``length`` ids. ``path`` names the
    tokenizer's file on every executor. A null text is empty: one end id.
    """
    small_text_batches(docs.sparkSession)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared_ids(path or tokenizer_path())
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = ids(text or "") + end
                n = len(data) // 4
                cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                for k, (s, e) in enumerate(itertools.pairwise(cuts)):
                    for col, v in zip(cols, (doc, k, s, e - s, zlib.crc32(memoryview(data)[4 * s : 4 * e])), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        ids.older = {}
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: dict[int, int], room: int) -> int:
    """The larger of the volume bound and the bound by pieces that can't share a sequence."""
    sizes = sorted(counts)
    best = -(-sum(s * c for s, c in counts.items()) // room)
    for k in [0, *(s for s in sizes if 2 * s <= room)]:
        alone = sum(c for s, c in counts.items() if s > room - k)
        half = [(s, c) for s, c in counts.items() if room - k >= s and 2 * s > room]
        small = sum(s * c for s, c in counts.items() if k <= s and 2 * s <= room)
        n_half = sum(c for _, c in half)
        free = n_half * room - sum(s * c for s, c in half)
        best = max(best, alone + n_half + max(0, -(-(small - free) // room)))
    return best


def best_fit_decreasing(counts: dict[int, int], room: int) -> list[Pattern]:
    """Best-fit decreasing over lengths with multiplicities: bins of equal filling are one entry."""
    open_bins: dict[int, list[Pattern]] = defaultdict(list)
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(left: int, p: Pattern) -> None:
        if left == 0:
            done.append(p)
            return
        if not open_bins[left]:
            insort(rooms, left)
        open_bins[left].append(p)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                r, (items, m) = room, ((), left)
            else:
                r = rooms[at]
                items, m = open_bins[r].pop()
                if not open_bins[r]:
                    rooms.pop(at)
            each = min(r // size, left)
            used = min(m, left // each)
            put(r - each * size, (items + (size,) * each, used))
            if used < m and items:
                put(r, (items, m - used))
            left -= each * used
    for left in rooms:
        done += open_bins[left]
    return done


def _add(sums: int, size: int, count: int, room: int) -> int:
    """``sums``, where bit k stands for the sum k, with up to ``count`` pieces of ``size`` more, up to ``room``."""
    mask, count, k = (1 << (room + 1)) - 1, min(count, room // size), 1
    while count > 0:  # so many pieces are 1 + 2 + 4 + ... + the rest of them
        k = min(k, count)
        sums |= sums << (size * k) & mask
        count, k = count - k, 2 * k
    return sums


def _spread(bits: int, by: int) -> int:
    """``bits`` with every set bit k set at k..k + ``by``."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: Sequence[int], waste: int, spare: int) -> bool:
    """Some of the filling's pieces could be exchanged for one at least as long that still fits.

    Bit s of ``spare``: a piece of length s is left beside the filling's own.
    Such an exchange leaves shorter pieces for the other sequences. One piece
    may only go for a longer one, several also for one of their sum.
    """
    one, several = 0, 0  # sums of one piece, and of two or more
    for s in filling:
        several |= (one | several) << s
        one |= 1 << s
    if several & spare:
        return True
    return bool(waste and (_spread((one | several) << 1, waste - 1) | _spread(1 << 1, waste - 1)) & spare)


class Steps:
    """How many steps a search may still take; None: any number."""

    def __init__(self, left: int | None):
        self.left = left

    def take(self) -> bool:
        if self.left is not None:
            self.left -= 1
        return self.left is None or self.left >= 0


def fillings(counts: dict[int, int], room: int, most_waste: int | None = None, steps: Steps | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` by pieces of ``counts``, by waste, up to ``most_waste``, as far as ``steps`` go.

    Lazy: sums that the pieces can make are bits of one integer for each prefix
    of the sizes, so the descent, longest first, meets no dead end.
    """
    sizes = sorted(s for s, c in counts.items() if c and s <= room)
    makes = [1]
    for s in sizes:
        makes.append(_add(makes[-1], s, counts[s], room))
    plenty = sum(1 << s for s in sizes if counts[s] > room // s)

    steps = steps or Steps(None)

    def grow(left: int, below: int, chosen: list[int], one: int, several: int) -> Iterator[tuple[int, ...]]:
        if not steps.take():
            return
        if left == 0:
            yield tuple(chosen)
            return
        for at in range(min(below, bisect_right(sizes, left)) - 1, -1, -1):
            s = sizes[at]
            used = chosen.count(s)
            if used == counts[s] or not makes[at + 1] >> left & 1:
                continue
            rest = left - s
            # what is left of this size and the shorter ones must make the rest
            if not (makes[at] >> rest & 1 or (counts[s] - used > 1 and makes[at + 1] >> rest & 1)):
                continue
            more = several | (one | several) << s
            if more & plenty:
                continue  # several pieces make the sum of one that is left: dominated however it goes on
            yield from grow(rest, at + 1, [*chosen, s], one | 1 << s, more)

    top = room if most_waste is None else min(most_waste, room)
    for waste in range(top + 1):
        if makes[-1] >> (room - waste) & 1:
            for found in grow(room - waste, len(sizes), [], 0, 0):
                spare = sum(1 << s for s in sizes if counts[s] > found.count(s))
                if not dominated(found, waste, spare):
                    yield found


def bin_completion(counts: dict[int, int], room: int = LENGTH, steps: int | None = STEPS) -> list[Pattern]:
    """Fillings with multiplicities that hold every piece, in as few bins as the search finds.

    ``counts``: pieces of each length, none over ``room``. Depth first: the
    longest piece left is completed by each undominated filling, by waste, as
    often as it goes and then ever less often; a branch ends where its waste
    allows no better solution. Best-fit decreasing is the first incumbent. The
    result has the fewest bins possible where it meets :func:`lower_bound` or
    the search ends; ``steps`` bounds a search that doesn't, counted in pieces
    placed, after which the best so far stands, and None lets it run to its end.
    """
    left_steps = Steps(steps)
    counts = {s: c for s, c in counts.items() if c}
    best = best_fit_decreasing(counts, room)
    n_best = sum(m for _, m in best)
    least, volume = lower_bound(counts, room), sum(s * c for s, c in counts.items())
    left, path = dict(counts), []  # path: pattern, multiplicity
    bins = waste = 0

    def options() -> Iterator[Pattern]:
        top = max(s for s, c in left.items() if c)
        left[top] -= 1
        own = dict(left)
        left[top] += 1
        for f in fillings(own, room - top, (n_best - 1) * room - volume - waste, left_steps):
            items = (top, *f)
            for times in range(min(left[s] // k for s, k in Counter(items).items()), 0, -1):
                yield items, times

    def step(items: tuple[int, ...], times: int) -> None:
        for s, k in Counter(items).items():
            left[s] -= k * times

    # an open choice and how many options it has given; old ones are made again when the search comes back to them
    stack: list[tuple[Iterator[Pattern] | None, int]] = [(options(), 0)] if counts and n_best > least else []
    while stack and n_best > least and left_steps.take():
        choice, given = stack[-1]
        choice = choice or itertools.islice(options(), given, None)
        found = next(choice, None)
        stack[-1] = (choice, given + 1)
        if found is None:
            stack.pop()
            if path:
                items, times = path.pop()
                step(items, -times)
                bins -= times
                waste -= (room - sum(items)) * times
            continue
        items, times = found
        lost = (room - sum(items)) * times
        if waste + lost > (n_best - 1) * room - volume:
            continue
        step(items, times)
        path.append(found)
        bins += times
        waste += lost
        if any(left.values()):
            if len(stack) > OPEN:
                stack[-OPEN] = (None, stack[-OPEN][1])
            stack.append((options(), 0))
            continue
        if bins < n_best:
            best, n_best = list(path), bins
        path.pop()
        step(items, -times)
        bins -= times
        waste -= lost
    return best


def runs(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, lo, hi, each, base, offset)``: pieces lo..hi-1 of a length go, ``each`` to a sequence, from sequence ``base`` on at ``offset``."""
    out, base, used = [], 0, Counter()
    for items, times in patterns:
        offset = 0
        for size, each in sorted(Counter(items).items(), reverse=True):
            out.append((size, used[size], used[size] + each * times, each, base, offset))
            used[size] += each * times
            offset += each * size
        base += times
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, steps: int | None = STEPS) -> DataFrame:
    """Every piece of every row of ``docs`` with its sequence and offset.

    Pieces as of :func:`pieces`; a full piece is a sequence of its own, numbered
    after the others. Rows of one doc_id, and a null doc_id, are packed like any
    other row. Shorter pieces of a length are ranked in as many salted parts as
    their number asks for, so a very common length is no single task's work, and
    find their place by a table of the runs, broadcast below ``BROADCAST_RUNS``. An empty table gives an empty
    result; other columns of ``docs`` are ignored. Eager up to the search.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, length), "pieces")
    counts = {r["length"]: r["count"] for r in cut.where(F.col("length") < length).groupBy("length").count().collect()}
    patterns = bin_completion(counts, length, steps)
    short = sum(m for _, m in patterns)
    logging.getLogger(__name__).info("%d sequences for pieces shorter than %d, lower bound %d", short, length, lower_bound(counts, length))
    found = runs(patterns)
    where = spark.createDataFrame(found, "size long, lo long, hi long, each long, base long, place long")
    many = {n: -(-c // RANKED) for n, c in counts.items() if c > RANKED}
    salts = F.lit(1)
    if many:
        salts = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for n, m in many.items() for v in (n, m)]), F.col("length")), salts)
    ranked = with_rank(cut.where(F.col("length") < length), ["length"], ["doc_id", "piece"], salts)
    at = F.col("rank") - F.col("lo")
    few = len(found) <= BROADCAST_RUNS
    placed = ranked.join(F.broadcast(where) if few else where, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    whole = cut.where(F.col("length") == length)
    return placed.select(
        *cut.columns,
        (F.col("base") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("place") + at % F.col("each") * F.col("length")).alias("offset"),
    ).union(whole.select(*cut.columns, (F.lit(short) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

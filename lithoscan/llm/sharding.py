"""Sharding by best-fit decreasing: groups of equal texts stay together, shards get near equal bytes.

Groups of near equal size are one class, so the driver places classes with
multiplicities, not groups: at most ``CLASSES`` of them below a mean shard's
size, and at most one per shard above. Each class takes the tightest shard that
still has room, found in a balanced search tree of rooms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, utf8, with_rank

CLASSES = 1 << 14
OVERHEAD = 16
#: Rows that are ranked in one task, about.
RANKED = 250_000
#: Runs up to which their table is broadcast; beyond, it is joined.
BROADCAST_RUNS = 500_000


@dataclass
class _Node:
    key: tuple[float, int]
    left: _Node | None = None
    right: _Node | None = None
    level: int = 1


class RoomTree:
    """Balanced (AA) tree of (room, bin) that finds the tightest room of at least a size."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, key: tuple[float, int]) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key: tuple[float, int]) -> None:
        self.root = self._remove(self.root, key)

    def tightest(self, size: float) -> tuple[float, int] | None:
        at, best = self.root, None
        while at:
            if at.key[0] >= size:
                best, at = at.key, at.left
            else:
                at = at.right
        return best

    def _skew(self, n: _Node) -> _Node:
        if n.left and n.left.level == n.level:
            low = n.left
            n.left, low.right = low.right, n
            return low
        return n

    def _split(self, n: _Node) -> _Node:
        if n.right and n.right.right and n.right.right.level == n.level:
            up = n.right
            n.right, up.left = up.left, n
            up.level += 1
            return up
        return n

    def _add(self, n: _Node | None, key: tuple[float, int]) -> _Node:
        if n is None:
            return _Node(key)
        if key < n.key:
            n.left = self._add(n.left, key)
        else:
            n.right = self._add(n.right, key)
        return self._split(self._skew(n))

    def _remove(self, n: _Node | None, key: tuple[float, int]) -> _Node | None:
        if n is None:
            return None
        if key < n.key:
            n.left = self._remove(n.left, key)
        elif n.key < key:
            n.right = self._remove(n.right, key)
        elif n.left is None:
            return n.right
        else:
            near = n.left
            while near.right:
                near = near.right
            n.key = near.key
            n.left = self._remove(n.left, near.key)
        low = min(n.left.level if n.left else 0, n.right.level if n.right else 0)
        if low < n.level - 1:
            n.level = low + 1
            if n.right and n.right.level > n.level:
                n.right.level = n.level
        n = self._skew(n)
        if n.right:
            n.right = self._skew(n.right)
            if n.right.right:
                n.right.right = self._skew(n.right.right)
        n = self._split(n)
        if n.right:
            n.right = self._split(n.right)
        return n


Run = tuple[int, int, int, int]  # class, first, one past the last, shard


def best_fit_decreasing(classes: list[tuple[int, float, int]], capacity: float, most: int | None = None) -> list[Run] | None:
    """Where the members of ``(class, size, count)`` go; None if ``most`` shards can't hold them.

    Largest first, each into the tightest shard with room, a new one where none
    has; a member over ``capacity`` gets a shard of its own.
    """
    tree, out, opened = RoomTree(), [], 0
    for name, size, count in sorted(classes, key=lambda c: (-c[1], c[0])):
        at = 0
        while at < count:
            best = tree.tightest(size)
            if best is None:
                if most is not None and opened >= most:
                    return None
                room, shard = max(capacity, size), opened
                opened += 1
            else:
                tree.remove(best)
                room, shard = best
            take = min(count - at, max(1, int(room // size)))
            out.append((name, at, at + take, shard))
            at += take
            tree.add((room - take * size, shard))
    return out


def balance(classes: list[tuple[int, float, int]], shards: int) -> list[Run]:
    """Best-fit decreasing at the least capacity, to one part in a million, that ``shards`` shards meet.

    Members larger than an equal share of what is left get shards of their own first.
    """
    left = [[c, s, n] for c, s, n in sorted(classes, key=lambda c: (-c[1], c[0]))]
    total, own = sum(s * n for _, s, n in left), []
    while left and shards - len(own) > 1 and left[0][1] > total / (shards - len(own)):
        name, size, n = left[0]
        own.append((name, sum(1 for r in own if r[0] == name), size))
        total -= size
        left[0][2] -= 1
        if n == 1:
            left.pop(0)
    skip = {}
    for name, k, _ in own:
        skip[name] = k + 1
    rest = [(c, s, n) for c, s, n in left]
    bins = shards - len(own)
    out = [(name, k, k + 1, i) for i, (name, k, _) in enumerate(own)]
    if not rest:
        return out
    low = max(total / bins, rest[0][1])
    step, high, found = 1e-6, low, None
    while found is None:
        found = best_fit_decreasing(rest, high, bins)
        if found is None:
            low, high, step = high, high * (1 + step), step * 2
    for _ in range(12):
        if high - low <= 1e-6 * high:
            break
        mid = (low + high) / 2
        less = best_fit_decreasing(rest, mid, bins)
        if less is None:
            low = mid
        else:
            high, found = mid, less
    return out + [(c, a + skip.get(c, 0), b + skip.get(c, 0), s + len(own)) for c, a, b, s in found]


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, digest)`` of every row of ``docs``; a null text is empty and equal to the empty one."""
    t = utf8(F.col("text"))
    return docs.select(F.col("doc_id"), (F.length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.md5(t)).alias("digest"))


def shard(docs: DataFrame, shards: int | None = 40, capacity: int | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row of ``docs``.

    With ``shards``, sizes are near equal over that many: a class's members count
    with their mean. With ``capacity`` instead, as few shards as best-fit
    decreasing finds hold that many bytes each: members count with their class's
    largest, so no shard but that of a single larger group is ever over it. Equal texts are one indivisible group: one larger than an equal share
    (or than the capacity) gets a shard of its own. Slots are gapless from 0.
    Rows of one doc_id, and a null doc_id, are rows like any other; an empty
    table gives an empty result. Only sizes, counts and digests are shuffled.
    Eager up to the placement.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs), "shard-rows")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = capacity or max(1, -(-total // shards))
    quantum = max(1, share // CLASSES)
    # a class per quantum below a share; above, a class per size: at most one a shard
    name = F.when(F.col("bytes") > share, -F.col("bytes")).otherwise(F.expr(f"bytes div {quantum}"))
    groups = groups.withColumn("class", name)
    # at most CLASSES and a class a shard's share above: bounded, whatever the input
    size = F.max("bytes").cast("double") if capacity else F.avg("bytes")
    classes = [(r["class"], r["size"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), size.alias("size")).collect()]
    placed = best_fit_decreasing(classes, capacity) if capacity else balance(classes, shards)
    where = spark.createDataFrame([(c, a, b, s) for c, a, b, s in placed], "of long, lo long, hi long, shard int")
    few = len(placed) <= BROADCAST_RUNS
    most = max((n for _, _, n in classes), default=0)
    ranked = with_rank(groups, ["class"], ["digest"], -(-most // RANKED) or 1)
    owner = ranked.join(F.broadcast(where) if few else where, (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(F.col("digest").alias("g"), "shard")
    dealt = rows.join(owner, F.col("digest") == F.col("g")).select("doc_id", "size", "text_crc32", "shard")
    return with_rank(dealt, ["shard"], ["doc_id", "text_crc32"], max(8, rows.count() // RANKED), "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

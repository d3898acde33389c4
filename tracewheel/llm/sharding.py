"""Shards of near-equal size: best-fit-decreasing packing of indivisible groups of equal texts.

Groups are sorted by size and each enters the bin whose remaining capacity is the smallest that
still holds it, found in a balanced tree of remaining capacities. All groups are packed, none is
merged with another: groups of one size are a class, and the driver packs classes. It holds a
row (size, number of groups) a class; the classes of a corpus of B bytes are fewer than
sqrt(2 B), as their sizes differ and add up to B at most, whatever the number of documents. In
a class the tightest bin takes groups until it holds no more, which is what placing them one by
one would do. Which groups of a class go where is settled by their rank, counted in parallel.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewheel.llm.common import chunks_for, only, running_position, stage

SHARDS = 16
#: Groups of more than this part of all rows, fewer than its inverse, are joined by broadcast.
HOT_PART = 1 / 10_000
#: At most so many pieces are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


class CapacityTree:
    """A treap of (remaining capacity, bin): insert and take-the-smallest-that-holds in O(log n) expected."""

    def __init__(self):
        self.root, self.rng = None, random.Random(0)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], high = self._split(node[2], key)
            return node, high
        low, node[1] = self._split(node[1], key)
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[3] > high[3]:
            low[2] = self._merge(low[2], high)
            return low
        high[1] = self._merge(low, high[1])
        return high

    def insert(self, remaining: int, bin_no: int) -> None:
        low, high = self._split(self.root, (remaining, bin_no))
        self.root = self._merge(self._merge(low, [(remaining, bin_no), None, None, self.rng.random()]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the (remaining, bin) of least remaining >= size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        least = high
        while least[1] is not None:
            least = least[1]
        mid, rest = self._split(high, (least[0][0], least[0][1] + 1))
        self.root = self._merge(low, rest)
        return mid[0]


def best_fit_decreasing(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, number) of the groups of each class (size >= 1, number), largest sizes first, in bins of ``capacity``.

    A new bin opens only where none holds a group. None if more than ``most`` bins would open or
    a size is above the capacity. Pieces of a class come in the order in which its groups are placed.
    """
    tree, bins, out = CapacityTree(), 0, []
    for size, number in sorted(classes, reverse=True):
        if size > capacity:
            return None
        while number:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            # The bin that took a group is the tightest of all that still hold one, until it holds no more.
            fits = min(number, found[0] // size)
            out.append((size, found[1], fits))
            number -= fits
            tree.insert(found[0] - fits * size, found[1])
    return out


def near_equal_bins(classes: Iterable[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Packs all classes into ``bins`` bins: (size, bin, number), at a capacity found by bisection.

    A group above the mean of the bins that are left takes a bin of its own, and the mean is
    taken anew of the rest. The capacity of the others is at most 1/1024 of their mean above one
    at which they were tried and did not fit, or is the mean itself.
    """
    left, out, free = sorted(([s, n] for s, n in classes), reverse=True), [], list(range(bins))
    total = sum(s * n for s, n in left)
    at = 0
    while at < len(left) and len(free) > 1 and left[at][0] * len(free) >= total:
        size = left[at][0]
        out.append((size, free.pop(0), 1))
        total -= size
        left[at][1] -= 1
        at += left[at][1] == 0
    rest = [(s, n) for s, n in left[at:]]
    if not rest:
        return out
    mean = -(-total // len(free))
    step = max(1, mean // 1024)
    capacity, failed = max(mean, rest[0][0]), None
    while (found := best_fit_decreasing(rest, capacity, len(free))) is None:
        failed, capacity, step = capacity, capacity + step, 2 * step
    step = max(1, mean // 1024)
    while failed is not None and capacity - failed > step:
        middle = (failed + capacity) // 2
        tried = best_fit_decreasing(rest, middle, len(free))
        failed, capacity, found = (middle, capacity, found) if tried is None else (failed, middle, tried)
    return out + [(s, free[b], n) for s, b, n in found]


def placed_groups(groups: DataFrame, shards: int, capacity: int | None) -> DataFrame:
    """``groups`` (h, size, text_crc32, copies, bytes) with the shard of each."""
    spark = groups.sparkSession
    table = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()  # fewer than sqrt(2 B) rows
    classes = list(zip(table["bytes"].to_pylist(), table["n"].to_pylist(), strict=True))
    put = near_equal_bins(classes, shards) if capacity is None else best_fit_decreasing(classes, capacity)
    if put is None:
        raise ValueError(f"a group of equal texts has {max(s for s, _ in classes)} bytes, above the capacity of {capacity}")
    rows, seen = [], {}
    for size, b, n in put:
        low = seen.get(size, 0)
        rows.append((size, low, low + n, b))
        seen[size] = low + n
    pieces = spark.createDataFrame(rows, "_bytes long, _low long, _high long, shard int")
    order = [F.col("h"), F.col("size"), F.col("text_crc32")]
    ranked = running_position(groups, ["bytes"], order, F.col("h"), F.lit(1), chunks_for(groups.count()), "_rank")
    # A class that a few bins share has a piece for each; sizes of one text, which are most, have one.
    mine = (F.col("bytes") == F.col("_bytes")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    return ranked.join(F.broadcast(pieces) if len(rows) <= BROADCAST_ROWS else pieces, mine).select("h", "size", "text_crc32", "copies", "shard")


def shard(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; law is ``bytes``.

    size: UTF-8 bytes of the text and one more. Rows of equal text share a shard; a null text
    counts as empty. There are ``shards`` of near-equal bytes, or as many of ``capacity`` bytes
    as best-fit-decreasing opens; a group above the capacity is an error. slot counts the rows of
    a shard from 0 without gaps, in the order of (chunk, doc_id, size, crc32), equal rows in any
    order. Rows may repeat; other columns are ignored; an empty table gives an empty one.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = only(docs, doc_id="long", text="string").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"))
    rows = stage(rows, "shard-rows")
    total = rows.count()
    key = ["h", "size", "text_crc32"]
    groups = stage(rows.groupBy(*key).agg(F.count("*").alias("copies"), F.sum("size").alias("bytes")), "shard-groups")
    put = stage(placed_groups(groups, shards, capacity), "shard-placed")
    hot = F.broadcast(put.where(F.col("copies") > HOT_PART * total).select(*key, F.col("shard").alias("own")))
    own = rows.join(hot, key, "left")
    few = own.where("own is null").drop("own").join(put.where(F.col("copies") <= HOT_PART * total).select(*key, "shard"), key)
    placed = own.where("own is not null").withColumnRenamed("own", "shard").unionByName(few).select("doc_id", "size", "text_crc32", "shard")
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    slots = running_position(stage(placed, "shard-own"), ["shard"], order, F.xxhash64("doc_id", "size"), F.lit(1), chunks_for(total), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15; edge cases are those of ``shard``."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

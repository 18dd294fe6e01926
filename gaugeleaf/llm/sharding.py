"""Shards of near equal size, or as few shards of a fixed capacity as best fit finds, with equal texts kept together.

Rows with equal texts are one group, which no shard border cuts. Best-fit decreasing: groups sorted by size, the largest
first, each enter the bin with the least room that still holds them; a balanced tree over the bins' free capacities finds it.

Two levels, so that no task holds all groups. First, groups are dealt by hash into tasks of some 500,000, and in each task
they are packed by best fit into bundles of a small fixed capacity (1 / 1,024 of a shard where shards are few); a group
beyond that is a bundle by itself. Then the bundles, whose number depends on shards and tasks but not on the groups, are packed by best fit
into the shards. For a fixed number of shards, the least capacity is searched that best fit gets by with (as in MULTIFIT); a
bundle above the mean of what is left takes a shard of its own first, so that one hot text does not unbalance the others.

Cases: a null text counts as an empty one, of size 1. Rows that repeat, in part or in full, each get a slot. Null doc_ids
stay null. Ties go by the group's hash. Very long texts are groups like others; a group larger than a fixed capacity has a
shard for itself. With fewer groups than shards some shards stay empty. Other columns are not read. An empty table gives an
empty result.

Size: texts are read once and leave the scan as 36 bytes a row, which go to the shared folder; these rows and the groups are
shuffled by group. Counts of a group are summed before their shuffle, and a hot group's rows are split again in the join, which
needs none of them together. Slots are counted in 32,768 cells at most, dealt by place in the scan and not by any key. Broadcast
and brought to the driver: the bundles, about 1,024 for each of few shards (at least 8 a shard) plus a few for each task of
500,000 groups.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeleaf.llm.common import materialize, table, texts

GROUP = ["h", "text_crc32", "size"]
CELLS = 32_768


class Rooms:
    """Bins by free capacity, in a tree of 64-way nodes whose leaves all lie at one depth: each node has a bit for every branch in use."""

    def __init__(self, most: int):
        self.levels: list[dict[int, int]] = [{} for _ in range(max(1, -(-max(1, most).bit_length() // 6)))]
        self.bins: defaultdict[int, list[int]] = defaultdict(list)

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        if len(self.bins[free]) > 1:
            return
        for level in self.levels:
            place, bit = free >> 6, 1 << (free & 63)
            old = level.get(place, 0)
            level[place] = old | bit
            if old:
                return
            free = place

    def take(self, size: int) -> tuple[int, int] | None:
        """(free, bin) of a bin with the least room of `size` at least, which leaves the tree; None if there is none."""
        key, k = size, 0
        while k < len(self.levels):
            mask = self.levels[k].get(key >> 6, 0) >> (key & 63)
            if mask:
                key += (mask & -mask).bit_length() - 1
                break
            key, k = (key >> 6) + 1, k + 1
        else:
            return None
        for level in reversed(self.levels[:k]):
            mask = level[key]
            key = (key << 6) + (mask & -mask).bit_length() - 1
        bin_ = self.bins[key].pop()
        if not self.bins[key]:
            del self.bins[key]
            self._remove(key)
        return key, bin_

    def _remove(self, free: int) -> None:
        for level in self.levels:
            place = free >> 6
            left = level[place] & ~(1 << (free & 63))
            if left:
                level[place] = left
                return
            del level[place]
            free = place


class Packer:
    """Best fit into bins of one capacity, opened as needed; sizes come largest first. What is larger has a bin for itself."""

    def __init__(self, capacity: int, most: int | None = None):
        self.capacity, self.most, self.opened, self.rooms = capacity, most, 0, Rooms(capacity)

    def put(self, size: int) -> int | None:
        """The bin that takes it; None if no bin does and no more may be opened."""
        found = self.rooms.take(size) if size <= self.capacity else None
        if found is None:
            if self.most is not None and (self.opened == self.most or size > self.capacity):
                return None
            found = (max(size, self.capacity), self.opened)
            self.opened += 1
        free, bin_ = found
        if free > size:
            self.rooms.add(free - size, bin_)
        return bin_


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size, given largest first; None if `most` bins don't do."""
    packer = Packer(capacity, most)
    bins = []
    for size in sizes:
        bins.append(packer.put(size))
        if bins[-1] is None:
            return None
    return bins


def level(sizes: list[int], bins: int) -> list[int]:
    """The bin of each size, given largest first, for sums as equal as best fit makes them."""
    left, alone = sum(sizes), 0
    while alone < min(bins - 1, len(sizes)) and sizes[alone] * (bins - alone) > left:
        left -= sizes[alone]
        alone += 1
    rest, n = sizes[alone:], bins - alone
    if not rest:
        return list(range(alone))
    low = max(-(-left // n), rest[0])
    high = low + rest[0]
    found = best_fit(rest, high, n)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(rest, middle, n)
        if tried is None:
            low = middle + 1
        else:
            high, found = middle, tried
    return list(range(alone)) + [alone + b for b in found]


def _bundled(groups: DataFrame, tasks: int, capacity: int) -> DataFrame:
    """GROUP, total and bundle: groups packed by best fit in each of `tasks` tasks."""

    def fill(batches):
        task, packer = None, None
        for batch in batches:
            bundles = []
            for now, size in zip(batch.column("task").to_pylist(), batch.column("total").to_pylist()):
                if now != task:
                    task, packer = now, Packer(capacity)
                bundles.append((now << 32) + packer.put(size))
            yield pa.record_batch([*(batch.column(c) for c in (*GROUP, "total")), pa.array(bundles, pa.int64())], [*GROUP, "total", "bundle"])

    dealt = groups.withColumn("task", F.pmod("h", F.lit(tasks)).cast("long")).repartition(tasks, "task").sortWithinPartitions("task", F.desc("total"), *GROUP)
    return dealt.mapInArrow(fill, "h long, text_crc32 long, size long, total long, bundle long")


def shards(docs: DataFrame, count: int | None = None, capacity: int | None = None, task_groups: int = 500_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: in `count` shards of near equal size, or in as few as best fit makes of `capacity` bytes.

    A size is the text's bytes in UTF-8 plus 1; slots number the rows of a shard from 0 without gaps.
    """
    if (count is None) == (capacity is None):
        raise ValueError("give either the number of shards or their capacity")
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = texts(docs).select("doc_id", F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text) + 1).cast("long").alias("size"), F.spark_partition_id().alias("part"))
    rows = materialize(rows)
    groups = materialize(rows.groupBy(*GROUP).agg((F.count("*") * F.col("size")).alias("total")))
    n, total = groups.agg(F.count("*"), F.sum("total")).first()
    wanted = count or -(-(total or 0) // capacity) or 1
    fine = max(8, min(1024, 65_536 // wanted))
    packed = materialize(_bundled(groups, max(32, n // task_groups + 1), max(1, (capacity or -(-(total or 0) // wanted)) // fine)))
    bundles = sorted(packed.groupBy("bundle").agg(F.sum("total").alias("total")).collect(), key=lambda r: (-r.total, r.bundle))
    sizes = [r.total for r in bundles]
    bins = level(sizes, count) if count else best_fit(sizes, capacity)
    where = spark.createDataFrame([(r.bundle, b) for r, b in zip(bundles, bins)], "bundle long, shard int")
    placed = packed.join(F.broadcast(where), "bundle").select(*GROUP, "shard")
    rows = materialize(rows.join(placed, GROUP).select("doc_id", "size", "text_crc32", "shard", "part"))
    return _numbered(rows, max(1, CELLS // max([count or 1, *(b + 1 for b in bins)])))


def _numbered(rows: DataFrame, cells: int) -> DataFrame:
    """rows (with shard and part) with slot: counted in each cell of a shard, plus what the cells before hold."""
    rows = rows.withColumn("cell", F.pmod("part", F.lit(cells)))
    held = rows.groupBy("shard", "cell").agg(F.count("*").alias("held"))
    before = held.select("shard", "cell", (F.sum("held").over(Window.partitionBy("shard").orderBy("cell")) - F.col("held")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("own", own).join(F.broadcast(before), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("own") + F.col("before")).alias("slot"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: eight shards of near equal bytes."""
    rows = shards(table(spark, sf_dir, "documents"), count=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Sharding by fixed virtual slots.

A record is hashed into one of SLOTS virtual slots for good. Bytes and rows are summed per slot, and a
versioned slot-to-shard map says where each slot lives. Rebalancing or adding a shard edits the map, never
the hash, so only whole slots move. The law that holds is `bytes`: the shards' sizes are near equal.

Rows alike in key and text have one hash and would fill one slot; where they are more than SALT_ABOVE they are dealt
in blocks to further slots, so that a row repeated without end leaves the shards near equal too.

Only the map (SLOTS entries, whatever the input) passes through the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graywether.llm.tables import Workspace

SLOTS = 4096
#: Rows alike in key and text that stay in one slot; more are dealt in blocks of as many.
SALT_ABOVE = 16
#: A rebalance stops once the largest and the smallest shard differ by less than this share of the mean.
TOLERANCE = 0.002


@dataclass(frozen=True)
class SlotMap:
    """Version n of the map: shard_of[slot] is a shard, or None for a slot that has none yet."""

    version: int
    shards: int
    shard_of: tuple[int | None, ...]
    moved: tuple[int, ...] = field(default=(), compare=False)

    @staticmethod
    def empty(shards: int, slots: int = SLOTS) -> SlotMap:
        return SlotMap(0, shards, (None,) * slots)

    def edited(self, loads: list[int], shards: int | None = None) -> SlotMap:
        """The next version, for these bytes per slot and this number of shards.

        Slots without a shard (new, or of a shard that is gone) go, largest first, to the least loaded shard.
        Then slots move from the fullest to the emptiest shard, each time the one that best evens out the two,
        until they differ by TOLERANCE of the mean or no move helps.
        """
        n = shards or self.shards
        place = [s if s is not None and s < n else None for s in self.shard_of]
        total = [0] * n
        held: list[set[int]] = [set() for _ in range(n)]
        for slot, shard in enumerate(place):
            if shard is not None:
                total[shard] += loads[slot]
                held[shard].add(slot)
        heap = [(total[s], s) for s in range(n)]
        heapq.heapify(heap)
        for slot in sorted((i for i, s in enumerate(place) if s is None), key=lambda i: (-loads[i], i)):
            _, shard = heapq.heappop(heap)
            place[slot] = shard
            total[shard] += loads[slot]
            held[shard].add(slot)
            heapq.heappush(heap, (total[shard], shard))
        moved: set[int] = set()
        most = TOLERANCE * sum(total) / n
        for _ in range(4 * len(place)):
            full = max(range(n), key=lambda s: (total[s], -s))
            low = min(range(n), key=lambda s: (total[s], s))
            gap = total[full] - total[low]
            fits = [i for i in held[full] if 0 < loads[i] < gap]
            if gap <= most or not fits:
                break
            slot = min(fits, key=lambda i: (abs(gap - 2 * loads[i]), i))
            held[full].remove(slot)
            held[low].add(slot)
            total[full] -= loads[slot]
            total[low] += loads[slot]
            place[slot] = low
            moved.add(slot)
        return SlotMap(self.version + 1, n, tuple(place), tuple(sorted(moved)))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """version, slot, shard: the form in which the map is stored."""
        listed = F.split(F.lit(",".join(map(str, self.shard_of))), ",").cast("array<int>")
        return spark.range(1).select(F.lit(self.version).alias("version"), F.posexplode(listed).alias("slot", "shard"))

    def write(self, spark: SparkSession, path: str) -> None:
        """Add this version to the maps stored at path; a version is written once."""
        self.to_frame(spark).drop("version").write.parquet(f"{path}/version={self.version}")

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, or the last: the map that a later run edits."""
        stored = spark.read.schema("slot int, shard int, version int").parquet(path)
        version = stored.agg(F.max("version")).first()[0] if version is None else version
        rows = stored.where(F.col("version") == version).select("slot", "shard").collect()
        shard_of = tuple(s for _, s in sorted(rows))
        return SlotMap(version, max(s for s in shard_of if s is not None) + 1, shard_of)


def _at(values, slot: Column, kind: str) -> Column:
    """values[slot], for a list with one entry per virtual slot."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), slot + 1)


def virtual_slot(key: Column, crc: Column, block: Column, slots: int = SLOTS) -> Column:
    """The record's slot. The text's checksum takes part so that repeats of a key are spread as well, and the block
    of rows alike in both."""
    return F.pmod(F.xxhash64(key.cast("string"), crc, block), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row; a null text has no bytes and the empty text's checksum.

    Rows alike are counted (with map-side sums) and listed again, block by block.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    alike = docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = alike.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    blocks = alike.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / SALT_ABOVE))))
    times = F.least(F.lit(SALT_ABOVE), F.col("n") - F.col("block") * SALT_ABOVE).cast("int")
    slot = virtual_slot(F.col("doc_id"), F.col("text_crc32"), F.col("block"), slots)
    return blocks.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: slots entries, summed by Spark."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return size, count


def shard(docs: DataFrame, shards: int = 24, previous: SlotMap | None = None, maps: str | None = None) -> DataFrame:
    """Place every row of docs (doc_id, text; more columns are ignored) into one of `shards` shards.

    Returns doc_id, size, text_crc32, law, shard, slot (the row's place in its shard, gapless from 0),
    grown_shard (null: the law is `bytes`) and virtual_slot. The map is an edit of previous; it is stored as one more
    version below maps (below the run's own folder if not given), where SlotMap.read finds it.
    Null doc_ids and repeated rows are placed like any other row; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    rows = ws.save(sized(docs), "sized")
    size, count = slot_loads(rows)
    plan = (previous or SlotMap.empty(shards)).edited(size, shards)
    plan.write(docs.sparkSession, maps or f"{ws.path}/slot_map")
    first, start = [0] * shards, [0] * SLOTS
    for slot, s in enumerate(plan.shard_of):
        start[slot] = first[s]
        first[s] += count[slot]
    at = F.col("virtual_slot")
    rank = F.expr("row_number() over (partition by virtual_slot order by doc_id, text_crc32, size)")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        _at(plan.shard_of, at, "int").alias("shard"),
        (_at(start, at, "bigint") + rank - 1).cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        "virtual_slot",
    )

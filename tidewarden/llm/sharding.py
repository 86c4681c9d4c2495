"""Shards through fixed virtual slots, in DataFrame functions only.

Records are hashed by id into ``SLOTS`` virtual slots, a number that never changes. The bytes of each slot are
added up, and a versioned map says which shard holds which slot. The first version places the slots, largest
first, on the shard with the fewest bytes so far. Rebalancing edits the map: a new version moves only as many
slots as needed, and no record is hashed again. The map and the slot sums have ``SLOTS`` rows whatever the size
of the data, so planning on the driver is bounded; records meet the map as a literal array.

A record's position in its shard, gapless from 0, is the number of records in the shard's earlier slots plus its
rank within its own slot, so no task ever sorts a shard.

Defined cases: a null text has no bytes (size 1, crc32 0), a null id is hashed to a slot like any other value.
Rows that repeat an id share its slot; ties within a slot are ordered by crc32 and size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.llm.common import stored

SLOTS = 4096
#: Rebalancing stops when no shard has more than this above the mean.
TOLERANCE = 0.001


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the map: ``shard_of[slot]`` is one of ``shards`` shards."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def shard(self, slot: Column) -> Column:
        return F.get(F.lit(list(self.shard_of)), slot.cast("int"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the table at ``path``, one row per slot; saved again, it replaces itself."""
        slots = spark.range(len(self.shard_of)).select(
            F.lit(self.shards).alias("shards"), F.col("id").alias("slot"), self.shard(F.col("id")).alias("shard")
        )
        slots.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """One version of the table at ``path``, the newest by default."""
        table = spark.read.parquet(path)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).orderBy("slot").collect()
        if not rows or [r["slot"] for r in rows] != list(range(len(rows))):
            raise ValueError(f"{path}: version {version} is not one map of all slots")
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def place(sizes: list[int], shards: int) -> SlotMap:
    """The first version: slots from the largest to the smallest, each to the shard with the fewest bytes."""
    heap = [(0, shard) for shard in range(shards)]
    shard_of = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        total, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (total + sizes[slot], shard))
    return SlotMap(1, shards, tuple(shard_of))


def rebalance(slot_map: SlotMap, sizes: list[int], shards: int | None = None, tolerance: float = TOLERANCE) -> SlotMap:
    """The next version: slots leave shards above the mean for the emptiest shard, the largest that fits first.

    More shards than before start empty and are only filled; with fewer, the slots of those that go are dealt out.
    A slot moves only if that lowers the larger of the two shards.
    """
    shards = shards or slot_map.shards
    shard_of = list(slot_map.shard_of)
    total = [0] * max(shards, slot_map.shards)
    held: list[set[int]] = [set() for _ in total]
    for slot, shard in enumerate(shard_of):
        total[shard] += sizes[slot]
        held[shard].add(slot)

    def move(slot: int, to: int) -> None:
        home = shard_of[slot]
        total[home] -= sizes[slot]
        total[to] += sizes[slot]
        held[home].discard(slot)
        held[to].add(slot)
        shard_of[slot] = to

    for gone in range(shards, len(total)):
        for slot in sorted(held[gone], key=lambda s: (-sizes[s], s)):
            move(slot, min(range(shards), key=lambda x: (total[x], x)))
    mean = sum(sizes) / shards
    while True:
        fullest = max(range(shards), key=lambda x: (total[x], -x))
        emptiest = min(range(shards), key=lambda x: (total[x], x))
        if total[fullest] <= mean * (1 + tolerance):
            break
        room = min(total[fullest] - mean, mean - total[emptiest])
        fitting = [s for s in held[fullest] if 0 < sizes[s] <= room]
        slot = max(fitting, key=lambda s: (sizes[s], -s)) if fitting else min(
            (s for s in held[fullest] if 0 < sizes[s] < total[fullest] - total[emptiest]), key=lambda s: (sizes[s], s), default=None
        )
        if slot is None:
            break
        move(slot, emptiest)
    return replace(slot_map, version=slot_map.version + 1, shards=shards, shard_of=tuple(shard_of))


def slotted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each record."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sums(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and records of each virtual slot: at most ``slots`` rows."""
    size, count = [0] * slots, [0] * slots
    for row in records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        size[row["virtual_slot"]], count[row["virtual_slot"]] = row["size"], row["n"]
    return size, count


def assign(records: DataFrame, slot_map: SlotMap, counts: list[int]) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's position in its shard."""
    before, filled = [0] * len(counts), [0] * slot_map.shards
    for slot, shard in enumerate(slot_map.shard_of):
        before[slot] = filled[shard]
        filled[shard] += counts[slot]
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    first = F.get(F.lit(before).cast("array<bigint>"), F.col("virtual_slot"))
    return records.withColumn("shard", slot_map.shard(F.col("virtual_slot"))).withColumn("slot", first + rank - 1)


def sharded(docs: DataFrame, shards: int = 8, map_path: str | None = None) -> DataFrame:
    """All records by shard, under the law ``bytes``; the map's first version is saved at ``map_path`` if given."""
    records = stored(slotted(docs), "slots")
    sizes, counts = slot_sums(records)
    slot_map = place(sizes, shards)
    if map_path:
        slot_map.save(docs.sparkSession, map_path)
    return assign(records, slot_map, counts).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )

"""Sharding by fixed virtual slots.

A record's text hashes into one of SLOTS slots, so equal texts share one. Bytes are summed for each
slot, and a slot-to-shard map, stored with a version, deals the slots to shards of near equal
bytes. Rebalancing edits the map: it moves the fewest slots that even the shards out, and adds
shards if wanted; records never hash anew.

A text that makes up more than an eighth of a shard's share (one with very many copies) leaves its slot
for one of its own; one above a whole share is spread over several by its records' ids, as no shard
could hold it otherwise. Fewer than eight texts a shard are that heavy, and the map has SLOTS rows and
those of such texts, so it is edited on the driver and used as constants of a query.

Edge cases: NULL text has no bytes and the CRC of an empty one; NULL and repeated ids are
ordinary; an empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from queuelens.llm.common import bucket_count
from queuelens.session import materialize

SLOTS = 4096
#: Bytes that each record takes besides its text.
OVERHEAD = 8
#: A text above this part of a shard's share gets slots of its own.
HEAVY = 1 / 8
BUCKET_ROWS = 2000


@dataclass(frozen=True)
class SlotMap:
    """`shard[i]` holds slot i; slots from `base` on are those of heavy texts."""

    version: int
    base: int
    shards: int
    shard: tuple[int, ...]
    split: tuple[tuple[int, int, int], ...] = ()  # (a heavy text's hash, its first slot, its slots)

    def slot(self, text_hash: Column, id_hash: Column) -> Column:
        slot = F.pmod(text_hash, F.lit(self.base))
        if not self.split:
            return slot
        keys, first, parts = (self._constant(x) for x in zip(*self.split))
        place = F.array_position(keys, text_hash)
        at = F.greatest(place, F.lit(1)).cast("int")
        part = F.element_at(first, at) + F.pmod(id_hash, F.element_at(parts, at))
        return F.when(place > 0, part).otherwise(slot)

    def shard_of(self, slot: Column) -> Column:
        return F.element_at(self._constant(self.shard), (slot + 1).cast("int")).cast("int")

    @staticmethod
    def _constant(values) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def rebalanced(self, bytes_of: dict[int, int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
        """The next version: slots move from shards above the mean to those below, largest that fit first.

        Stops when every shard is within `slack` of the mean, or no move makes the worst one better.
        """
        count = shards or self.shards
        if count < self.shards:
            raise ValueError("shards are only added")
        shard, load = list(self.shard), [0] * count
        held: list[list[int]] = [[] for _ in range(count)]
        for slot, s in enumerate(shard):
            load[s] += bytes_of.get(slot, 0)
            held[s].append(slot)
        mean = sum(load) / count
        while True:
            high, low = max(range(count), key=load.__getitem__), min(range(count), key=load.__getitem__)
            if load[high] <= mean * (1 + slack) and load[low] >= mean * (1 - slack):
                break
            room = min(max(load[high] - mean, 1), load[high] - load[low])
            movable = [x for x in held[high] if 0 < bytes_of.get(x, 0) < load[high] - load[low]]
            if not movable:
                break
            fitting = [x for x in movable if bytes_of[x] <= min(room, max(mean - load[low], 1))]
            slot = max(fitting, key=bytes_of.__getitem__) if fitting else min(movable, key=bytes_of.__getitem__)
            held[high].remove(slot)
            held[low].append(slot)
            shard[slot] = low
            load[high] -= bytes_of[slot]
            load[low] += bytes_of[slot]
        return SlotMap(self.version + 1, self.base, count, tuple(shard), self.split)


def first_map(bytes_of: dict[int, int], shards: int, base: int = SLOTS, split=()) -> SlotMap:
    """Version 1: slots from the heaviest on, each to the lightest shard so far."""
    slots = base + sum(parts for _, _, parts in split)
    heap, shard = [(0, s) for s in range(shards)], [0] * slots
    for slot in sorted(range(slots), key=lambda x: (-bytes_of.get(x, 0), x)):
        load, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (load + bytes_of.get(slot, 0), s))
    return SlotMap(1, base, shards, tuple(shard), tuple(split))


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds the map to the versioned table at `path`; a version is written once."""
    rows = spark.range(1).select(
        F.lit(slot_map.base).alias("base"), F.lit(slot_map.shards).alias("shards"),
        F.lit(",".join(map(str, slot_map.shard))).alias("shard"),
        F.lit(";".join(",".join(map(str, x)) for x in slot_map.split)).alias("split"),
    )
    rows.write.mode("errorifexists").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The given version of the map, or the newest."""
    maps = spark.read.parquet(path)
    maps = maps.where(F.col("version") == version) if version else maps.orderBy(F.desc("version")).limit(1)
    row = maps.first()
    split = tuple(tuple(map(int, x.split(","))) for x in row["split"].split(";") if x)
    return SlotMap(row.version, row.base, row.shards, tuple(map(int, row.shard.split(","))), split)


def record_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash, id_hash): all that sharding needs of a record."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"), F.xxhash64("doc_id", text).alias("id_hash"),
    )


def slot_bytes(records: DataFrame, slot: Column) -> dict[int, int]:
    """Bytes of each slot: one row for each slot reaches the driver."""
    return dict(records.groupBy(slot.alias("slot")).agg(F.sum("size")).collect())


def plan_map(records: DataFrame, shards: int, slots: int = SLOTS) -> SlotMap:
    """The first map for records of `record_sizes`."""
    plain = SlotMap(0, slots, shards, (0,) * slots)
    held = slot_bytes(records, plain.slot(F.col("text_hash"), F.col("id_hash")))
    whole = sum(held.values()) / shards
    # Only a heavy slot holds a heavy text; there are fewer than 8 of either for each shard.
    slots_of_heavy = [slot for slot, size in held.items() if size > whole * HEAVY]
    split, first = [], slots
    if slots_of_heavy:
        texts = records.where(F.pmod("text_hash", F.lit(slots)).isin(slots_of_heavy)).groupBy("text_hash").agg(F.sum("size").alias("size"))
        for r in sorted(texts.where(F.col("size") > whole * HEAVY).collect()):
            parts = -(-r.size * 4 // max(int(whole), 1)) if r.size > whole else 1
            split.append((r.text_hash, first, parts))
            first += parts
    if split:
        held = slot_bytes(records, SlotMap(0, slots, shards, (), tuple(split)).slot(F.col("text_hash"), F.col("id_hash")))
    return first_map(held, shards, slots, split)


def place(records: DataFrame, slot_map: SlotMap, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds virtual_slot, shard and `slot`, the record's place in its shard, gapless from 0.

    Places are counted in buckets of a shard, cut by the hash of the id, and the buckets' counts
    are summed, so that no task numbers a whole shard.
    """
    virtual = slot_map.slot(F.col("text_hash"), F.col("id_hash"))
    shard_rows = F.ceil(F.count("*") / slot_map.shards)
    buckets = records.agg(bucket_count(shard_rows, bucket_rows)).first()[0]
    placed = records.withColumn("virtual_slot", virtual).withColumn("shard", slot_map.shard_of(F.col("virtual_slot")))
    placed = placed.withColumn("bucket", F.pmod(F.col("id_hash"), F.lit(buckets)))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    totals = totals.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inner = Window.partitionBy("shard", "bucket").orderBy("virtual_slot", "id_hash", "doc_id", "text_crc32")
    numbered = placed.withColumn("inner", F.row_number().over(inner) - 1)
    out = numbered.join(totals, ["shard", "bucket"])
    return out.withColumn("slot", (F.col("before") + F.col("inner")).cast("bigint")).drop("before", "inner", "bucket")


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every document's shard and place under a first map; if `map_path` is given, it is stored there and read back."""
    records = materialize(record_sizes(docs), "shard-records")
    slot_map = plan_map(records, shards, slots)
    if map_path:
        save_map(docs.sparkSession, slot_map, map_path)
        slot_map = load_map(docs.sparkSession, map_path, slot_map.version)
    return place(records, slot_map)

"""Operator 9: sharding through fixed virtual slots, with DataFrame functions only.

Every record is hashed into one of SLOTS virtual slots, for good. Bytes and rows are summed by slot, and a
versioned table maps slots to shards: the largest slot goes to the shard that is smallest so far, so that the
shards' bytes are near equal (law ``bytes``). Rebalancing edits the map and nothing else: a new version
moves as few slots as it needs, and with a new shard slots move only into that one.

Records with equal texts share a slot as long as their group is small against a shard. A group with more than
a HOT_SHARE of a shard's fair bytes is spread by row number instead; there are at most shards / HOT_SHARE
such groups, which bounds what is broadcast. The map has SLOTS rows, which bounds what the driver sees.

A record's place in its shard is the number of rows in the slots before its own plus its place in its slot, so
rows are only sorted inside slots.

Defined cases: a null text has no bytes and crc32 0; a null id hashes as such; rows equal in id and text
are rows like any other; no documents give an empty result and a map of empty slots; other columns of the input are never read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tradewind.sources.stages import stage

SLOTS = 4096
ROW_BYTES = 16
#: Share of a shard's fair bytes beyond which a group of equal texts is spread.
HOT_SHARE = 0.1


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and group (a hash of the text) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"),
    )


def hot_groups(rows: DataFrame, shards: int) -> DataFrame:
    """Groups of equal texts with more than HOT_SHARE of a shard's fair bytes: at most shards / HOT_SHARE rows."""
    groups = rows.groupBy("group", "text_crc32").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    return groups.filter(F.col("bytes") > F.lit(total) * HOT_SHARE / shards).select("group", "text_crc32")


def with_slot(rows: DataFrame, hot: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` with virtual slot ``vslot``. A row of a hot group goes by its number in the table, so that rows equal in id and text part as well."""
    marked = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["group", "text_crc32"], "left")
    spread = F.xxhash64(F.lit("row"), "row")
    return marked.withColumn("vslot", F.pmod(F.when(F.col("hot"), spread).otherwise(F.xxhash64(F.lit("group"), "group")), F.lit(slots)).cast("int")).drop("hot", "row")


def slot_loads(slotted: DataFrame) -> list[tuple[int, int, int]]:
    """Slot, bytes and rows of every slot in use; at most as many as there are slots."""
    return [(r["vslot"], r["bytes"], r["rows"]) for r in slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()]


def assign(loads: list[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """First version of the map: by falling bytes, each slot to the smallest shard so far."""
    out = [s % shards for s in range(slots)]
    heap = [(0, shard) for shard in range(shards)]
    for slot, size, _ in sorted(loads, key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (total + size, shard))
    return out


def grow(slot_map: list[int], loads: list[tuple[int, int, int]], shards: int) -> list[int]:
    """Next version for one more shard: the largest shards give slots to the new one until it has its fair share."""
    size = {slot: b for slot, b, _ in loads}
    owned: dict[int, list[int]] = {s: [] for s in range(shards)}
    totals = dict.fromkeys(range(shards), 0)
    for slot, shard in enumerate(slot_map):
        owned[shard].append(slot)
        totals[shard] += size.get(slot, 0)
    for slots in owned.values():
        slots.sort(key=lambda s: (-size.get(s, 0), s))
    fair, filled, out = sum(totals.values()) / (shards + 1), 0, list(slot_map)
    while True:
        giver = max(totals, key=lambda s: (totals[s], -s))
        fits = next((s for s in owned[giver] if 0 < size.get(s, 0) <= min(fair - filled, totals[giver] - fair)), None)
        if fits is None:
            return out
        owned[giver].remove(fits)
        totals[giver] -= size[fits]
        filled += size[fits]
        out[fits] = shards


def map_table(spark: SparkSession, slot_map: list[int], loads: list[tuple[int, int, int]], version: int) -> DataFrame:
    """The map as a table: version, vslot, shard, bytes and rows of the slot, and rows of the shard's slots before it."""
    size, rows = {s: b for s, b, _ in loads}, {s: n for s, _, n in loads}
    before, first = {}, []
    for slot, shard in enumerate(slot_map):
        first.append(before.get(shard, 0))
        before[shard] = before.get(shard, 0) + rows.get(slot, 0)

    def column(values: list[int], kind: str) -> Column:
        return F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("vslot") + 1)

    slots = spark.range(0, len(slot_map), 1, 1).select(F.lit(version).alias("version"), F.col("id").cast("int").alias("vslot"))
    return slots.withColumns({
        "shard": column(slot_map, "int"), "bytes": column([size.get(s, 0) for s in range(len(slot_map))], "bigint"),
        "rows": column([rows.get(s, 0) for s in range(len(slot_map))], "bigint"), "first_slot": column(first, "bigint"),
    })


def store_map(table: DataFrame, folder: str) -> None:
    """Add one version to the folder of maps; versions are never changed."""
    table.write.mode("errorifexists").parquet(f"{folder}/map-{table.first()['version']}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/map-{version}")


def shard(docs: DataFrame, folder: str, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard (null: law ``bytes``) and vslot of every row.

    Stores version 1 of the map under ``folder`` and reads it back.
    """
    spark = docs.sparkSession
    rows = records(docs)
    slotted = stage(with_slot(rows, hot_groups(rows, shards), slots), "shard-slots")  # row numbers are taken once
    loads = slot_loads(slotted)
    store_map(map_table(spark, assign(loads, shards, slots), loads, 1), folder)
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "group")) - 1
    placed = slotted.withColumn("place", place).join(F.broadcast(load_map(spark, folder, 1).select("vslot", "shard", "first_slot")), "vslot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )

"""Sharding by fixed virtual slots.

A record hashes into one of a few thousand slots that never change; bytes are summed per slot, and a small versioned table
maps slots to shards. Rebalancing or growing edits that table (moving as few slots as it needs to), never the hash, so a
new version tells exactly which records move.

Cases: a null text counts as empty (size 1, crc32 0); a null id hashes as null together with its text; repeated rows fall
into the same slot and get different places, but rows that are repeated more than SAME times are told apart by a number that
is written beside them, so that they spread over all slots like any others; an empty table gives an empty result; other columns
of the input are kept out of the way (internal columns begin with two underscores), and columns of the input that are named
like a result column are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgrid.llm.common import saved, scratch, shielded, small, table

#: Virtual slots, and the parts into which each is dealt for numbering: bounds of every table that is collected or broadcast.
SLOTS = 4096
PARTS = 4
#: Rows of one id and crc32 that may share a slot.
SAME = 50
MAP_SCHEMA = "version int, slot int, shard int, bytes long"
ADDED = ("size", "text_crc32", "virtual_slot", "map_version", "shard", "slot")


def virtual_slot(doc_id: Column, text_crc32: Column, row: Column) -> Column:
    """The record's slot: its id and text decide, so that null or repeated ids don't gather in one slot; row (mostly null) tells much repeated rows apart."""
    return F.pmod(F.xxhash64(doc_id, text_crc32, row), F.lit(SLOTS)).cast("int")


def initial_map(shards: int) -> dict[int, int]:
    return {slot: slot % shards for slot in range(SLOTS)}


def rebalance(slot_shard: dict[int, int], slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """The map with slots moved, then swapped, from the fullest to the emptiest shard while that narrows the gap between them.

    Works on the slot table alone (SLOTS rows), whatever the number of records.
    """
    slot_shard = dict(slot_shard)
    held: list[dict[int, int]] = [{} for _ in range(shards)]
    for slot, shard in slot_shard.items():
        if slot_bytes.get(slot):
            held[shard][slot] = slot_bytes[slot]
    load = [sum(x.values()) for x in held]
    for _ in range(4 * SLOTS):
        most, least = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[most] - load[least]
        # moving b bytes leaves a gap of |gap - 2b|
        best = min(((abs(gap - 2 * b), slot, None) for slot, b in held[most].items() if b < gap), default=(gap, -1, None))
        if best[0] > gap // 50:
            give, take = sorted((b, s) for s, b in held[most].items()), sorted((b, s) for s, b in held[least].items())
            i = 0
            for b, slot in give:
                while i < len(take) and take[i][0] < b - gap / 2:
                    i += 1
                for other in take[max(0, i - 1) : i + 1]:
                    if 0 < b - other[0] < gap:
                        best = min(best, (abs(gap - 2 * (b - other[0])), slot, other[1]), key=lambda x: (x[0], x[1]))
        if best[0] >= gap or best[1] < 0:
            break
        _, slot, back = best
        moves = [(slot, most, least)] + ([(back, least, most)] if back is not None else [])
        for s, a, b in moves:
            held[b][s] = held[a].pop(s)
            load[a] -= held[b][s]
            load[b] += held[b][s]
            slot_shard[s] = b
    return slot_shard


def grow(slot_shard: dict[int, int], slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """The map with one more shard: slots move into the new shard only, from the fullest shards, until it holds its share."""
    slot_shard, share, got = dict(slot_shard), sum(slot_bytes.values()) / (shards + 1), 0
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in sorted(slot_shard.items()):
        load[shard] += slot_bytes.get(slot, 0)
        heapq.heappush(held[shard], (slot_bytes.get(slot, 0), slot))
    while got < share:
        most = max(range(shards), key=lambda s: (load[s], -s))
        small = [heapq.heappop(held[most])] if held[most] else []
        if not small or got + small[0][0] > 2 * share:
            break
        size, slot = small[0]
        slot_shard[slot], got, load[most] = shards, got + size, load[most] - size
    return slot_shard


class SlotMap:
    """The stored slot-to-shard map: a table of (version, slot, shard, bytes), to which each edit appends a version."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark)

    def append(self, version: int, slot_shard: dict[int, int], slot_bytes: dict[int, int]) -> None:
        rows = [(version, slot, shard, slot_bytes.get(slot, 0)) for slot, shard in sorted(slot_shard.items())]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def versions(self) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(self.path)

    def version(self, version: int | None = None) -> DataFrame:
        """One version, the latest if none is named."""
        if version is None:
            version = self.versions().agg(F.max("version")).first()[0]
        return self.versions().where(F.col("version") == version)


@shielded
def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """docs with size, text_crc32, virtual_slot, map_version, shard and slot (the row's place in its shard, gapless from 0).

    Version 1 of the stored map deals slots out evenly; version 2 is edited to even out the bytes that were counted.
    """
    spark = docs.sparkSession
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    added = {"__size": size, "__crc": F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0))}
    keyed = docs.withColumns(added)
    same = saved(keyed.groupBy(F.col(doc_id).alias("__id"), F.col("__crc").alias("__own")).count().where(F.col("count") > SAME).select("__id", "__own"))
    if same.isEmpty():
        keyed = keyed.withColumn("__row", F.lit(None).cast("long"))
    else:  # the numbers must stay as they are, so they are written
        keyed = saved(docs.withColumn("__number", F.monotonically_increasing_id())).withColumns(added)
        keyed = keyed.join(small(same), (F.col("__crc") == F.col("__own")) & F.col(doc_id).eqNullSafe(F.col("__id")), "left")
        keyed = keyed.withColumn("__row", F.when(F.col("__own").isNotNull(), F.col("__number")))
    keyed = keyed.withColumns({
        "__slot": virtual_slot(F.col(doc_id), F.col("__crc"), F.col("__row")),
        "__part": F.pmod(F.xxhash64(F.lit(7), F.col(doc_id), F.col("__crc"), F.col("__row")), F.lit(PARTS)).cast("int"),
    })
    # SLOTS * PARTS rows at most
    cells = {(r[0], r[1]): (r[2], r[3]) for r in keyed.groupBy("__slot", "__part").agg(F.sum("__size"), F.count("*")).collect()}
    slot_bytes: dict[int, int] = {}
    for (slot, _), (size_sum, _) in cells.items():
        slot_bytes[slot] = slot_bytes.get(slot, 0) + size_sum
    store, first = SlotMap(spark, path), initial_map(shards)
    store.append(1, first, slot_bytes)
    store.append(2, rebalance(first, slot_bytes, shards), slot_bytes)
    latest = {r["slot"]: (r["version"], r["shard"]) for r in store.version().collect()}
    before, rows = [0] * shards, []
    for (slot, part), (_, n) in sorted(cells.items()):
        version, to = latest[slot]
        rows.append((slot, part, version, to, before[to]))
        before[to] += n
    offsets = spark.createDataFrame(rows, "__slot int, __part int, map_version int, shard int, __before long")
    place = Window.partitionBy("__slot", "__part").orderBy(doc_id, "__crc", "__size", "__row")
    clash = [c for c in ADDED if c in docs.columns]
    return (
        keyed.drop(*clash).withColumn("__at", F.row_number().over(place))
        .join(F.broadcast(offsets), ["__slot", "__part"])
        .withColumns({"size": F.col("__size"), "text_crc32": F.col("__crc"), "virtual_slot": F.col("__slot"), "slot": (F.col("__before") + F.col("__at") - 1).cast("long")})
        .select(*(c for c in docs.columns if c not in clash), *ADDED)
    )


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, evened out by bytes."""
    # no column of the result needs the text, so none of it is shuffled
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )

"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's virtual slot is a hash of its id and never changes.  Bytes and rows
are summed per slot (combined before the shuffle); the map gives every slot a
shard so that the shards' bytes are near equal (largest slot first, to the
lightest shard).  A map is a small table (version, slot, shard, bytes) stored as
Parquet; rebalancing edits the latest version, moving only the slots that bring
the shards back to balance, and stores the result as the next version.  A map
has as many rows as there are slots, a parameter, whatever the input's size.

Law: ``bytes`` (sizes near equal).  Records of a slot stay together, so the
shards differ by less than the heaviest slot.

Defined results: null text counts 0 bytes.  A null id is hashed by its text, so
that such rows spread; rows that share an id share a slot.  Places (``slot`` of
the query) number each shard's rows from 0 by (virtual slot, id, checksum).
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mercato.llm.common import table, written
from mercato.session import ensure_checkpoint_dir

SLOTS = 8192
SHARDS = 40
OVERHEAD = 16
_MAP = "version int, virtual_slot int, shard int, bytes long, rows long"


def virtual_slot(id_col: str, text_col: str, slots: int = SLOTS) -> Column:
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("null id"), text_col)).otherwise(F.xxhash64(F.lit("id"), id_col))
    return F.pmod(key, F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of records with ``virtual_slot`` and ``size``."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sizes: DataFrame, shards: int = SHARDS) -> list[tuple[int, int, int, int, int]]:
    """Version 1: slots by falling bytes, each to the shard that is lightest so far."""
    heap = [(0, 0, s) for s in range(shards)]
    out = []
    for row in sorted(sizes.collect(), key=lambda r: (-r.bytes, r.virtual_slot)):  # at most one row per slot
        load, n, shard = heapq.heappop(heap)
        out.append((1, row.virtual_slot, shard, row.bytes, row.rows))
        heapq.heappush(heap, (load + row.bytes, n + 1, shard))
    return out


def edited_map(old: list[tuple[int, int, int, int, int]], sizes: DataFrame, shards: int) -> list[tuple[int, int, int, int, int]]:
    """The next version after growth or new shards: moves slots from heavy to light shards until no move helps."""
    now = {r.virtual_slot: (r.bytes, r.rows) for r in sizes.collect()}
    where = {slot: shard for _, slot, shard, _, _ in old if shard < shards}
    load, held = [0] * shards, [[] for _ in range(shards)]
    loose = []
    for slot, (size, _) in now.items():
        if slot in where:
            load[where[slot]] += size
            held[where[slot]].append((size, slot))
        else:
            loose.append((size, slot))
    for size, slot in sorted(loose, reverse=True):
        to = min(range(shards), key=lambda s: (load[s], s))
        where[slot] = to
        load[to] += size
        held[to].append((size, slot))
    for slots in held:
        slots.sort()
    while True:
        heavy, light = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[heavy] - load[light]
        fit = [x for x in held[heavy] if 0 < x[0] < gap]
        if not fit:
            break
        size, slot = min(fit, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        held[heavy].remove((size, slot))
        held[light].append((size, slot))
        held[light].sort()
        where[slot] = light
        load[heavy] -= size
        load[light] += size
    version = 1 + max((v for v, *_ in old), default=0)
    return [(version, slot, where[slot], *now[slot]) for slot in sorted(now)]


def save_map(spark: SparkSession, rows: list[tuple[int, int, int, int, int]], folder: str) -> DataFrame:
    """Stores a version beside the earlier ones and returns it."""
    version = rows[0][0] if rows else 0
    spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version:06d}")
    return load_map(spark, folder, version)


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP).parquet(f"{folder}/version={version:06d}")


def records_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, checksum and virtual slot of every row; the text itself is not shuffled."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
                       virtual_slot(id_col, text_col, slots).alias("virtual_slot"))


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot (gapless place in the shard).

    Rows are numbered within their virtual slot, a small part of the input, and slots are offset within
    their shard by a window over the map.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), "version")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (records.withColumn("n", F.row_number().over(inside) - 1)
            .join(F.broadcast(offsets), "virtual_slot")  # one row per slot, a fixed number
            .withColumn("slot", (F.col("offset") + F.col("n")).cast("long")).drop("offset", "n"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, version, slot; the map used is stored below ``folder``."""
    import uuid
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    records = written(records_of(docs, slots=slots), "shard-records")
    return placed(records, save_map(spark, first_map(slot_sizes(records), shards), folder))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard (0 to 39) by size-balanced virtual slots, with its place in the shard."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))

"""Fixed virtual slots: records are hashed into thousands of slots, and a versioned map says which shard has a slot.

A record's slot depends on its id alone and never changes; only the map is edited. ``balanced`` makes the first map from the bytes of the slots,
``rebalanced`` edits one when bytes or the number of shards have changed, moving few slots. A slot that alone would take more than half of
a shard's share (one id may hold a third of all rows) is split into pieces by row; there are at most two such slots to a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, shared_dir, written
from .ordering import numbered

SLOTS, SHARDS = 4096, 24
#: What a record takes besides its text.
OVERHEAD = 8
#: A split slot has pieces of about so many to a shard's share.
PIECES = 16

Slot = tuple[int, int]  # slot, piece


def virtual_slot(record_id: Column, slots: int = SLOTS) -> Column:
    """0 to ``slots`` - 1 by md5 of the decimal id; a null id counts as an empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(record_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def balanced(loads: Mapping[Slot, int], shards: int) -> dict[Slot, int]:
    """Heaviest slot first, each to the shard with the fewest bytes (ties: the smallest number)."""
    heap, out = [(0, s) for s in range(shards)], {}
    for slot, size in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + size, shard))
    return out


def rebalanced(current: Mapping[Slot, int], loads: Mapping[Slot, int], shards: int, tolerance: float = 0.01) -> dict[Slot, int]:
    """``current`` edited. New slots and those of shards that are gone go to the shard with the fewest bytes. Then single slots move from the fullest shard
    to the emptiest while that levels the two, until both are within ``tolerance`` of the mean. Where shards were added, slots move only into these."""
    held, of = [0] * shards, {s: {} for s in range(shards)}
    homeless = []
    for slot, size in loads.items():
        shard = current.get(slot, shards)
        if shard >= shards:
            homeless.append((size, slot))
        else:
            held[shard] += size
            of[shard][slot] = size
    for size, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
        shard = held.index(min(held))
        held[shard] += size
        of[shard][slot] = size
    added = range(max(current.values(), default=shards) + 1, shards)
    takers, mean = list(added) or list(range(shards)), sum(held) / shards
    while True:
        full, empty = held.index(max(held)), min(takers, key=held.__getitem__)
        gap = held[full] - held[empty]
        level = held[empty] >= mean * (1 - tolerance) and (added or held[full] <= mean * (1 + tolerance))
        fits = [] if level else [(abs(gap - 2 * size), slot) for slot, size in of[full].items() if 0 < size < gap]  # each such move lowers the sum of squares
        if not fits:
            return {slot: shard for shard, slots in of.items() for slot in slots}
        slot = min(fits)[1]
        size = of[full].pop(slot)
        of[empty][slot] = size
        held[full] -= size
        held[empty] += size


def write_map(spark: SparkSession, folder: str, version: int, slots: Mapping[Slot, int]) -> DataFrame:
    """Stores a version of the map beside the earlier ones and reads it back. A version is never overwritten."""
    rows = [(slot, piece, shard) for (slot, piece), shard in sorted(slots.items())]
    spark.createDataFrame(rows, "virtual_slot int, piece int, shard int").coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")
    return read_map(spark, folder, version)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, piece, shard, version) of a version, the newest by default."""
    versions = spark.read.schema("virtual_slot int, piece int, shard int, version int").option("basePath", folder).parquet(folder)
    return versions.where(F.col("version") == (version if version is not None else versions.agg(F.max("version")).head()[0]))


def as_dict(slots: DataFrame) -> dict[Slot, int]:
    """A map on the driver: as many entries as slots, and pieces of at most two slots to a shard."""
    return {(r["virtual_slot"], r["piece"]): r["shard"] for r in slots.collect()}


def _loads(records: DataFrame) -> dict[Slot, int]:
    return {(r[0], r[1]): r[2] for r in records.groupBy("virtual_slot", "piece").agg(F.sum("size")).collect()}


class Sharding:
    """Where the records of a table go. ``placed`` has their columns with virtual_slot, piece, shard and map version; ``maps`` is the folder of the map's versions."""

    def __init__(self, records: DataFrame, id_column: str, size: str, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None):
        spark = records.sparkSession
        self.maps, self.shards, self.slots = folder or f"{shared_dir(spark)}/slot_map", shards, slots
        records = written(records.withColumns({"virtual_slot": virtual_slot(F.col(id_column), slots), "size": F.col(size)}), "records")
        loads = {r[0]: (r[1], r[2]) for r in records.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}
        total = sum(b for b, _ in loads.values())
        heavy = {slot: min(rows, -(-size * PIECES * shards // total)) for slot, (size, rows) in loads.items() if rows > 1 and 2 * shards * size > total}
        # every row of a split slot by its place in the written table: rows that are all alike go apart too
        pieces = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair]), F.col("virtual_slot")), F.lit(1)) if heavy else F.lit(1)
        self.records = records.withColumn("piece", F.pmod(F.xxhash64(F.monotonically_increasing_id()), pieces).cast("int"))
        self.loads = _loads(self.records) if heavy else {(slot, 0): size for slot, (size, _) in loads.items()}
        write_map(spark, self.maps, 1, balanced(self.loads, shards))

    def edit(self, shards: int, loads: Mapping[Slot, int] | None = None) -> DataFrame:
        """The next version of the map, for other bytes or another number of shards."""
        spark = self.records.sparkSession
        newest = read_map(spark, self.maps)
        version = newest.agg(F.max("version")).head()[0]
        return write_map(spark, self.maps, version + 1, rebalanced(as_dict(newest), loads or self.loads, shards))

    def placed(self, version: int | None = None) -> DataFrame:
        slots = read_map(self.records.sparkSession, self.maps, version)
        return self.records.join(F.broadcast(slots), ["virtual_slot", "piece"])  # at most SLOTS rows and the pieces


def write_shards(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS) -> Sharding:
    """Whole rows (struct ``row``) as Parquet under ``folder``/shard=n, a slot's rows together; the map's versions under ``folder``_map."""
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + OVERHEAD
    plan = Sharding(docs.select(F.col(id_column).alias("id"), F.struct("*").alias("row"), size.alias("bytes")), "id", "bytes", shards, folder=f"{folder}_map")
    plan.placed().select("shard", "virtual_slot", "piece", "row").repartitionByRange("shard", "virtual_slot", "piece").write.partitionBy("shard").parquet(folder)
    return plan


def document_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) of every row.

    The law is ``bytes``: sizes of the shards are near equal. ``slot`` is the row's place in its shard, by virtual slot and doc_id, null first; rows with
    one doc_id stand by size and crc32. A null text has no bytes, so size 8 and crc32 0. Repeated rows have places of their own. Texts themselves
    are read once and not shuffled. An empty table has no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = Sharding(rows, "doc_id", "bytes", shards).placed()
    placed = placed.select("shard", "virtual_slot", "piece", "doc_id", "size", "text_crc32", F.col("version").alias("map_version"))
    law, none = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    ordered = numbered(placed, "shard", ["virtual_slot", "piece", "doc_id", "size", "text_crc32"], "shards")
    return ordered.select("doc_id", "size", "text_crc32", law, "shard", F.col("pos").alias("slot"), none, "virtual_slot", "map_version")


#: Rows of the tables have different doc_ids and no slot takes half a share, so the SQL has no pieces.
SQL = f"""WITH RECURSIVE rows AS (SELECT doc_id, coalesce(strlen(text), 0) + {OVERHEAD} AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SLOTS})::INTEGER AS virtual_slot FROM documents),
slots AS MATERIALIZED (SELECT virtual_slot, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS k FROM rows GROUP BY virtual_slot),
dealt AS (SELECT 0::BIGINT AS k, NULL::INTEGER AS virtual_slot, 0::BIGINT AS shard, list_transform(range({SHARDS}), lambda i: 0::BIGINT) AS held
  UNION ALL SELECT s.k, s.virtual_slot, list_position(d.held, list_min(d.held)) - 1, list_transform(d.held, lambda h, i: h + CASE WHEN i = list_position(d.held, list_min(d.held)) THEN s.bytes ELSE 0 END)
  FROM dealt d JOIN slots s ON s.k = d.k + 1)
SELECT r.doc_id, r.size, r.text_crc32, 'bytes' AS law, d.shard::INTEGER AS shard, row_number() OVER (PARTITION BY d.shard ORDER BY r.virtual_slot, r.doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard, r.virtual_slot, 1 AS map_version
FROM rows r JOIN dealt d USING (virtual_slot)"""

"""Sharding by fixed virtual slots.

A record's key hashes to one of a few thousand slots; a stored, versioned map says which shard owns each slot.
The bytes of each slot are summed over all records, and rebalancing edits the map by them, never the hash: only
slots that the edit names move, and every version stays readable."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import reject_clash, shared_folder, stored, text_or_empty

SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key; a null key has a slot like any other."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """One version of the map. owners[v] is the shard of virtual slot v, so its size is the number of
    slots, whatever the data."""

    version: int
    shards: int
    owners: tuple[int, ...]

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        if not 0 < shards <= slots:
            raise ValueError("there must be from one shard up to one for each slot")
        return cls(1, shards, tuple(v % shards for v in range(slots)))

    def grown(self) -> SlotMap:
        """The next version with one more shard. Each old shard gives up slots until the new one has its
        even part; what moves depends on the map alone, so key and number of shards still decide."""
        owned = defaultdict(list)
        for v, shard in enumerate(self.owners):
            owned[shard].append(v)
        owners, new = list(self.owners), self.shards
        for _ in range(len(owners) // (new + 1)):
            fullest = max(range(new), key=lambda s: (len(owned[s]), -s))
            owners[owned[fullest].pop()] = new
        return SlotMap(self.version + 1, new + 1, tuple(owners))

    def rebalanced(self, slot_bytes: dict[int, int], tolerance: float = 0.0) -> SlotMap:
        """The next version after moving single slots from the largest to the smallest shard, as long as
        that brings the two nearer to each other and the largest is off its even part by tolerance.
        slot_bytes: what sizes() gives, collected; it has a row per slot at most."""
        load, owned = [0] * self.shards, defaultdict(list)
        for v, shard in enumerate(self.owners):
            load[shard] += slot_bytes.get(v, 0)
            owned[shard].append(v)
        owners, even = list(self.owners), sum(load) / self.shards
        for _ in range(4 * len(owners)):
            high, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[high] - load[low]
            movable = [v for v in owned[high] if 0 < slot_bytes.get(v, 0) < gap]
            if load[high] <= even * (1 + tolerance) or not movable:
                break
            v = min(movable, key=lambda v: (abs(slot_bytes[v] - gap / 2), v))
            owned[high].remove(v)
            owned[low].append(v)
            owners[v] = low
            load[high] -= slot_bytes[v]
            load[low] += slot_bytes[v]
        return SlotMap(self.version + 1, self.shards, tuple(owners))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, v, s) for v, s in enumerate(self.owners)], "version int, vslot int, shard int")


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Adds a version to the table at path; earlier versions stay readable."""
    slot_map.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """A version of the stored map, the latest one unless named; None where none is stored."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = table.agg(F.max("version")).first()[0] if version is None else version
    owners = [r.shard for r in table.where(F.col("version") == version).orderBy("vslot").collect()]
    return SlotMap(version, max(owners) + 1, tuple(owners))


def sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot, from a frame with vslot and size. Sums before the shuffle, so
    a hot slot costs a row per task."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def _rows(docs: DataFrame, key: str, text: str, slots: int) -> DataFrame:
    body = F.encode(text_or_empty(F.col(text)), "UTF-8")
    return reject_clash(docs, key, text).select(F.col(key), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), slot_of(F.col(key), slots).alias("vslot"))


def _is_measured(docs: DataFrame, key: str) -> bool:
    return docs.columns == [key, "size", "text_crc32", "vslot"]


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, vslot of each row of docs, stored: what balance() and shard() need, so that texts are
    read once for both."""
    return stored(_rows(docs, key, text, slots), "measured")


def balance(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = 16, slots: int = SLOTS) -> SlotMap:
    """Edits the map stored at path by the bytes that docs have in each slot, stores the edited version beside the
    earlier ones and returns it. Where none is stored yet, the first version deals the slots out in turn. docs may be
    measured() ones."""
    spark = docs.sparkSession
    current = load_map(spark, path)
    if current is None:
        current = SlotMap.first(shards, slots)
        save_map(spark, current, path)
    # A row per virtual slot at most.
    of = {r.vslot: r.slot_bytes for r in sizes(docs if _is_measured(docs, key) else _rows(docs, key, text, len(current.owners))).collect()}
    save_map(spark, current.rebalanced(of), path)
    return load_map(spark, path)


def shard(docs: DataFrame, slot_map: SlotMap, law: str, grown: SlotMap | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each record's shard, and its place there: `slot` counts every shard's rows from 0 without a gap. law: what
    the map keeps, `key` or `bytes`; it is only told on.

    One row per row of docs; a null key is a key like any other, a null text has size 1, and an empty
    table gives an empty one. docs may be measured() ones. Rows that repeat a key share its shard and get places of their own. Other
    columns of docs are not read."""
    if grown and len(grown.owners) != len(slot_map.owners):
        raise ValueError("both versions must have the same slots")
    spark = docs.sparkSession
    rows = docs if _is_measured(docs, key) else measured(docs, key, text, len(slot_map.owners))
    owners = slot_map.frame(spark).select("vslot", "shard")
    if grown:
        owners = owners.join(grown.frame(spark).select("vslot", F.col("shard").alias("grown_shard")), "vslot")
    # A row per virtual slot: bounded by the map.
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes(rows).join(F.broadcast(owners), "vslot").withColumn("start", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)))
    within = Window.partitionBy("vslot").orderBy(key, "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(starts), "vslot")
        .select(
            key, "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("start") + F.col("nth") - 1).alias("slot"),
            (F.col("grown_shard") if grown else F.lit(None).cast("int")).alias("grown_shard"), "vslot", "slot_bytes", F.lit(slot_map.version).alias("map_version"),
        )
    )


def op4_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, by a stored map that their slots' bytes have edited."""
    rows = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shard(rows, balance(rows, shared_folder(spark, "slot-map")), "bytes")

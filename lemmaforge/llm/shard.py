"""Sharding by fixed virtual slots.

A record's id, crc and size decide its virtual slot (a hash into thousands of slots, fixed for the life of the data set).
Bytes and rows are summed by slot; a versioned map says which shard holds each slot. A map is never recomputed for new
data: it is edited by moving slots, to level bytes (`rebalance`) or to fill one more shard (`grow`), and stored as the
next version, in a folder of its own: of two runs that edit one map at once the later raises. Only slot sums, a fixed number of rows, reach the driver; only the map, as many rows, is broadcast.

Law of the query: `bytes`. Version 1 deals the slots out in turn; `rebalance` edits it by the sums of the records until
the fullest shard has no slot lighter than its distance to the emptiest, and records are placed by the version that is
read back. With `map_path` the stored map is kept and edited from run to run. Copies of one text spread by their ids.

Defined cases: null text has no bytes, so size 1; null ids and repeated ids spread by crc and size; rows that are equal
in all three spread by a salt, drawn once and stored with the records; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lemmaforge.session import cut, exists, fresh_path

SLOTS = 4096
MAP_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("version", T.IntegerType()), ("virtual_slot", T.IntegerType()), ("shard", T.IntegerType()), ("bytes", T.LongType()), ("rows", T.LongType()))])


@dataclass(frozen=True)
class SlotMap:
    """Shard, bytes and rows of every slot, at one version."""

    version: int
    shard: tuple[int, ...]
    bytes: tuple[int, ...]
    rows: tuple[int, ...]

    @property
    def shards(self) -> int:
        return max(self.shard, default=-1) + 1

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for s, b in zip(self.shard, self.bytes, strict=True):
            out[s] += b
        return out

    def edited(self, shard: list[int]) -> SlotMap:
        return SlotMap(self.version + 1, tuple(shard), self.bytes, self.rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, i, s, b, n) for i, (s, b, n) in enumerate(zip(self.shard, self.bytes, self.rows, strict=True))]
        return spark.createDataFrame(rows, MAP_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version to a folder of its own; older versions stay, and a version that is there already raises."""
        self.frame(spark).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the last one unless it is named. One that does not hold each slot from 0 exactly once raises."""
        table = spark.read.schema(MAP_SCHEMA).parquet(path)
        version = version if version is not None else table.agg(F.max("version")).first()[0]
        got = table.filter(F.col("version") == version).orderBy("virtual_slot").collect()  # one row a slot
        if not got or [r["virtual_slot"] for r in got] != list(range(len(got))):
            raise ValueError(f"version {version} of {path} does not hold each slot once")
        return SlotMap(version, tuple(r["shard"] for r in got), tuple(r["bytes"] for r in got), tuple(r["rows"] for r in got))


def deal(bytes_by_slot: list[int], rows_by_slot: list[int], shards: int) -> SlotMap:
    """Version 1: slots by decreasing bytes, each to the shard with the fewest bytes so far."""
    heap, where = [(0, s) for s in range(shards)], [0] * len(bytes_by_slot)
    for slot in sorted(range(len(where)), key=lambda i: (-bytes_by_slot[i], i)):
        load, s = heapq.heappop(heap)
        where[slot] = s
        heapq.heappush(heap, (load + bytes_by_slot[slot], s))
    return SlotMap(1, tuple(where), tuple(bytes_by_slot), tuple(rows_by_slot))


def in_turn(bytes_by_slot: list[int], rows_by_slot: list[int], shards: int) -> SlotMap:
    """Version 1 without a look at the bytes: every shard holds equally many slots."""
    return SlotMap(1, tuple(i % shards for i in range(len(bytes_by_slot))), tuple(bytes_by_slot), tuple(rows_by_slot))


def grow(old: SlotMap) -> SlotMap:
    """One more shard: slots move from the fullest shards into the new one only, until it has its share."""
    new, where, load = old.shards, list(old.shard), [*old.loads(), 0]
    share = sum(load) / (new + 1)
    for slot in sorted(range(len(where)), key=lambda i: (-old.bytes[i], i)):
        b, s = old.bytes[slot], where[slot]
        if load[s] - b >= share * 0.98 and load[new] + b <= share * 1.01:
            where[slot], load[s], load[new] = new, load[s] - b, load[new] + b
    return old.edited(where)


def rebalance(old: SlotMap, bytes_by_slot: list[int], rows_by_slot: list[int], slack: float = 0.02) -> SlotMap:
    """Level changed sizes with few moves: from the fullest to the emptiest shard while one is over `slack` off.

    Without slack it ends when no slot of the fullest shard is lighter than the distance to the emptiest.
    """
    now = SlotMap(old.version, old.shard, tuple(bytes_by_slot), tuple(rows_by_slot))
    where, load = list(old.shard), now.loads()
    share = sum(load) / max(1, len(load))
    held: list[list[tuple[int, int]]] = [[] for _ in load]
    for slot, s in enumerate(where):
        held[s].append((bytes_by_slot[slot], slot))
    for _ in range(4 * len(where)):
        high, low = max(range(len(load)), key=load.__getitem__), min(range(len(load)), key=load.__getitem__)
        gap = load[high] - load[low]
        if slack and load[high] <= share * (1 + slack):
            break
        best = min(((abs(b - gap / 2), b, slot) for b, slot in held[high] if 0 < b < gap), default=None)
        if best is None:
            break
        _, b, slot = best
        held[high].remove((b, slot))
        held[low].append((b, slot))
        where[slot], load[high], load[low] = low, load[high] - b, load[low] + b
    return now.edited(where)


def virtual_slot(*keys: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Columns doc_id, size (UTF-8 bytes plus 1), text_crc32 and virtual_slot of every record, stored.

    Equal rows would share a slot; they get a salt each, which has to be stored to hold in later passes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    same = ["doc_id", "size", "text_crc32"]
    again = cut(rows.groupBy(*same).count().filter("count > 1").select(F.xxhash64(*same).alias("again")).distinct(), "repeated-records")
    salted = rows.withColumns({"again": F.xxhash64(*same), "row": F.monotonically_increasing_id()}).join(again.withColumn("salted", F.lit(True)), "again", "left")
    salt = F.when(F.col("salted"), F.col("row")).otherwise(F.lit(-1))
    return cut(salted.select(*same, virtual_slot(*same, salt, slots=slots).alias("virtual_slot")), "records")


def slot_sums(records: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot: at most `slots` rows come to the driver."""
    got = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    b, n = [0] * slots, [0] * slots
    for r in got:
        b[r["virtual_slot"]], n[r["virtual_slot"]] = r["b"], r["n"]
    return b, n


def place(records: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Records with shard and slot, the record's place in its shard: gapless from 0, by virtual slot and then by id.

    A place is the rows in the shard's earlier virtual slots, from the map, plus the rank in the own one, so no task
    has to hold more than a virtual slot.
    """
    before, seen = [0] * len(slot_map.shard), [0] * max(1, slot_map.shards)
    for i, s in enumerate(slot_map.shard):
        before[i], seen[s] = seen[s], seen[s] + slot_map.rows[i]
    rows = [(i, s, b) for i, (s, b) in enumerate(zip(slot_map.shard, before, strict=True))]
    lookup = records.sparkSession.createDataFrame(rows, "virtual_slot int, shard int, before long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("rank", rank).join(F.broadcast(lookup), "virtual_slot").withColumn("slot", F.col("before") + F.col("rank") - 1)


def next_version(spark: SparkSession, path: str, bytes_by_slot: list[int], rows_by_slot: list[int], shards: int) -> SlotMap:
    """Store the map of `path`, or one dealt in turn, edited for these sums, and read it back."""
    if not exists(spark, path):
        in_turn(bytes_by_slot, rows_by_slot, shards).save(spark, path)
    rebalance(SlotMap.load(spark, path), bytes_by_slot, rows_by_slot, slack=0.0).save(spark, path)
    return SlotMap.load(spark, path)


def op8_sharding(spark: SparkSession, sf_dir: str, shards: int = 16, map_path: str | None = None) -> DataFrame:
    """Contract query under the law `bytes`."""
    records = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    slot_map = next_version(spark, map_path or fresh_path(spark, "slot-map"), *slot_sums(records), shards)
    return place(records, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )

"""Sharding through fixed virtual slots.

Records are hashed into ``slots`` virtual slots, bytes and rows are summed per
slot, and a versioned slot-to-shard map places whole slots: the largest slot
first, each into the lightest shard. The map is stored as a table with a version;
to rebalance, read the newest (``load_map``), edit it (``grow``) and store it as
the next (``save_map``): only the moved slots' rows move, and older versions stay.

Everything is DataFrame work. The only thing that ever meets in one task is the
map, whose size is the fixed number of slots.

Defined results: a null text has no bytes; a null key is replaced by the text's
hash; repeated rows are rows of their own, with different positions; an empty
table gives no rows; columns of the input that the results need not are left out.
Equal texts under different keys may lie in different shards: the law that holds is
that of sizes, and a group of copies may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots: fixed for the life of a data set.
SLOTS = 4096
#: Bytes that each record costs besides its text.
RECORD_BYTES = 16


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record; it depends on the key alone where there is one."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.sha2(text, 256), F.lit(""))), F.lit(slots)).cast("int")


def record_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """One slim row per record: key, size, text_crc32, virtual_slot. Texts go no further than this scan."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key),
        (F.octet_length(body) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        slot_of(F.col(key), F.col(text), slots).alias("virtual_slot"),
    )


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot, summed before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def slot_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Map of a version: virtual_slot, shard, slot_bytes, slot_rows, first_position, version.

    ``first_position`` is where the slot's rows begin inside their shard.
    """
    ordered = loads.agg(F.sort_array(F.collect_list(F.struct((-F.col("slot_bytes")).alias("o"), "virtual_slot", "slot_bytes", "slot_rows"))).alias("slots"))
    nothing = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("shards"))

    def place(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == lightest, x + slot["slot_bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["shards"], F.array(lightest)).alias("shards"),
        )

    placed = ordered.select(F.inline(F.arrays_zip("slots", F.aggregate("slots", nothing, place)["shards"].alias("shard"))))
    return positions(placed.select("slots.virtual_slot", "shard", "slots.slot_bytes", "slots.slot_rows"), version)


def positions(placed: DataFrame, version: int) -> DataFrame:
    inside = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("slot_rows").over(inside), F.lit(0)).alias("first_position")
    return placed.select("virtual_slot", "shard", "slot_bytes", "slot_rows", first, F.lit(version).alias("version"))


def grow(slots: DataFrame, shards: int, version: int) -> DataFrame:
    """The map edited for one more shard: every shard gives slots up to its surplus, all of them to the new one."""
    total = slots.agg((F.sum("slot_bytes") / F.lit(shards + 1)).alias("fair"))
    inside = Window.partitionBy("shard").orderBy("slot_bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    given = F.sum("slot_bytes").over(inside)
    held = F.sum("slot_bytes").over(Window.partitionBy("shard"))
    beside = slots.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one")  # one row
    moved = beside.withColumn("moves", given <= held - F.col("fair"))
    return positions(
        moved.select("virtual_slot", F.when(F.col("moves"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"), "slot_bytes", "slot_rows"),
        version,
    )


def save_map(slots: DataFrame, path: str) -> None:
    """Store a version of the map under ``path``; a version that is there already is an error, as maps are only added."""
    slots.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={slots.first()['version'] if not slots.isEmpty() else 0}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map; None: the newest."""
    every = spark.read.parquet(path).withColumn("version", F.col("version").cast("int"))
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == F.lit(version)).select("virtual_slot", "shard", "slot_bytes", "slot_rows", "first_position", "version")


def assign(records: DataFrame, slots: DataFrame, key: str = "doc_id") -> DataFrame:
    """Records with their shard and their gapless position in it. The map is broadcast: it has SLOTS rows at most."""
    inside = Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size")
    placed = F.broadcast(slots.select("virtual_slot", "shard", "first_position", "version"))
    numbered = records.withColumn("in_slot", F.row_number().over(inside))
    return numbered.join(placed, "virtual_slot").withColumn("position", F.col("first_position") + F.col("in_slot") - 1).drop("in_slot", "first_position")

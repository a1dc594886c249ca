"""Query op10: every document into one of 40 shards of near equal bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import materialize, scratch_dir, table
from harrow.llm.sharding import assign, load_map, record_sizes, save_map, slot_loads, slot_map

NAME = "op10_sharding"
SHARDS = 40
#: DuckDB has neither CRC32 nor XXH64 as Spark computes them; tests hold the result against plain Python.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialize(record_sizes(table(spark, sf_dir, "documents")), "op10-records")
    maps = f"{scratch_dir(spark).rstrip('/')}/op10-maps-{uuid.uuid4().hex}"
    save_map(materialize(slot_map(slot_loads(records), SHARDS), "op10-map"), maps)
    slots = load_map(spark, maps)
    return assign(records, slots).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )

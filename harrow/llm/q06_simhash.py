"""Query op6: fingerprint and near-duplicate component of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import table
from harrow.llm.simhash import near_duplicates

NAME = "op6_simhash"
#: DuckDB has no XXH64; tests hold the result against plain Python.
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

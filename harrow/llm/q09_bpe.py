"""Query op9: encode and decode every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.bpe import bpe_round_trip
from harrow.llm.common import table

NAME = "op9_bpe"
ORACLE_SQL = None


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    both = bpe_round_trip(docs.select("doc_id", "text"), vocabulary).select("doc_id", "tokens.ids", "tokens.decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

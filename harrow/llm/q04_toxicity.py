"""Query op4: toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import table
from harrow.llm.toxicity import CATEGORIES, REJECT, fit, with_toxicity

NAME = "op4_toxicity"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_toxicity(docs, chain)
    return scored.select("doc_id", *[F.col(f"toxicity.{c}").alias(f"p_{c}") for c in CATEGORIES], (F.col("toxicity.toxic") >= REJECT).cast("int").alias("toxic"))

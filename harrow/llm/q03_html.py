"""Query op3: main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import table
from harrow.llm.htmltext import with_main_text

NAME = "op3_html"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

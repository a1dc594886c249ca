"""Corpus pipeline over ``documents``; each stage calls one operator of ``harrow.llm``.

Every stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``,
all columns as they were; the last returns the documents' tokens. ``run``
writes each stage's result to the shared folder and reads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import bpe, decontamination, quality, simhash, toxicity
from harrow.llm.common import fresh, materialize, table
from harrow.llm.q02_quality import held_out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of at least ``quality.ACCEPT``."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), allowed=~held_out())
    score = fresh(docs, "score")
    return quality.with_quality(docs, model, score=score).where(F.col(score) >= quality.ACCEPT).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of being toxic is under ``toxicity.REJECT``."""
    chain = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = fresh(docs, "toxicity")
    return toxicity.with_toxicity(docs, chain, out=out).where(F.col(f"{out}.toxic") < toxicity.REJECT).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component, the one with the smallest id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    out = fresh(docs, "leaks")
    return decontamination.with_leaks(docs, table(spark, sf_dir, "benchmark"), out=out).where(F.size(out) == 0).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, and whether decoding gives the text back."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.bpe_round_trip(docs.select("doc_id", "text"), vocabulary).select("doc_id", "text", "tokens.ids", "tokens.decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]
#: Trained models and XXH64 are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)

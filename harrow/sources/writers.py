"""Writers: dataset as Parquet, CSV and JSON Lines, uploads, blocklist, dossiers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT = 1


def write_dataset_parquet(df: DataFrame, path: str, filters: dict | None = None) -> None:
    """Typed zstd Parquet by day, and a ``_meta`` folder with format version and filter."""
    day = df.withColumn("day", F.to_date("ts"))
    day.repartition("day", F.pmod(F.xxhash64("uid"), F.lit(32))).write.mode("overwrite").option("compression", "zstd").partitionBy("day").parquet(path)
    meta = json.dumps({"format": FORMAT, "filters": filters or {}}, sort_keys=True)
    df.sparkSession.range(1).select(F.lit(meta).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}_meta")


def csv_cell(c: Column, kind: str) -> Column:
    """Nested values as JSON, binary as base64; a leading sign of a formula gets an apostrophe."""
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c)
    if kind == "binary":
        return F.base64(c)
    if kind == "string":
        return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return c.cast("string")


def write_dataset_csv(df: DataFrame, path: str) -> None:
    df.select(*[csv_cell(F.col(c), k).alias(c) for c, k in df.dtypes]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def timeline_rows(df: DataFrame) -> DataFrame:
    message = F.concat_ws(" ", "method", "path", F.concat(F.lit("["), F.array_join("labels", ","), F.lit("]")))
    return df.select(message.alias("message"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("datetime"), F.lit("request recorded").alias("timestamp_desc"), "ip", "uid")


def write_timeline_jsonl(df: DataFrame, path: str) -> None:
    timeline_rows(df).write.mode("overwrite").json(path)


def write_uploads(df: DataFrame, path: str, ip: str | None = None) -> None:
    """Upload metadata, oldest first inside each file; never content."""
    kept = df if ip is None else df.where(F.col("ip") == ip)
    kept.select("uid", "request_uid", "origin", "ts", "ip", "kind", "filename", "sniffed_type", "size", "sha256", "answered_path").sort("ts", "uid").write.mode("overwrite").parquet(path)


def write_blocklist(df: DataFrame, path: str) -> None:
    """(entry, key, shared): one address or prefix per line by key, a comment before shared ones."""
    lines = df.sort("key").select(F.when(F.col("shared"), F.concat(F.lit("# shared address\n"), "entry")).otherwise(F.col("entry")).alias("value"))
    lines.write.mode("overwrite").text(path)


def dossiers(subjects: DataFrame, parts: dict[str, DataFrame], key: str, cap: int = 100) -> DataFrame:
    """One nested row per subject: each part's total and its first ``cap`` rows. Parts have an ``order`` column."""
    from harrow.operators.stats import keep_top

    out = subjects
    for name, df in parts.items():
        total = df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_total"))
        first = keep_top(df, [key], [F.col("order"), F.xxhash64(*df.columns)], cap).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("order", *[c for c in df.columns if c not in ("order", key)]))).alias(name))
        out = out.join(total, key, "left").join(first, key, "left")
    return out


def write_dossiers(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

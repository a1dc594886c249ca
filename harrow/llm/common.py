"""What the training-data operators share: tables, shared scratch, fresh names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.sources.scratch import materialize, scratch_dir

__all__ = ["bounded_batches", "fresh", "lookup", "marked", "materialize", "scratch_dir", "spread", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so that any store that Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for count[i] steps, one after another."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


#: Keys that more than one row in HOT_KEYS of a table holds are hot; there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000
#: Rows of keys that are broadcast at most; beyond it both sides are shuffled.
MOST_MARKS = 1_000_000


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``left`` joined (``inner`` or ``left``) with ``right``, which has one row per key; both are written tables.

    Rows with a hot key never meet in one task: the right side's rows of hot
    keys, under HOT_KEYS of them whatever the size, are broadcast. Rows without a
    key are not joined at all.
    """
    keys = [key] if isinstance(key, str) else key
    limit = max(1, left.count() // HOT_KEYS)
    whole = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    hot = materialize(left.where(whole).groupBy(*keys).count().where(F.col("count") > limit).select(*keys), "hot-keys")
    known = materialize(hot.join(right, keys, how), "hot-rows")
    rest = left.where(whole).join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    out = rest.unionByName(left.where(whole).join(F.broadcast(known), keys).select(*rest.columns))
    return out.unionByName(left.where(f"NOT ({whole})"), allowMissingColumns=True) if how == "left" else out


def marked(df: DataFrame, marks: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``df`` joined with a written table of marks: without moving ``df`` if the marks are few enough to broadcast (their number is checked), else by shuffling both."""
    return df.join(F.broadcast(marks) if marks.count() <= MOST_MARKS else marks, keys, how)


#: Rows and bytes of text that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's Arrow batches so that whole documents fit a worker's memory.

    A session that has its own setting keeps it.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if conf.get(key, None) is None:
            conf.set(key, str(most))
    return df

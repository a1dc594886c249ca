"""Merges of change records: last writer wins, insert once, tombstones, waiting children, retention."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators.stats import DAY
from harrow.sources.scratch import materialize


def merge_latest(target: DataFrame, changes: DataFrame, keys: list[str], version: str = "version", tie: str = "origin") -> DataFrame:
    """Newest row per key by (version, tie); map-side combined."""
    rest = [c for c in target.columns if c not in keys]
    both = target.unionByName(changes.select(*target.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, tie)).alias("_r")).select(*keys, "_r.*").select(*target.columns)


def merge_idempotent(target: DataFrame, changes: DataFrame, uid: str = "uid") -> DataFrame:
    """Rows whose uid is not there yet, once each."""
    new = changes.select(*target.columns).dropDuplicates([uid]).join(target.select(uid), uid, "left_anti")
    return target.unionByName(new.select(*target.columns))


def apply_tombstones(df: DataFrame, tombstones: DataFrame, uid: str = "uid", parent: str | None = None, hidden: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Rows that stay. A tombstone erases rows of its own origin only; ``hidden`` (uid) and rows of ``blocked`` origins go from this node; what stands under a row that goes, at any depth, goes too.

    Descent is followed by doubling: in each round a row learns what its ancestor
    knows and points to that one's ancestor, so chains cost the logarithm of their
    length, and rounds in which nothing new goes are the last.
    """
    own = df.select(F.col(uid).alias("_uid"), "origin")
    gone = own.join(tombstones.select(F.col(uid).alias("_uid"), "origin"), ["_uid", "origin"], "left_semi").select("_uid")
    if hidden is not None:
        gone = gone.unionByName(hidden.select(F.col(uid).alias("_uid")))
    if blocked is not None:
        gone = gone.unionByName(own.join(blocked.select("origin"), "origin", "left_semi").select("_uid"))
    if parent is None:
        return df.join(gone.select(F.col("_uid").alias(uid)), uid, "left_anti").select(*df.columns)
    flags = gone.distinct().withColumn("gone", F.lit(True))
    rows = df.select(F.col(uid).alias("_uid"), F.col(parent).alias("up")).where("_uid IS NOT NULL").groupBy("_uid").agg(F.max("up").alias("up"))
    # a parent that is not here any more may be known to be gone itself
    nodes = rows.join(flags, "_uid", "full").select("_uid", "up", F.coalesce("gone", F.lit(False)).alias("gone"))
    nodes, before = materialize(nodes, "descent"), -1
    while (now := nodes.where("gone").count()) != before and not nodes.where("up IS NOT NULL AND NOT gone").isEmpty():
        above = nodes.select(F.col("_uid").alias("up"), F.col("up").alias("higher"), F.col("gone").alias("_gone"))
        nodes = materialize(nodes.join(above, "up", "left").select("_uid", F.col("higher").alias("up"), (F.col("gone") | F.coalesce("_gone", F.lit(False))).alias("gone")), "descent")
        before = now
    return df.join(nodes.where("gone").select(F.col("_uid").alias(uid)), uid, "left_anti").select(*df.columns)


def deferred_children(children: DataFrame, parents: DataFrame, gone: DataFrame, parent: str = "parent") -> dict[str, DataFrame]:
    """Children to apply now, and those that wait for their parent; a gone parent's are dropped."""
    alive = children.join(gone.select(F.col("uid").alias(parent)), parent, "left_anti")
    there = parents.select(F.col("uid").alias(parent))
    return {"apply": alive.join(there, parent, "left_semi"), "wait": alive.join(there, parent, "left_anti")}


#: States in which a job is finished (fixed values).
FINISHED = ("done", "failed", "superseded", "refused")
#: Tables that hang on a request or a scan, and the column that says on which.
CHILDREN = {"requests": {"uploads": "request_id", "tokens": "request_id", "canaries": "request_id", "claims": "request_id"}, "scans": {"ports": "scan_uid", "host_keys": "scan_uid", "scan_facts": "scan_uid"}}


def retention(tables: dict[str, DataFrame], now: int, days: int) -> dict[str, DataFrame]:
    """The tables without what is over ``days`` old, and without what hung on it.

    Requests (``t``) go with their children, scans (``finished``, else ``t``) with
    theirs, light batches by their last row (``last_t``), fingerprints that never
    had a request by their own time. A finished job goes when it is old and no scan
    of it is left; one with a younger scan stays. Tables that are not given are
    passed over; rows without a time stay.
    """
    cutoff = now - days * DAY
    column = lambda df, *names: F.coalesce(*[F.col(n) for n in names if n in df.columns])
    old = lambda df, *names: F.coalesce(column(df, *names) < cutoff, F.lit(False))
    kept = dict(tables)
    for name, key, times in (("requests", "id", ("t",)), ("scans", "uid", ("finished", "t"))):
        if name not in tables:
            continue
        leaves = old(tables[name], *times)
        kept[name] = tables[name].where(~leaves)
        gone = tables[name].where(leaves).select(key)
        for child, parent in CHILDREN[name].items():
            if child in tables:
                kept[child] = tables[child].join(gone.select(F.col(key).alias(parent)), parent, "left_anti").select(*tables[child].columns)
    if "batches" in tables:
        kept["batches"] = tables["batches"].where(~old(tables["batches"], "last_t"))
    if "fingerprints" in tables:
        prints = tables["fingerprints"]
        if "requests" in tables:
            went = tables["requests"].where(old(tables["requests"], "t")).select(F.col("id").alias("request_id"))
            prints = prints.join(went, "request_id", "left_anti").select(*prints.columns)
        kept["fingerprints"] = prints.where(~(F.col("request_id").isNull() & old(prints, "t")))
    if "jobs" in tables:
        jobs = tables["jobs"]
        ended = F.coalesce(F.col("status").isin(*FINISHED), F.lit(False)) & old(jobs, "finished", "queued")
        left = kept["scans"].select(F.col("job_uid").alias("uid")) if "scans" in kept else jobs.limit(0).select("uid")
        spent = jobs.where(ended).join(left, "uid", "left_anti").select("uid")
        kept["jobs"] = jobs.join(spent, "uid", "left_anti").select(*jobs.columns)
    return kept


def prune_partitions(spark: SparkSession, path: str, now: int, days: int, day: str = "day", time: str = "t") -> int:
    """Drop what is over ``days`` old from a Parquet table partitioned by ``day`` (yyyy-MM-dd): whole days by their folder, and only the edge's day is rewritten. Returns the number of days dropped."""
    cutoff = now - days * DAY
    edge = datetime.fromtimestamp(cutoff, UTC).strftime("%Y-%m-%d")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith(f"{day}=")]  # a folder per day
    kept = None
    if any(p.getName() == f"{day}={edge}" for p in found):
        kept = materialize(spark.read.parquet(f"{path.rstrip('/')}/{day}={edge}").where(F.col(time) >= cutoff), "edge-day")
    older = [p for p in found if p.getName().split("=", 1)[1] < edge]
    for p in older:
        files.delete(p, True)
    if kept is not None:
        kept.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{day}={edge}")
    return len(older)

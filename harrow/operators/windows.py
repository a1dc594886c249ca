"""Window operators, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.operators.stats import DAY, HOUR, keep_top


def running_totals(changes: DataFrame, keys: list[str], columns: list[str], step: int = DAY) -> DataFrame:
    """(keys, t, columns): sums of all changes of the key up to each time. Dealt by key and ``step`` seconds; earlier steps' sums are carried in by a small table."""
    at = changes.groupBy(*keys, "t").agg(*[F.sum(c).alias(c) for c in columns]).withColumn("_step", F.floor(F.col("t") / step))
    upto = Window.partitionBy(*keys, "_step").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*keys, "_step").agg(*[F.sum(c).alias(c) for c in columns])
    carried = sums.select(*keys, "_step", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = at.select(*keys, "_step", "t", *[F.sum(c).over(upto).alias(c) for c in columns])
    return inside.join(carried, [*keys, "_step"]).select(*keys, "t", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in columns])


def request_history_1h(requests: DataFrame, seconds: int = HOUR) -> DataFrame:
    """Per request: distinct paths and requests of its source in the hour before, itself included (strictly under 3600 s); null without a source or a time.

    A request counts from its time on and leaves after the hour; a path leaves
    when it is asked for again or after the hour, which is seen in cells of two
    hours. Both counts are running sums of such changes, dealt by source and day;
    the requests run along with them, so no row looks at the rows before it and
    nothing is joined but the days' small carried sums.
    """
    hour = F.floor(F.col("t") / seconds)
    cells = F.inline(F.array(F.struct(hour.alias("_cell"), F.lit(True).alias("_own")), F.struct((hour - 1).alias("_cell"), F.lit(False).alias("_own"))))
    asked = requests.where("ip IS NOT NULL AND t IS NOT NULL").select("ip", "path", "t", cells)
    leaves = F.col("t") + seconds
    until = F.least(leaves, F.coalesce(F.lead("t").over(Window.partitionBy("ip", "path", "_cell").orderBy("t", F.desc("_own"))), leaves))
    change = lambda t, paths, all_: F.struct(t.alias("t"), F.lit(paths).alias("_p"), F.lit(all_).alias("_r"))
    changes = asked.withColumn("_until", until).where("_own").select("ip", F.inline(F.array(change(F.col("t"), 1, 1), change(F.col("_until"), -1, 0), change(leaves, 0, -1))))
    changes = changes.groupBy("ip", "t").agg(F.sum("_p").alias("_p"), F.sum("_r").alias("_r"))
    rows = requests.select("ip", "t", F.struct(*requests.columns).alias("_row")).unionByName(changes, allowMissingColumns=True).withColumn("_step", F.floor(F.col("t") / DAY))
    upto = Window.partitionBy("ip", "_step").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("ip").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    days = changes.groupBy("ip", F.floor(F.col("t") / DAY).alias("_step")).agg(F.sum("_p").alias("_p"), F.sum("_r").alias("_r"))
    carried = days.select("ip", "_step", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_p", "_r")])
    found = rows.select("ip", "_step", "_row", F.sum("_p").over(upto).alias("_p"), F.sum("_r").over(upto).alias("_r")).where("_row IS NOT NULL").join(carried, ["ip", "_step"], "left")
    return found.select("_row.*", (F.col("_p") + F.col("_p0")).cast("int").alias("paths_1h"), (F.col("_r") + F.col("_r0")).alias("requests_1h"))


def ranked_joiners(sightings: DataFrame) -> DataFrame:
    """Values of each source, shared ones first, then newest: row number, rank and how many are shared."""
    by = sightings.groupBy("ip", "value").agg(F.max("t").alias("last_seen"))
    shared = (F.count(F.lit(1)).over(Window.partitionBy("value")) > 1).cast("int")
    source = Window.partitionBy("ip")
    order = source.orderBy(F.desc("shared"), F.desc("last_seen"), "value")
    return by.withColumn("shared", shared).select("ip", "value", "shared", F.row_number().over(order).alias("n"), F.rank().over(source.orderBy(F.desc("shared"), F.desc("last_seen"))).alias("rank"), F.sum("shared").over(source).alias("n_shared"))


def joiner_lists(sightings: DataFrame, n: int = 256) -> DataFrame:
    """Ordered value lists of the inputs by source and how often; the n most frequent, the rest as one row (list null)."""
    lists = sightings.groupBy("ip", "source_uid").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("list"))
    by = lists.groupBy("ip", "list").agg(F.count(F.lit(1)).alias("inputs"))
    place = F.row_number().over(Window.partitionBy("ip").orderBy(F.desc("inputs"), "list"))
    return by.select("ip", F.when(place <= n, F.col("list")).alias("list"), "inputs").groupBy("ip", "list").agg(F.sum("inputs").alias("inputs"))


def intel_history(log: DataFrame, n: int = 50) -> DataFrame:
    return keep_top(log, ["ip", "provider"], [F.desc("hlc"), F.desc("origin")], n)


def latest_intel(log: DataFrame) -> DataFrame:
    """Newest row by source and provider; map-side combined, no sort."""
    return log.groupBy("ip", "provider").agg(F.max_by(F.struct("data", "origin", "hlc"), F.struct("hlc", "origin")).alias("r")).select("ip", "provider", "r.*")


def source_rank(rollup: DataFrame) -> DataFrame:
    """Standard competition rank by requests, through the histogram of counts: no window over all sources."""
    histogram = rollup.groupBy("requests").agg(F.count(F.lit(1)).alias("n"))
    bands = histogram.withColumn("band", F.floor(F.log2(F.col("requests") + 1)))
    above_in_band = F.coalesce(F.sum("n").over(Window.partitionBy("band").orderBy(F.desc("requests")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_band = bands.groupBy("band").agg(F.sum("n").alias("total"))  # at most 64 rows
    over = Window.partitionBy(F.lit(0)).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    higher = per_band.select("band", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("higher"))
    ranks = bands.withColumn("above", above_in_band).join(F.broadcast(higher), "band").select("requests", (F.col("above") + F.col("higher") + 1).alias("rank"))
    return rollup.join(ranks, "requests")


def top_k(df: DataFrame, by: str, ties: list[str], k: int) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def recent(requests: DataFrame, shapes: DataFrame, waves: DataFrame, now: int, n: int) -> DataFrame:
    """Newest n of the last day, with flags for a shape first seen then and for a wave."""
    newest = requests.where((F.col("t") >= now - DAY)).orderBy(F.desc("t"), F.desc("id")).limit(n)
    s = shapes.select(F.col("shape").alias("path"), (F.col("first_seen") >= now - DAY).alias("new_shape"))
    w = waves.select(F.col("shape").alias("path"), F.lit(True).alias("wave"))
    return newest.join(s, "path", "left").join(w, "path", "left").select("id", "ip", "t", "path", F.coalesce("new_shape", F.lit(False)).alias("new_shape"), F.coalesce("wave", F.lit(False)).alias("wave"))


def response_ratio_order(jobs: DataFrame, estimates: DataFrame, now: int, n: int) -> DataFrame:
    """Queued jobs by (wait + estimate) / estimate."""
    rows = jobs.where("status = 'queued'").join(estimates, "level")
    ratio = (now - F.col("queued") + F.col("minutes") * 60) / (F.col("minutes") * 60)
    return rows.withColumn("ratio", ratio).orderBy(F.desc("ratio"), "queued", "uid").limit(n).select("uid", "ratio")


def neighbours(sources: DataFrame, prefix: str, k: int = 8) -> DataFrame:
    """Per source: how many others are in its network, and the k of them with most requests.

    Each network keeps its first k + 1; every source drops itself from that.
    """
    top = keep_top(sources, [prefix], [F.desc("requests"), F.col("ip")], k + 1).groupBy(prefix).agg(F.sort_array(F.collect_list(F.struct((-F.col("requests")).alias("o"), F.col("ip").alias("i")))).alias("top"))
    size = sources.groupBy(prefix).agg((F.count(F.lit(1)) - 1).alias("others"))
    rows = sources.join(top.join(size, prefix), prefix)
    others = F.slice(F.filter(F.transform("top", lambda x: x["i"]), lambda i: i != F.col("ip")), 1, k)
    return rows.select("ip", "others", F.array_join(others.cast("array<string>"), ",").alias("neighbours"))


def asked(recorded: DataFrame, light: DataFrame) -> DataFrame:
    return recorded.select("shape", "ip").union(light.select("shape", "ip")).distinct()


def events_timeline(branches: dict[str, DataFrame], n: int) -> DataFrame:
    """(ip, t, id, kind, ...) of all kinds, newest first; each branch is cut to n before the merge."""
    order = [F.desc("t"), F.col("kind"), F.desc("id")]
    out = None
    for kind, df in branches.items():
        part = df.withColumn("kind", F.lit(kind)).orderBy(*order).limit(n)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(*order).limit(n)


def union_sightings(legs: dict[str, list[DataFrame]]) -> DataFrame:
    """(kind, value, ip, t) of every leg of every kind."""
    out = None
    for kind, frames in legs.items():
        for f in frames:
            part = f.select(F.lit(kind).alias("kind"), F.col("value").cast("string").alias("value"), "ip", "t").where("value IS NOT NULL")
            out = part if out is None else out.unionByName(part)
    return out


def export_rows(recorded: DataFrame, light: DataFrame, recorded_only: bool = False) -> DataFrame:
    """Recorded rows, then light rows; with light rows in the output a recorded row stands for itself."""
    if recorded_only:
        return recorded.withColumn("weight", F.col("unrecorded") + 1)
    a = recorded.withColumn("weight", F.lit(1).cast("long"))
    return a.unionByName(light.withColumn("weight", F.col("unrecorded") + 1), allowMissingColumns=True)

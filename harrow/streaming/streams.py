"""Structured Streaming twins of batch operators. Event time is ``ts``, ``t`` the same in seconds.

Every stream states how late rows may come (``lateness``): later ones are
dropped, and state that no row in time can change is given up.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from harrow.operators.filters import publication
from harrow.operators.windows import running_totals

LATENESS = "2 days"
#: The state store that keyed lists and timers need, instead of the default one.
STATE_STORE, DEFAULT_STORE, ROCKS_STORE = ("spark.sql.streaming.stateStore.providerClass", *(f"org.apache.spark.sql.execution.streaming.state.{n}StateStoreProvider" for n in ("HDFSBacked", "RocksDB")))


def once(stream: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Rows that are delivered again within the watermark are dropped; rows without a source are clock ticks and go too."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys).where("ip IS NOT NULL")


def stream_rollups(requests: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Per source: requests, severity and span (update mode; read it with ``newest``). A source's totals are kept for ever."""
    return once(requests, ["id"], lateness).groupBy("ip").agg(F.count(F.lit(1)).alias("requests"), F.max("severity").alias("max_severity"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


def stream_label_rollups(requests: DataFrame, labels: str = "labels", lateness: str = LATENESS) -> DataFrame:
    """Per source and label: requests that carry it, each once (update mode; read it with ``newest``). Totals are kept for ever."""
    each = once(requests, ["id"], lateness).select("ip", F.explode(F.array_distinct(labels)).alias("label"))
    return each.groupBy("ip", "label").agg(F.count(F.lit(1)).alias("requests"))


def stream_timeline(requests: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Hourly counts (update mode): rows count in their own hour whenever they come within the watermark; older hours' state is dropped."""
    hours = once(requests, ["id"], lateness).groupBy(F.window("ts", "1 hour"))
    return hours.agg(F.count(F.lit(1)).alias("requests")).select(F.unix_timestamp("window.start").alias("bucket"), "requests")


#: Parts into which the keys of a stream in event order are dealt; a part is what the state store keeps together.
PARTS = 128


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(block)).read_all()


class InOrder(StatefulProcessor):
    """Runs a step over each key's rows in the order of their times, however they come.

    Keys are dealt into parts, so that state is read and written by blocks (Arrow) and
    not by rows. New rows of a part are one block more in a list and never rewritten by
    later batches that only add; a timer stands at the earliest of them. When the
    watermark has passed it, the rows in front of the watermark go to the step, key by
    key and sorted, with what each key holds. What a key holds is given up ``keep``
    seconds after its last row.
    """

    def __init__(self, step: Callable, keep: int | None):
        self.step, self.keep = step, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.held = handle.getValueState("held", "block binary")
        self.timer = handle.getValueState("timer", "at long")

    def set_timer(self, at: int | None, was: int | None) -> None:
        if was == at:
            return
        if was is not None:
            self.handle.deleteTimer(was)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables([pa.Table.from_pandas(r[["key", "t", "other"]], preserve_index=False) for r in rows], promote_options="permissive")
        self.waiting.appendValue((packed(new),))
        first = max(pc.min(new["t"]).as_py() * 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        due = self.timer.get()[0] if self.timer.exists() else None
        self.set_timer(first if due is None else min(due, first), due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        blocks = [unpacked(r[0]) for r in self.waiting.get()]
        held = {r["key"]: (r["last"], [np.array(r["a"], np.int64), np.array(r["b"], np.int64), np.array(r["c"], float)]) for r in unpacked(self.held.get()[0]).to_pylist()} if self.held.exists() else {}
        due, found, had = [], [], len(held)
        if blocks:
            rows = pa.concat_tables(blocks, promote_options="permissive")
            ready = pc.less(pc.multiply(rows["t"], 1000), watermark)
            now, rest = rows.filter(ready), rows.filter(pc.invert(ready))
            if len(now):
                found = list(self.steps(now, held))
                self.waiting.clear()
                if len(rest):
                    self.waiting.put([(packed(rest),)])
            if len(rest):
                due.append(pc.min(rest["t"]).as_py() * 1000 + 1)
        if self.keep is not None:
            held = {k: h for k, h in held.items() if (h[0] + self.keep) * 1000 > watermark}
            due.extend([min((h[0] + self.keep) * 1000 for h in held.values())] if held else [])
        if found or len(held) != had:
            if held:
                self.held.update((packed(pa.table({"key": list(held), "last": [h[0] for h in held.values()]} | {c: pa.array([h[1][k] for h in held.values()], pa.list_(kind)) for k, (c, kind) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("c", pa.float64())))})),))
            else:
                self.held.clear()
        self.set_timer(max(min(due), watermark + 1) if due else None, None)
        if any(len(values) for values in found):
            parts = [values for values in found if len(values)]
            yield pd.DataFrame({c: np.concatenate([np.asarray(p[c]) for p in parts]) for c in parts[0]})

    def steps(self, rows: pa.Table, held: dict) -> Iterator[dict]:
        """The step over each key's rows, by key; ``held`` is brought up to date."""
        names = rows["key"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, t, other = names.indices.to_numpy(), rows["t"].to_numpy(), rows["other"].to_numpy()
        order = np.lexsort((other, t, code))
        ends = np.flatnonzero(np.diff(code[order])) + 1
        names = names.dictionary.to_pylist()
        for at in np.split(order, ends):
            key = names[code[at[0]]]
            state = held.get(key, (None, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]))[1]
            state, values = self.step(state, key, t[at], other[at])
            held[key] = (int(t[at[-1]]), state)
            yield values

    def close(self) -> None:
        pass


def in_event_order(rows: DataFrame, key: str, other: str, step: Callable, out: str, keep: int | None) -> DataFrame:
    """Run ``step(held, key, times, others)`` over each key's rows in the order of their times.

    A row waits until the watermark has passed it, so nothing can come before
    it any more (the stream has a watermark on ``ts``). ``step`` returns the three
    arrays that it holds (two of integers, one of numbers) anew, and the columns of
    ``out``, a dict of equally long values, empty for none. ``keep``: seconds after the
    last row from which what is held is given up; None keeps it. Needs the RocksDB state
    store, which ``run_to_table`` sets where the session names none.
    """
    small = rows.select("ts", F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("part"), F.col(key).alias("key"), "t", F.col(other).alias("other"))
    return small.groupBy("part").transformWithStateInPandas(InOrder(step, keep), out, "append", "EventTime")


def stream_history(requests: DataFrame, seconds: int = 3600, lateness: str = LATENESS) -> DataFrame:
    """Per request: the source's requests in the hour before, itself included. Held: the last hour's times."""

    def step(held, key, times, ids):
        every = np.concatenate([held[0].astype(np.int64), times])
        counts = np.searchsorted(every, times, "right") - np.searchsorted(every, times - seconds, "right")
        return [every[every > times[-1] - seconds], held[1], held[2]], {"id": ids, "requests_1h": counts}

    return in_event_order(once(requests, ["id"], lateness), "ip", "id", step, "id long, requests_1h long", seconds)


def sampled(times, rate: float, burst: float, every: int, state: tuple[float, float, float]) -> tuple[list[str], tuple[float, float, float]]:
    """Decisions on one source's requests in order: ``record`` while tokens last, then ``sample`` one in ``every``, else ``count``; a full bucket forgets how many were over."""
    tokens, last, over = state
    out = []
    for t in times:
        tokens = min(burst, tokens + rate * max(0, t - last))
        last = max(last, t)
        if tokens >= burst:
            over = 0
        if tokens >= 1:
            tokens -= 1
            out.append("record")
        else:
            over += 1
            out.append("sample" if over % every == 1 % every else "count")
    return out, (tokens, last, over)


def stream_sampling(requests: DataFrame, rate: float, burst: int, every: int, lateness: str = LATENESS) -> DataFrame:
    """Token bucket per source in event time. Held: tokens, last time, requests over; given up when the bucket is full again."""

    def step(held, key, times, ids):
        state = tuple(held[2]) if len(held[2]) else (float(burst), float(times[0]), 0.0)
        decisions, state = sampled(times.tolist(), rate, float(burst), every, state)
        return [held[0], held[1], np.array(state, float)], {"id": ids, "decision": np.array(decisions, object)}

    return in_event_order(once(requests, ["id"], lateness), "ip", "id", step, "id long, decision string", int(burst / rate) + 1)


def _unknown(rows: DataFrame, known: DataFrame, uncounted: DataFrame | None) -> DataFrame:
    """Rows of shapes that no rule knows; shapes whose hits are not counted yet (``uncounted``) are passed over."""
    rows = rows.join(known.select("shape"), "shape", "left_anti")
    return rows if uncounted is None else rows.join(uncounted.select("shape"), "shape", "left_anti")


def stream_waves(requests: DataFrame, known: DataFrame, seconds: int, least: int, lateness: str = LATENESS, uncounted: DataFrame | None = None) -> DataFrame:
    """Unknown shapes that ``least`` sources asked for within ``seconds``; once per shape ever. Held: newest time by source until it fires, then only that it did."""

    def step(held, key, times, ips):
        if len(held[2]):
            return held, {}
        newest = dict(zip(held[0].tolist(), held[1].tolist()))
        queue = deque(sorted((t, ip) for ip, t in newest.items()))
        for t, ip in zip(times.tolist(), ips.tolist()):
            newest[ip] = t
            queue.append((t, ip))
            while queue[0][0] <= t - seconds:
                old, gone = queue.popleft()
                if newest.get(gone) == old:
                    del newest[gone]
            if len(newest) >= least:
                return [held[0][:0], held[1][:0], np.ones(1)], {"shape": np.array([key], object), "t": [t], "sources": [len(newest)]}
        return [np.array(list(newest), np.int64), np.array(list(newest.values()), np.int64), held[2]], {}

    fresh = _unknown(once(requests, ["id"], lateness), known, uncounted)
    return in_event_order(fresh, "shape", "ip", step, "shape string, t long, sources long", None)


def waves(requests: DataFrame, known: DataFrame, seconds: int, least: int, uncounted: DataFrame | None = None) -> DataFrame:
    """The batch twin: the first time at which the sources of the last ``seconds`` are enough.

    A source counts from its request on and leaves when it asks again or when
    the window has passed; the distinct count is a running sum of such changes,
    dealt by shape and day. Both looks ahead stay inside two windows of time.
    """
    fresh = _unknown(requests.select("shape", "ip", "t").where("shape IS NOT NULL").distinct(), known, uncounted).withColumn("_w", F.floor(F.col("t") / seconds))
    again = F.lead("t").over(Window.partitionBy("shape", "ip", "_w").orderBy("t"))
    following = fresh.groupBy("shape", "ip", (F.col("_w") - 1).alias("_w")).agg(F.min("t").alias("_f"))
    until = fresh.withColumn("_n", again).join(following, ["shape", "ip", "_w"], "left").withColumn("_until", F.least(F.col("t") + seconds, F.coalesce("_n", "_f", F.col("t") + seconds)))
    changes = until.select("shape", F.inline(F.array(F.struct(F.col("t").alias("t"), F.lit(1).alias("sources")), F.struct(F.col("_until").alias("t"), F.lit(-1).alias("sources")))))
    return running_totals(changes, ["shape"], ["sources"]).where(F.col("sources") >= least).groupBy("shape").agg(F.min("t").alias("t"))


def stream_release(requests: DataFrame, delay: int, jitter: int, lateness: str = LATENESS) -> DataFrame:
    """Requests when their publication time (time, delay and a jitter from the id) has passed in event time; each once."""
    due = requests.withColumn("public_at", publication(F.col("id"), F.col("t"), delay, jitter)).withColumn("ts", F.timestamp_seconds(F.coalesce("public_at", "t")))

    def step(held, key, times, ids):
        return held, {"id": ids, "public_at": times}

    rows = once(due, ["id"], lateness).withColumn("t", F.col("public_at")).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(1024)))
    return in_event_order(rows, "_part", "id", step, "id long, public_at long", 0)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run all that is there now into Parquet: appended, or in update mode each batch's changed rows in a folder of its own, which a repeated batch overwrites."""
    conf = stream.sparkSession.conf
    if conf.get(STATE_STORE, None) in (None, DEFAULT_STORE):
        conf.set(STATE_STORE, ROCKS_STORE)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start()
    query.awaitTermination()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What an update-mode table says now: each key's row of the last batch that changed it."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")

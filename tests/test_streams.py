"""Streams in event order: what a part of many keys costs in state calls, against a plain count."""

import random

import numpy as np
import pandas as pd

from harrow.streaming.streams import InOrder


class State:
    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls.append("get")
        return iter(self.rows) if len(self.rows) != 1 or isinstance(self.rows[0][0], bytes) and self.many else self.rows[0]

    def appendValue(self, row):
        self.calls.append("append")
        self.rows.append(row)

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def update(self, row):
        self.calls.append("update")
        self.rows = [row]

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def state(self, many):
        found = State(self.calls)
        found.many = many
        return found

    def getListState(self, *_):
        return self.state(True)

    def getValueState(self, *_):
        return self.state(False)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Now:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


def test_state_calls_do_not_grow_with_keys():
    rng, handle, got = random.Random(3), Handle(), {}
    rows = [(k, rng.choice([None, *"abc"]) if k % 5 == 0 else f"k{rng.randrange(300)}", rng.randrange(4000)) for k in range(2000)]

    def step(held, key, times, ids):
        every = np.concatenate([held[0], times])
        return [every[every > times[-1] - 100], held[1], held[2]], {"id": ids, "n": np.searchsorted(every, times, "right") - np.searchsorted(every, times - 100, "right")}

    run = InOrder(step, 100)
    run.init(handle)
    for low, end in ((0, 1000), (1000, 2500), (2500, 4100)):
        new = pd.DataFrame([r for r in rows if low <= r[2] < end], columns=["other", "key", "t"])
        watermark = (end - 200) * 1000
        list(run.handleInputRows((0,), iter([new[:400], new[400:]]), Now(watermark)))
        for at in sorted(handle.timers):
            handle.timers.discard(at)
            for out in run.handleExpiredTimer((0,), Now(watermark), None):
                got |= dict(zip(out["id"], out["n"]))
    for at in sorted(handle.timers):
        handle.timers.discard(at)
        for out in run.handleExpiredTimer((0,), Now(10**9), None):
            got |= dict(zip(out["id"], out["n"]))
    assert got == {i: sum(k == other and t - 100 < u <= t for _, other, u in rows) for i, k, t in rows}
    assert len(handle.calls) < 40 and not run.held.exists() and not run.waiting.exists()

"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII, lower-cased A-Z. Every n-gram of
a test item is a seed, however common it is, so every run of GRAM copied words is
aligned and whether a document leaks depends on no other document. An item of
fewer words is a seed as a whole.
Where a document holds a seed, its words around that place are aligned with the
item's: 2 for an equal word, -1 for another, -1 for a word on one side only. The
score is the best local alignment over that of a whole copy. A copy that reaches
the threshold can hold 2 m (1 - threshold) foreign words beside an item's m, and
so many words on both sides are aligned: no longer copy reaches it.

Items are a test set: small beside the corpus. They are broadcast in blocks of a
checked size. If there are several, each block's hits are written before the next
block is made, so neither plan nor memory grows with their number. Texts are never
shuffled.

Defined results: a null or empty text has no leaks; items of under WHOLE words
cannot be told from chance by half of them, so they match as whole copies only;
items without a word, and those of under ``least`` words if it is given, match
nothing; of equally good alignments with an item the first counts; items without an id or with
equal ids are items of their own; whole texts are searched; rows are
independent, so repeated rows repeat their result; an empty table on either side
gives no leaks. Other columns pass through, but one with the name of the output,
which is a parameter, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import bounded_batches, fresh, materialize
from harrow.llm.bytetext import ascii_words, groups, mix, word_hashes

GRAM, WHOLE, THRESHOLD = 3, 5, 0.5
#: Bytes of item text in a broadcast block.
BLOCK_BYTES = 16 << 20
#: Words of windows that are aligned side by side.
CELLS = 1 << 16
MATCH, OTHER, GAP = 2, -1, -1
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, where each row's words start and the last end)."""
    for first, data, starts in groups(texts):
        low, a, b = ascii_words(data)
        yield first, word_hashes(low, a, b), np.searchsorted(a, starts)


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    size = max(0, len(words) - n + 1)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h += words[k : k + size] * _A[k]
    return mix(h)


def inside_rows(count: int, bounds: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Which n-grams lie within one row."""
    ok = np.ones(max(0, count - n + 1), bool)
    for k in range(1, n):
        cut = bounds[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


class Table:
    """Values by sorted hash; most lookups end at a bit table."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashes``, index of the value) for every equal pair."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(self.sorted, hashes[at], "left"), np.searchsorted(self.sorted, hashes[at], "right")
        n = high - low
        index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.repeat(at, n), self.order[index]


class Items:
    """A block of test items, as words and n-grams."""

    def __init__(self, ids: list, texts: list[str | None], least: int = 1):
        self.ids, self.words = [], []
        for first, words, bounds in words_of(texts):
            for k in range(len(bounds) - 1):
                if bounds[k + 1] - bounds[k] >= max(1, least):
                    self.ids.append(ids[first + k])
                    self.words.append(words[bounds[k] : bounds[k + 1]])
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.seeds: dict[int, tuple[Table, np.ndarray, np.ndarray]] = {}  # by n: n-grams, their items and places
        for n in range(1, GRAM + 1):
            mine = [i for i, w in enumerate(self.words) if min(len(w), GRAM) == n]
            if mine:
                each = [grams(self.words[i], n) for i in mine]
                self.seeds[n] = Table(np.concatenate(each)), np.repeat(mine, [len(g) for g in each]), np.concatenate([np.arange(len(g)) for g in each])

    def leaks(self, texts: list[str | None], threshold: float) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        for first, words, bounds in words_of(texts):
            windows = []
            for n, (table, items, places) in self.seeds.items():
                at, seed = table.find(grams(words, n))
                ok = inside_rows(len(words), bounds, n)[at]
                at, item, place = at[ok], items[seed[ok]], places[seed[ok]]
                cell = (at - place) // self._slack(self.size[item])  # which diagonal, coarsely
                windows.append(np.stack([item, np.searchsorted(bounds, at, "right") - 1, cell], axis=1))
            windows = np.unique(np.concatenate(windows), axis=0) if windows else np.zeros((0, 3), np.int64)
            cuts = np.flatnonzero(np.diff(windows[:, 0])) + 1
            for part in np.split(windows, cuts) if len(windows) else []:
                self._align(int(part[0, 0]), part[:, 1], part[:, 2], words, bounds, first, threshold, out)
        return out

    @staticmethod
    def _slack(m):
        return np.maximum(4, m // 4)

    def _align(self, item, rows, cells, words, bounds, first, threshold, out) -> None:
        q = self.words[item]
        m = len(q)
        threshold = threshold if m >= WHOLE else 1.0
        slack, foreign = int(self._slack(m)), int(MATCH * m * (1 - threshold))
        width = m + 2 * foreign + slack
        step = max(1, CELLS // width)
        for s in range(0, len(rows), step):
            row, begin = rows[s : s + step], cells[s : s + step] * slack - foreign
            place = begin[:, None] + np.arange(width)
            real = (place >= bounds[row][:, None]) & (place < bounds[row + 1][:, None])
            t = words[np.clip(place, 0, len(words) - 1)]
            shared = (np.isin(t, q) & real).sum(axis=1) >= threshold * m  # each aligned word adds MATCH at most
            row, place, real, t = row[shared], place[shared], real[shared], t[shared]
            if not len(row):
                continue
            score, end = local_alignment(q, t, real)
            for k in np.flatnonzero(score >= threshold * MATCH * m):
                e = int(end[k]) + 1
                _, back = local_alignment(q[::-1], t[k : k + 1, :e][:, ::-1], real[k : k + 1, :e][:, ::-1])
                found = {"item_id": self.ids[item], "score": float(score[k]) / (MATCH * m), "first_word": int(place[k, e - 1 - int(back[0])] - bounds[row[k]]), "last_word": int(place[k, e - 1] - bounds[row[k]])}
                mine = out[first + int(row[k])]
                same = next((x for x in mine if x["item"] == item), None)
                if same is None:
                    mine.append({"item": item, **found})
                elif found["score"] > same["score"]:
                    same |= found


def local_alignment(q: np.ndarray, t: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of ``q`` in each row of ``t``, and the column where it first ends."""
    n = t.shape[1]
    ramp = np.arange(n) * -GAP
    h = np.zeros((len(t), n + 1), np.int64)
    best, end = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    for word in q:
        step = np.where((t == word) & real, MATCH, OTHER)
        new = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] + GAP), 0)
        h[:, 1:] = np.maximum.accumulate(new + ramp, axis=1) - ramp
        top = h[:, 1:].argmax(axis=1)
        value = h[np.arange(len(t)), top + 1]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def item_blocks(items: DataFrame, key: str, text: str, least: int) -> tuple[int, Iterator[Items]]:
    """How many blocks of at most about BLOCK_BYTES the items make, which follows from the table's size, and the blocks. Equal texts are spread by their keys."""
    total = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    blocks = int(total // BLOCK_BYTES) + 1

    def made(k: int) -> Items:
        rows = items.where(F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(key).cast("string")), F.lit(blocks)) == k).select(key, text).orderBy(key, text).toArrow()
        return Items(rows[key].to_pylist(), rows[text].to_pylist(), least)

    return blocks, (made(k) for k in range(blocks))


def finder(block, threshold: float, kind: str):
    @F.pandas_udf(kind)
    def leaks(texts: pd.Series) -> pd.Series:
        found = block.value.leaks(texts.tolist(), threshold)
        return pd.Series([[{k: v for k, v in x.items() if k != "item"} for x in row] for row in found], dtype=object)

    return leaks


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, out: str = "leaks", least: int = 1) -> DataFrame:
    """Add ``out``: array<struct<item_id, score, first_word, last_word>>, the items that the text holds."""
    context = bounded_batches(docs).sparkSession.sparkContext
    kind = f"array<struct<item_id:{dict(items.dtypes)[item_key]},score:double,first_word:bigint,last_word:bigint>>"
    found_by = lambda block: finder(context.broadcast(block), threshold, kind)(F.col(text))
    rows, blocks = item_blocks(items, item_key, item_text, least)
    if rows == 1:
        block = next(blocks)
        return docs.withColumn(out, found_by(block) if block.words else F.array().cast(kind))
    row, leaks, hits = fresh(docs, "_row"), fresh(docs, "_leaks"), None
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "leak-texts")
    for block in blocks:
        if block.words:
            new = materialize(docs.select(row, found_by(block).alias("_found")).where(F.size("_found") > 0), "leak-hits")
            hits = new if hits is None else hits.unionByName(new)
    none = F.array().cast(kind)
    if hits is None:
        return docs.drop(row).withColumn(out, none)
    every = hits.select(row, F.explode("_found").alias("_leak")).groupBy(row).agg(F.array_sort(F.collect_list("_leak")).alias(leaks))
    return docs.join(every, row, "left").withColumn(out, F.coalesce(leaks, none)).drop(row, leaks)

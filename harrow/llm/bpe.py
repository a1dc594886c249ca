"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that stands inside no vocabulary token can never be merged across,
so a text is certainly cut between its two bytes. All cuts of many texts are
found at once: a table over the 65,536 byte pairs marks the forced ones, and the
pre-token rules (which depend on characters' classes only) add those where the
vocabulary would allow a merge. The fragments are encoded independently, each
distinct one once, and their ids put side by side. Decoding gathers the tokens'
bytes the same way.

Defined results: a null or empty text has no ids; ids that the vocabulary lacks
stand for nothing; bytes that are no UTF-8 decode to U+FFFD; whole texts of any
length are encoded in linear time, with or without forced cuts; rows are
independent, so repeated rows repeat their result. Other columns pass through, but
one with the name of an output is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.bytetext import word_hashes
from harrow.llm.common import bounded_batches, spread

#: A vocabulary larger than this is not broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: The longest fragment, in bytes, that is merged beside others; places of such fragments held at once.
MERGED, CELLS = 64, 1 << 20
#: Pairs of tokens that a worker remembers for longer fragments.
PAIRS = 100_000
#: Characters handled at once; a longer text is handled by itself.
CHUNK = 1 << 21
#: The rank of a pair that has no merge.
NONE = (1 << 31) - 1
#: Classes of characters, as the pre-token pattern of byte-level BPE tells them apart.
OTHER, LETTER, NUMBER, BLANK = range(4)
#: What stands by itself after an apostrophe (fixed values).
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    out = np.zeros(len(every), np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def pre_token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a pre-token starts; ``first``: places of the texts' first characters.

    A pre-token is a run of one class with the one space before it, a run of
    blanks without the last (which goes with what follows if it is a space, and
    stands alone otherwise; at the end of a text the run is whole), or an
    apostrophe with one of the endings.
    """
    n = len(points)
    kind = character_classes()[points]
    begins = np.zeros(n + 1, bool)  # of a text; the end is one too
    begins[first] = begins[n] = True
    start = begins[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    space = points == 0x20
    # the last blank before other text
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~begins[1:n])
    start[last] = True
    start[last[space[last]] + 1] = False
    # apostrophes: alone in their run, without a space before, an ending after
    tick = np.flatnonzero(points[:-1] == 0x27)
    tick = tick[start[tick] & (kind[tick + 1] == LETTER) & ~begins[tick + 1]]
    ending = lambda at, text: np.logical_and.reduce([(at + k < n) & (points[np.minimum(at + k, n - 1)] == ord(c)) & ~begins[np.minimum(at + k, n)] for k, c in enumerate(text, 1)])
    for endings in (SHORT_ENDINGS, LONG_ENDINGS):
        size = len(endings[0])
        for text in endings:
            here = tick[ending(tick, text)]
            start[here + 1] = False
            after = here + size + 1
            start[after[after < n]] = True
    return start


class Codec:
    """Encoder and decoder for one vocabulary file's content."""

    def __init__(self, raw: str):
        import regex

        spec = json.loads(raw)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        symbols = byte_symbols()
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.token_of = {token: i for i, token in self.bytes_of.items()}
        self.longest: dict[bytes, int] = {}  # by the first two bytes: the longest token's length
        for token in self.token_of:
            self.longest[token[:2]] = max(self.longest.get(token[:2], 1), len(token))
        self.forced = np.ones(1 << 16, bool)  # by the pair's two bytes
        for token in self.token_of:
            pairs = np.frombuffer(token, np.uint8).astype(np.int64)
            self.forced[pairs[:-1] << 8 | pairs[1:]] = False
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        size = np.array([len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of, default=-1) + 1)], np.int64)
        self.bytes_end = np.r_[0, np.cumsum(size)]
        self.bytes_all = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(size))), np.uint8)
        if any(c not in vocab for c in symbols):
            raise ValueError("the vocabulary must hold every byte")
        self.first = np.array([vocab[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int32)  # by byte
        self.merges, merged = {}, []  # rank by pair, and the token that it gives
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((vocab[a], vocab[b]), rank)
            merged.append(vocab[a + b])
        self.merged = np.array(merged, np.int32)
        keys = np.array([a * len(self.bytes_end) + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.merge_key, self.merge_rank = keys[order], np.fromiter(self.merges.values(), np.int32)[order]
        self.first_rank = self.rank(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256).astype(np.int32)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.added_bytes = {t.encode(): [i] for t, i in self.added.items()}
        self.standing = Memory(self.stands, PAIRS)

    # fragments

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of tokens ``a`` and ``b``; NONE where there is none."""
        key = a.astype(np.int64) * len(self.bytes_end) + b
        at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
        return np.where(self.merge_key[at] == key, self.merge_rank[at], NONE)

    def merge_many(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each) by BPE's definition for many fragments of at most MERGED bytes.

        A fragment is a row; in each round every row merges its pair of the
        lowest rank, leftmost among equals. ``follow`` and ``before`` are the
        places of the neighbouring tokens; merged ones stay as holes (-1).
        """
        out, counts = np.full(int(size.sum()), -1, np.int32), np.zeros(len(size), np.int64)
        begin = np.cumsum(size) - size
        width = 1
        todo = np.flatnonzero(size)
        while len(todo):
            width = min(2 * width, MERGED)
            rows, todo = todo[size[todo] <= width], todo[size[todo] > width]
            for s in range(0, len(rows), CELLS // width):
                part = rows[s : s + CELLS // width]
                ids = self.merge_block(data, starts[part], size[part], width)
                kept = ids >= 0
                counts[part] = kept.sum(axis=1)
                out[spread(begin[part], counts[part])] = ids[kept]
        return out[spread(begin, counts)], counts

    def merge_block(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """One row of ``width`` + 1 places for each fragment; the last places are holes."""
        place = np.arange(width + 1)
        inside = place < size[:, None]
        raw = data[np.minimum(starts[:, None] + place, len(data) - 1)]
        ids = np.where(inside, self.first[raw], -1)
        rank = np.where(inside[:, 1:], self.first_rank[raw[:, :-1], raw[:, 1:]], NONE)
        follow = np.tile(place + 1, (len(starts), 1))  # at most width: a hole
        before = np.tile(place - 1, (len(starts), 1))
        row = np.arange(len(starts))
        while len(row):
            at = rank[row].argmin(axis=1)
            best = rank[row, at]
            go = best < NONE
            row, at, best = row[go], at[go], best[go]
            gone = follow[row, at]
            after = follow[row, gone]
            ids[row, at], ids[row, gone] = self.merged[best], -1
            follow[row, at], before[row, after] = after, at
            rank[row, at] = rank[row, gone] = NONE
            later = after < size[row]
            r, x, y = row[later], at[later], after[later]
            rank[r, x] = self.rank(ids[r, x], ids[r, y])
            earlier = at > 0
            r, y = row[earlier], at[earlier]
            x = before[r, y]
            rank[r, x] = self.rank(ids[r, x], ids[r, y])
        return ids

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition, for a token or two of a long fragment."""
        get, merged = self.merges.get, self.merged
        ids = self.first[np.frombuffer(data, np.uint8)].tolist()
        found = [get(pair, NONE) for pair in zip(ids, ids[1:])]
        while found and (best := min(found)) != NONE:
            i = found.index(best)
            ids[i : i + 2] = [int(merged[best])]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def stands(self, pair: tuple[int, int]) -> bool:
        """Whether BPE leaves the two tokens (or, after -1, the one) as they are."""
        ids = [i for i in pair if i >= 0]
        return self.merge(b"".join(self.bytes_of[i] for i in ids)) == ids

    def encode_fragment(self, data: bytes) -> list[int]:
        """The only sequence of tokens whose neighbours all stand beside each other: longest tokens first, with backtracking.

        Every prefix has one such sequence, so a place that led nowhere is never tried again and time is linear.
        """
        token, stand, n, longest = self.token_of.get, self.standing, len(data), self.longest
        out, ends, at, dead = [-1], [0], 0, set()
        size = longest.get(data[:2], 1)
        while at < n:
            for size in range(min(size, n - at), 0, -1):
                t = token(data[at : at + size])
                if t is not None and stand[out[-1], t] and at + size not in dead:
                    at += size
                    out.append(t)
                    ends.append(at)
                    size = longest.get(data[at : at + 2], 1)
                    break
            else:
                dead.add(at)
                out.pop()
                ends.pop()
                size, at = at - ends[-1] - 1, ends[-1]
        return out[1:]

    # many texts

    def cuts(self, joined: str, first: np.ndarray, whole: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """(bytes, where each fragment, each text and each added token starts) of texts put one after another.

        ``first``: the texts' first characters; ``whole``: spans of characters that are added tokens.
        """
        raw = joined.encode("utf-8")
        data = np.frombuffer(raw, np.uint8)
        if len(raw) == len(joined):
            points, place = data, None
        else:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            place = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each character starts
        edges = np.unique(np.concatenate([first, *[np.array(w) for w in whole]])) if whole else first
        start = pre_token_starts(points, edges[edges < len(points)])
        at = np.flatnonzero(start) if place is None else place[start]
        cut = np.zeros(len(data), bool)
        cut[1:] = self.forced[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
        cut[at] = True
        byte = (lambda i: i) if place is None else (lambda i: int(place[i]) if i < len(place) else len(data))
        for a, b in whole:
            cut[byte(a) + 1 : byte(b)] = False
        return data, np.flatnonzero(cut), first if place is None else place[first], np.array([byte(a) for a, _ in whole], np.int64)

    def encode_fragments(self, data: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all fragments, number of ids of each); distinct ones of at most MERGED bytes are encoded once.

        ``whole``: starts of the fragments that are added tokens.
        """
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        alone = size > MERGED
        alone[np.searchsorted(starts, whole)] = True
        short, single = np.flatnonzero(~alone), np.flatnonzero(alone)
        _, sample, code = np.unique(word_hashes(data, starts[short], ends[short]), return_index=True, return_inverse=True)
        # a hash only proposes: fragments that differ from their sample are encoded by themselves
        a, b, n = starts[short], starts[short][sample[code]], size[short]
        same = n == n[sample[code]]
        most = np.where(same, n, 0)
        differs = np.flatnonzero(data[spread(a, most)] != data[spread(b, most)])
        same[np.searchsorted(np.cumsum(most), differs, "right")] = False
        other = np.flatnonzero(~same)
        code[other] = len(sample) + np.arange(len(other))
        sample = short[np.concatenate([sample, other])]
        ids, count = self.merge_many(data, starts[sample], size[sample])
        lone = [self.added_bytes.get(raw) or self.encode_fragment(raw) for raw in (data[x:y].tobytes() for x, y in zip(starts[single].tolist(), ends[single].tolist()))]
        each = np.zeros(len(starts), np.int64)
        each[short], each[single] = code, len(sample) + np.arange(len(single))
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(lone), np.int32)])
        count = np.concatenate([count, np.fromiter(map(len, lone), np.int64)])
        begin = np.cumsum(count) - count
        return ids[spread(begin[each], count[each])], count[each]

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for part in chunks(texts):
            joined = "".join(part)
            length = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(length)
            if not joined:
                counts.append(np.zeros(len(part), np.int64))
                continue
            whole = [m.span() for m in self.special.finditer(joined)] if self.special else []
            if whole:  # not across two texts
                whole = [m for i, t in enumerate(part) for a, b in [s.span() for s in self.special.finditer(t)] for m in [(int(ends[i] - length[i]) + a, int(ends[i] - length[i]) + b)]]
            filled = length > 0
            data, starts, begins, added = self.cuts(joined, (ends - length)[filled], whole)
            found, count = self.encode_fragments(data, starts, added)
            upto = np.append(np.cumsum(count) - count, len(found))
            each = np.zeros(len(part), np.int64)
            each[filled] = np.diff(np.append(upto[np.searchsorted(starts, begins)], len(found)))
            ids.append(found)
            counts.append(each)
        return np.concatenate(ids), np.concatenate(counts)

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ``counts`` ids."""
        ids = np.where((ids >= 0) & (ids < len(self.bytes_end) - 1), ids, len(self.bytes_end) - 1) if len(ids) else ids.astype(np.int64)
        begin, end = np.append(self.bytes_end, self.bytes_end[-1])[ids], np.append(self.bytes_end[1:], [self.bytes_end[-1]] * 2)[ids]
        size = end - begin
        upto = np.append(0, np.cumsum(size))
        cut = np.append(0, np.cumsum(counts))
        out, at = [], 0
        while at < len(counts):  # so many texts at once that their bytes stay bounded
            to = max(at + 1, int(np.searchsorted(upto[cut], upto[cut[at]] + CHUNK, "right")) - 1)
            a, b = cut[at], cut[to]
            raw = self.bytes_all[spread(begin[a:b], size[a:b])].tobytes()
            edges = (upto[cut[at : to + 1]] - upto[a]).tolist()
            out += [raw[x:y].decode("utf-8", "replace") for x, y in zip(edges, edges[1:])]
            at = to
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids) -> str:
        return self.decode_many(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """``texts`` in groups of about CHUNK characters."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


class Memory(dict):
    """Remembers ``find``; it is emptied when it is full."""

    def __init__(self, find, entries: int):
        super().__init__()
        self.find, self.entries = find, entries

    def __missing__(self, key):
        found = self.find(key)
        if len(self) >= self.entries:
            self.clear()
        self[key] = found
        return found


@lru_cache(maxsize=2)
def codec(raw: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(raw)


def _vocabulary(spark: SparkSession, path: str):
    raw = Path(path).read_text(encoding="utf-8")
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return spark.sparkContext.broadcast(raw)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)  # a batch holds under 2^31 ids, as its text has fewer bytes
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out`` array<int>: the ids of the whole ``text``."""
    raw = _vocabulary(bounded_batches(df).sparkSession, vocabulary)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _lists(*codec(raw.value).encode_many(texts.to_pylist()))

    return df.withColumn(out, encode(F.col(text)))


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` string: the text that ``ids`` stand for (null: empty), special tokens included."""
    raw = _vocabulary(bounded_batches(df).sparkSession, vocabulary)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        counts = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = rows.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        return pa.array(codec(raw.value).decode_many(ids, counts), pa.string())

    # not a call on the encoder's own call: two chained calls would run the encoder twice
    return df.withColumn(out, decode(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def bpe_round_trip(df: DataFrame, vocabulary: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add ``out``: struct<ids, decoded>, the text's ids and what they decode to, in one pass with one worker per task."""
    raw = _vocabulary(bounded_batches(df).sparkSession, vocabulary)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        c = codec(raw.value)
        ids, counts = c.encode_many(texts.to_pylist())
        return pa.StructArray.from_arrays([_lists(ids, counts), pa.array(c.decode_many(ids, counts), pa.string())], ["ids", "decoded"])

    return df.withColumn(out, both(F.col(text)))

"""Phrase collocations by Toivonen's mining: exact counts, wherever the sample errs.

A bounded sample proposes phrases that are frequent. A full pass then counts, in
every text, the phrases all of whose shorter parts are proposed: the proposed ones
and their negative border. A border phrase that turns out frequent means that
longer phrases over it were not counted; it joins the proposals and a further pass
counts what became countable only now, until no pass finds such a failure. A
phrase is counted whole in exactly one pass, the first that admits it and its
parts, so the result does not depend on the sample.

These passes count phrases by 64-bit hashes: two phrases with one hash only make it
look more frequent, so what they find holds every frequent phrase. A last pass
counts what they found by its words, exactly. Tasks work on chunks of text with
numpy and Arrow and give distinct phrases with their counts, which Spark sums
before and after the shuffle; which phrases are proposed is told to them by bit
maps of bounded size, whose false hits only count a phrase that need not be.

Defined results: a null text is empty; a null group is ``und``; texts and pieces
are whole, however long; repeated rows count again; ties are ordered by phrase; an
empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.bytetext import mix, word_hashes, word_spans
from harrow.llm.common import bounded_batches, lookup, marked, materialize

#: Words of a phrase at most, occurrences at least, phrases of a group that are given, and the share (in 100) of a longer phrase that makes a part redundant.
LONGEST, LEAST, TOP, PART = 3, 10, 2000, 50
#: Documents of the sample (about), how often of a phrase's share it must hold it, and the bits of a map at most.
SAMPLE_ROWS, LOWERED, MOST_BITS = 10_000, 0.5, 1 << 27
#: Bits of a map for each phrase in it, up to that.
KEY_BITS = 64
#: Bytes of text that are counted at once; longer texts are cut where pieces end.
CHUNK = 1 << 20
#: Hashes that a task holds before it gives their counts.
HELD = 3_000_000
#: Parts in which a group's phrases are ranked before its best ones meet.
PARTS = 64
#: Bytes that end a piece, and that part words (fixed values).
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = 21
_HASHED = pa.schema([("size", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])
_SPELLED = pa.schema([("grp", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def turned(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(_TURN)) | (h >> np.uint64(64 - _TURN))


def bit_map(known: DataFrame, size: int, most: int = MOST_BITS) -> np.ndarray:
    """Bits of the known hashes of a size. At most ``most`` bits come to the driver."""
    of_size = known.where(F.col("size") == size)
    bits = int(min(most, max(1 << 15, 1 << (KEY_BITS * max(1, of_size.count()) - 1).bit_length())))
    at = of_size.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at"))
    pages = at.groupBy(F.expr("at div 32768").alias("page")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in pages.collect():
        out[row["page"] * 4096 : (row["page"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Words:
    """The words of a chunk of texts: bytes, starts, ends, number of the piece, and number of the group among ``names``."""

    def __init__(self, texts: list[bytes], groups: list[str]):
        self.data = _LOWER[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
        self.kind = _KIND[self.data]
        self.starts, self.ends = word_spans(self.kind == 0)
        # texts stand on lines of their own, so no piece spans two
        self.piece = np.cumsum(self.kind == 2, dtype=np.int32)[self.starts]
        text = np.searchsorted(np.cumsum([1] + [len(t) + 1 for t in texts]), self.starts, "right") - 1
        names, of_text = np.unique(np.array(groups, object), return_inverse=True)
        self.names, self.group = names.tolist(), of_text[text]

    def hashes(self) -> np.ndarray:
        """Of each word with its group."""
        groups = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in self.names], np.uint64)
        return mix(word_hashes(self.data, self.starts, self.ends) ^ groups[self.group])

    def spelled(self) -> pa.DictionaryArray:
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int32)
        letters = self.data[self.kind == 0].tobytes()
        return pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()


def next_size(at: np.ndarray, piece: np.ndarray, size: int) -> np.ndarray:
    """Where in ``at`` (words at which phrases of ``size - 1`` begin) one begins that the next word's phrase continues in the same piece."""
    here = np.flatnonzero(at[1:] == at[:-1] + 1)
    begin = at[here]
    return here[piece[begin] == piece[begin + size - 1]]


def hashed(chunks: Iterator[Words], maps: list[list[np.ndarray]] | None, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts by hash of what the last maps admit and no earlier ones did; without maps, of all."""
    held: dict[int, list[np.ndarray]] = {size: [] for size in range(1, longest + 1)}

    def given() -> Iterator[pa.RecordBatch]:
        for size, parts in held.items():
            number, kinds = pd.factorize(np.concatenate([*parts, np.zeros(0, np.uint64)]))
            parts.clear()
            if len(kinds):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), size, np.int32)), pa.array(kinds.view(np.int64)), pa.array(np.bincount(number))], schema=_HASHED)

    for words in chunks:
        for size, h in admitted_hashes(words, maps, longest):
            held[size].append(h)
        if sum(len(h) for parts in held.values() for h in parts) >= HELD:
            yield from given()
    yield from given()


def admitted_hashes(words: Words, maps: list[list[np.ndarray]] | None, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    word = words.hashes()
    at, h, new = np.arange(len(word)), word, np.full(len(word), maps is None or len(maps) == 1)
    # by map: whether that pass counted the phrase at each place; a false hit alone never did
    counted = [np.ones(len(word), bool) for _ in maps or ()]
    for size in range(1, longest + 1):
        if size > 1:
            here = next_size(at, words.piece, size)
            if maps is None:
                new = np.ones(len(here), bool)
            else:
                known = [c & has(m[size - 2], h) for c, m in zip(counted, maps)]
                admitted = [k[here] & k[here + 1] for k in known]
                new = admitted[-1]
                for earlier in admitted[:-1]:
                    new = new & ~earlier
                some = np.logical_or.reduce(admitted)
                here, new, counted = here[some], new[some], [a[some] for a in admitted]
            h, at = turned(h[here]) ^ word[at[here] + size - 1], at[here]
        yield size, h[new]


def spelled(chunks: Iterator[Words], maps: list[np.ndarray], longest: int) -> Iterator[pa.RecordBatch]:
    for words in chunks:
        yield from spelled_chunk(words, maps, longest)


def spelled_chunk(words: Words, maps: list[np.ndarray], longest: int) -> Iterator[pa.RecordBatch]:
    """Counts by their words of the phrases whose hashes are in the maps, and of all words of each group (size 0)."""

    def rows(size: int, group: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.names, pa.string()).take(pa.array(group)), pa.array(np.full(len(n), size, np.int32)), phrase, pa.array(n.astype(np.int64))], schema=_SPELLED)

    yield rows(0, np.arange(len(words.names)), pa.array([""] * len(words.names)), np.bincount(words.group, minlength=len(words.names)))
    word, every = words.hashes(), words.spelled()
    spelling, code = every.dictionary, every.indices.to_numpy().astype(np.int64)
    at, h, left = np.arange(len(word)), word, words.group.astype(np.int64)
    phrases = group = None
    for size in range(1, longest + 1):
        if size > 1:
            here = next_size(at, words.piece, size)
            h, left, at = turned(h[here]) ^ word[at[here] + size - 1], number[here], at[here]
        found = has(maps[size - 1], h)
        at, h, left = at[found], h[found], left[found]
        last = code[at + size - 1]
        number, kinds = pd.factorize(left * len(spelling) + last)
        if not len(kinds):
            return
        first, end = kinds // len(spelling), spelling.take(pa.array(kinds % len(spelling)))
        phrases = end if size == 1 else pc.binary_join_element_wise(phrases.take(pa.array(first)), end, " ")
        group = first if size == 1 else group[first]
        yield rows(size, group, phrases, np.bincount(number))


def pieces_of(text: bytes, most: int) -> Iterator[bytes]:
    """The text, or parts of about ``most`` bytes that end where a piece ends."""
    while len(text) > most:
        cut = max(text.rfind(bytes([e]), 0, most) for e in ENDS)
        if cut < 0:
            later = [k for e in ENDS if (k := text.find(bytes([e]), most)) >= 0]
            if not later:
                break
            cut = min(later)
        yield text[:cut]
        text = text[cut + 1 :]
    yield text


def chunks_of(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[Words]:
    texts, groups, size = [], [], 0
    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            for part in pieces_of(text.as_py(), chunk):
                texts.append(part)
                groups.append(group)
                size += len(part)
                if size >= chunk:
                    yield Words(texts, groups)
                    texts, groups, size = [], [], 0
    if texts:
        yield Words(texts, groups)


def count_texts(batches: Iterator[pa.RecordBatch], count, maps, longest: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """``count`` of the texts (group, text), in chunks."""
    return count((w for w in chunks_of(batches, chunk) if len(w.starts)), maps.value if maps is not None else None, longest)


def counts(docs: DataFrame, count, maps, longest: int, out: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(maps) if maps is not None else None
    return bounded_batches(docs).mapInArrow(partial(count_texts, count=count, maps=held, longest=longest, chunk=CHUNK), out)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(grp, size, phrase, n): every phrase of up to ``longest`` words that occurs ``least`` times in its group, and each group's words (size 0), counted exactly. ``docs``: grp, text."""

    def by_hash(rows: DataFrame, maps: list[list[np.ndarray]] | None, longest: int, least: int) -> DataFrame:
        found = counts(rows, hashed, maps, longest, "size int, h long, n long")
        return materialize(found.groupBy("size", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("size", "h"), "phrase-hashes")

    share = min(1.0, sample_rows / max(1, docs.count()))
    known = by_hash(docs.sample(fraction=share, seed=7), None, longest - 1, max(2, round(LOWERED * least * share)))
    found, maps = None, []
    while True:
        maps.append([bit_map(known, size) for size in range(1, longest)])
        new = by_hash(docs, maps, longest, least)
        found = new if found is None else found.unionByName(new)
        failed = materialize(new.where(F.col("size") < longest).join(known, ["size", "h"], "left_anti"), "phrases-border")
        if failed.isEmpty():
            break
        known = known.unionByName(failed)
    exact = counts(docs, spelled, [bit_map(found, size) for size in range(1, longest + 1)], longest, "grp string, size int, phrase string, n long")
    summed = exact.groupBy("grp", "size", "phrase").agg(F.sum("n").alias("n"))
    return materialize(summed.where((F.col("n") >= least) | (F.col("size") == 0)), "phrases")


def scored(counted: DataFrame, longest: int = LONGEST, part: int = PART) -> DataFrame:
    """(grp, phrase, a, l, r, score) of the phrases of two words and more that no longer one makes redundant."""
    key = lambda phrase: F.concat("grp", F.lit("\t"), phrase)
    many = counted.where("size >= 2").select("grp", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))
    joined = lambda start, length: F.array_join(F.slice("_w", start, length), " ")
    ends = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), key(joined(*at)).alias("key")) for k in range(1, longest) for side, at in (("l", (1, k)), ("r", (k + 1, longest)))]
    cuts = many.select("grp", "phrase", "a", F.inline(F.filter(F.array(*ends), lambda e: e["k"] < F.col("size"))))
    of = counted.where(F.col("size").between(1, longest - 1)).select(key(F.col("phrase")).alias("key"), F.col("n").alias("f"))
    found = lookup(materialize(cuts, "phrase-cuts"), materialize(of, "phrase-parts"), "key")
    side = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}")
    wide = found.groupBy("grp", "phrase", "a").agg(*[side(k, s) for k in range(1, longest) for s in "lr"])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    wide = wide.withColumns({f"s{k}": F.when(F.col(f"l{k}").isNotNull(), F.call_function("div", big("a") * big("a") * F.lit(1000000).cast("decimal(7,0)"), big(f"l{k}") * big(f"r{k}"))) for k in range(1, longest)})
    cut = lambda k: F.when(F.col(f"s{k}").isNotNull(), F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = wide.select("grp", "phrase", "a", F.array_min(F.filter(F.array(*map(cut, range(1, longest))), lambda c: c.isNotNull())).alias("_c"))
    spans = [(start, length, size) for size in range(3, longest + 1) for length in range(2, size) for start in range(1, size - length + 2)]
    if spans:
        inner = F.array(*[F.when(F.col("size") == size, joined(start, length)) for start, length, size in spans])
        over = many.select("grp", F.explode(F.array_distinct(F.array_compact(inner))).alias("phrase"), F.col("a").alias("_over"))
        best = best.join(over.groupBy("grp", "phrase").agg(F.max("_over").alias("_over")), ["grp", "phrase"], "left").where(F.coalesce(100 * F.col("_over") < part * F.col("a"), F.lit(True)))
    return best.select("grp", "phrase", "a", "_c.l", "_c.r", "_c.score")


def collocations(docs: DataFrame, group: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score): each group's ``top`` phrases. Groups are ranked in parts first, so that no task sorts a whole group."""
    small = docs.select(F.coalesce(F.col(group), F.lit("und")).alias("grp"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = frequent_phrases(small, longest, least, sample_rows)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    parts = scored(counted, longest).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = parts.withColumn("_r", rank("grp", "_part")).where(F.col("_r") <= top).drop("_r", "_part")
    ranked = few.withColumn("rank", rank("grp").cast("long")).where(F.col("rank") <= top)
    words = materialize(counted.where("size = 0").groupBy("grp").agg(F.sum("n").alias("n")), "group-words")
    return marked(ranked, words, ["grp"], "inner").select("grp", "rank", "phrase", "a", "l", "r", "n", "score")

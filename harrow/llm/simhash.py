"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into segments. Two fingerprints that differ in few bits
differ in at most one bit of some segment. The anchors of a segment are the
words of a covering code: a Hamming(15, 11) code on its lower 15 bits, which
covers with radius 1, beside the other bits as they are. Every fingerprint has
one home, the nearest anchor, and is replicated to all anchors within covering
radius plus segment threshold (1 + 1) of it; so any two that differ in at most
one bit of a segment meet at the home of either. Per anchor, homes are compared
with replicas, all bits, and a spanning forest of the links found, the closest
first, is emitted, never all pairs.

``near_duplicates``: 64 bits of the XXH64 of word shingles in three segments,
linked at ``distance`` differing bits at most; every such link is found.

``similar_groups``: texts whose sets of five-word shingles have a Jaccard
similarity of at least 0.8, every such pair. Groups of near fingerprints are
compared first, so that copies are one group early. Then a prefix join finds the
rest: sets so alike share one of the rarest fifth of each one's shingles (in any
one order of all shingles; a sample says which are frequent, which decides the
work only). What meets at a shingle and is not in one group yet makes clusters;
inside these, counts in as many bins as a set's size asks for part what cannot be
alike, and what is left is compared, by the sets themselves, in bounded blocks;
only spanning forests leave a block.

Equal fingerprints are one row before that. An anchor with very many members is
cut into bounded blocks of homes by blocks of replicas. Components are found by
contraction on the links.

Defined results: a null text is empty; texts without words have fingerprint zero
and are linked like any other; rows with a null id count for links but never
name a component unless all its ids are null; repeated rows are in one
component; columns of the input may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from harrow.llm.bytetext import groups, mix, word_hashes, word_spans
from harrow.llm.common import bounded_batches, fresh, lookup, marked, materialize, spread
from harrow.operators.graph import components

#: Words in a shingle; differing bits that still link.
SHINGLE, DISTANCE = 4, 4
#: Shingles and Jaccard similarity of ``similar_groups``.
WORDS, SIMILARITY = 5, 0.8
#: Documents of the sample (about) that tells frequent shingles, and of these at most so many.
SAMPLE_ROWS, FREQUENT = 5_000, 100_000
#: Sets of one cell that are compared in one block, and distinct shingles at once.
SETS, COLUMNS = 1024, 4096
#: Shingles of a block's sets that are at hand at once, about.
HELD = 1 << 20
#: A shingle is counted pair by pair if at most one pair of sets in FEW shares it.
FEW = 256
#: Of each set the rarest shingles at which it is compared before all of its prefix; bins of its shingles' counts.
EARLY, BINS = 3, 64
#: Shingles of a set by bin of its finer counts (6 to 12), and of such bins at most.
BIN_SIZE, MOST_BINS = 6, 4096
#: Column, lowest bit and width of each segment; code bits are the lowest 15.
SEGMENTS = (("fp", 0, 21), ("fp", 21, 21), ("fp", 42, 22))
WIDE = tuple((p, low, 16) for p in ("p0", "p1") for low in (0, 16, 32, 48))
CODE = 15
#: Homes and replicas of an anchor that are compared in one block.
BLOCK = 2048
#: Pairs held at once in a task; shingle hashes held at once.
PAIRS, HASHES = 1 << 19, 1 << 16


def fingerprint_of(text: str | None, size: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the text's shingles, as a signed number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    spans = zip(starts, ends[size - 1 :]) if len(words) >= size else iter([(0, len(joined) + 1)])
    counts, n = np.zeros(64, np.int64), 0
    while len(block := np.fromiter((xxh64_intdigest(joined[a : b - 1], 42) for a, b in islice(spans, HASHES)), np.uint64)):
        bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(counts * 2 > n).view(">u8").astype(np.uint64).view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def error_patterns(width: int, radius: int = 2) -> list[list[int]]:
    """By syndrome: what to flip in a segment so that an anchor is reached within ``radius``; the nearest first."""
    patterns: list[list[tuple[int, int]]] = [[] for _ in range(CODE + 1)]
    flips = [(0, 0, 0)] + [(1, 1 << (i - 1), i) for i in range(1, CODE + 1)]
    flips += [(2, 1 << (i - 1) | 1 << (j - 1), i ^ j) for i in range(1, CODE + 1) for j in range(1, i)]
    free = [1 << b for b in range(CODE, width)]
    free_flips = [(0, 0)] + [(1, f) for f in free] + [(2, f | g) for k, f in enumerate(free) for g in free[:k]]
    for n, e, s in flips:
        patterns[s] += [(n + m, e | f) for m, f in free_flips if n + m <= radius]
    return [[e for _, e in sorted(p)] for p in patterns]


def syndrome_of(bits: Column) -> Column:
    """XOR of the places (from 1) of the set code bits; 0 for a code word."""
    out = F.lit(0)
    for k in range(4):
        mask = sum(1 << (i - 1) for i in range(1, CODE + 1) if i >> k & 1)
        out = out + F.shiftleft(F.bit_count(bits.bitwiseAND(F.lit(mask))) % 2, k)
    return out


def replicas(fingerprints: DataFrame, segments=SEGMENTS, band: Column | None = None) -> DataFrame:
    """The fingerprints' columns to (anchor, columns, home): the home and the replicas of every segment; an anchor number holds its segment.

    ``band``: a number; only fingerprints whose bands differ by half at most need
    to meet. A home stands in the whole band that it is in, replicas in both that
    they are within half of.
    """
    columns = list(dict.fromkeys(c for c, _, _ in segments))
    parts = []
    for k, (column, low, width) in enumerate(segments):
        table = F.array(*[F.array(*[F.lit(e) for e in p]) for p in error_patterns(width)])
        bits = F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        flips = F.element_at(table, syndrome_of(bits) + 1)
        parts.append(F.struct(F.lit(k).alias("k"), bits.alias("bits"), flips.alias("flips")))
    zero = F.lit(0)
    bands = F.array(zero, zero, zero) if band is None else F.array(F.floor(band), F.floor(band - 0.5), F.floor(band + 0.5))
    one = fingerprints.select(*columns, bands.cast("array<int>").alias("bands"), F.explode(F.array(*parts)).alias("s"))
    each = one.select(*columns, "bands", "s.k", "s.bits", F.posexplode("s.flips").alias("i", "e"))
    anchor = F.shiftleft(F.col("k").cast("long"), 40) + F.col("bits").bitwiseXOR(F.col("e"))
    place = lambda n, home: F.struct(F.get("bands", F.lit(n)).alias("band"), F.lit(home).alias("home"))
    as_replica = [place(1, False)] if band is None else [place(1, False), place(2, False)]
    # the nearest anchor is both the home and a replica
    places = F.when(F.col("i") == 0, F.array(place(0, True), *as_replica)).otherwise(F.array(*as_replica))
    spots = each.select(anchor.alias("anchor"), *columns, F.explode(places).alias("p"))
    return spots.select((F.col("anchor") + F.shiftleft(F.col("p.band").cast("long"), 32)).alias("anchor"), *columns, F.col("p.home").alias("home"))


def blocked(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``cell``: the anchor, or for a crowded one a block of its homes by a block of its replicas."""
    columns = [c for c in rows.columns if c not in ("anchor", "home")]
    sizes = rows.groupBy("anchor").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("r"))
    crowded = sizes.where(F.col("h") * F.col("r") > block * block).select(
        "anchor", F.ceil(F.col("h") / block).cast("int").alias("hb"), F.ceil(F.col("r") / block).cast("int").alias("rb")
    )
    crowded = materialize(crowded, "simhash-crowded")
    own = lambda n: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    cells = F.when(F.col("hb").isNull(), F.array(F.col("anchor"))).when(
        F.col("home"), F.transform(F.sequence(F.lit(0), F.col("rb") - 1), lambda j: F.xxhash64("anchor", own("hb"), j))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda i: F.xxhash64("anchor", i, own("rb"))))
    return rows.join(crowded, "anchor", "left").select(F.explode(cells).alias("cell"), *columns, "home")


def forest(x: np.ndarray, y: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the links between fingerprints (rows of ``x`` and ``y``) make a spanning forest, the closest first, ties by fingerprint: each round every component takes its first link."""
    both = np.concatenate([x, y])
    by = np.lexsort(both.T[::-1])
    new = np.ones(len(by), bool)
    new[1:] = (both[by[1:]] != both[by[:-1]]).any(axis=1)
    ends = np.empty(len(by), np.int64)
    ends[by] = np.cumsum(new) - 1
    nodes, a, b = np.flatnonzero(new), ends[: len(x)], ends[len(x) :]
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), distance))
    a, b = a[order], b[order]
    root, kept = np.arange(len(nodes)), np.zeros(len(order), bool)
    alive = np.arange(len(order))
    while len(alive):
        ra, rb = root[a[alive]], root[b[alive]]
        alive, ra, rb = alive[ra != rb], ra[ra != rb], rb[ra != rb]
        if not len(alive):
            break
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, ra, alive)
        np.minimum.at(best, rb, alive)
        take = np.unique(best[best < len(order)])
        kept[take] = True
        u, v = root[a[take]], root[b[take]]
        while True:  # the taken links' components: the smallest root of each
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return order[kept]


def compare(distance: int, columns: list[str]):
    """Per cell: homes against replicas; rows come sorted by cell."""

    def links(cell: np.ndarray, prints: np.ndarray, home: np.ndarray) -> Iterator[pd.DataFrame]:
        hc, hf, rc, rf = cell[home], prints[home], cell[~home], prints[~home]
        low, high = np.searchsorted(hc, rc, "left"), np.searchsorted(hc, rc, "right")
        count = high - low
        upto = np.cumsum(count)
        at = 0
        while at < len(rc):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            n = count[at:to]
            r, h = np.repeat(np.arange(at, to), n), spread(low[at:to], n)
            bits = sum(np.bitwise_count((hf[h, k] ^ rf[r, k]).view(np.uint64)).astype(np.int64) for k in range(prints.shape[1]))
            near = np.flatnonzero((bits > 0) & (bits <= distance))
            if len(near):
                near = near[forest(hf[h[near]], rf[r[near]], bits[near])]
                x, y = hf[h[near]], rf[r[near]]
                turn = np.zeros(len(x), bool)  # the smaller fingerprint first
                for k in range(x.shape[1] - 1, -1, -1):
                    turn = np.where(x[:, k] == y[:, k], turn, x[:, k] > y[:, k])
                a, b = np.where(turn[:, None], y, x), np.where(turn[:, None], x, y)
                yield pd.DataFrame({f"a_{c}": a[:, k] for k, c in enumerate(columns)} | {f"b_{c}": b[:, k] for k, c in enumerate(columns)})
            at = to

    def of(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return links(part["cell"].to_numpy(), part[columns].to_numpy(np.int64), part["home"].to_numpy(bool))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["cell"].to_numpy()[-1]
            whole = int(np.searchsorted(batch["cell"].to_numpy(), last, "left"))
            if whole or (kept and kept[-1]["cell"].iloc[-1] != last):
                full = pd.concat([*kept, batch.iloc[:whole]])
                kept = []
                yield from of(full)
            kept.append(batch.iloc[whole:])
        if kept:
            yield from of(pd.concat(kept))

    return run


def met(replicated: DataFrame, distance: int) -> DataFrame:
    """Distinct links (a_, b_ and the fingerprints' columns) between what meets at an anchor and is within ``distance``."""
    cells = blocked(replicated)
    columns = [c for c in cells.columns if c not in ("cell", "home")]
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    out = ", ".join(f"{side}_{c} long" for side in "ab" for c in columns)
    return dealt.mapInPandas(compare(distance, columns), out).distinct()


def links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct ``fp`` to links (a, b) that connect exactly what is within ``distance``."""
    if distance > 5:
        raise ValueError("segments are covered for up to 5 differing bits")  # 5 over 3 segments: at most one in some segment
    return met(replicas(fingerprints), distance).toDF("a", "b")


def components_of(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, first) and the links between nodes to a written table (node, root, component_id): the smallest ``first`` of each component."""
    labels = components(links)
    linked = labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct())
    linked = materialize(linked.join(classes, "node").select("node", "root", "first"), "simhash-linked")
    named = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-named")
    found = lookup(linked.select("node", "root"), named, "root").select("node", "root", "component_id")
    alone = classes.join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.col("first").alias("component_id"))
    return materialize(found.unionByName(alone), "simhash-components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: key, text_hash, fp, root (of fingerprints), component_id."""
    prints = materialize(bounded_batches(docs).select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), fingerprint(text).alias("node")), "simhash-prints")
    classes = materialize(prints.groupBy("node").agg(F.min("id").alias("first")), "simhash-classes")
    found = components_of(classes, links(classes.select(F.col("node").alias("fp")), distance))
    return lookup(prints, found, "node").select(F.col("id").alias(key), "text_hash", F.col("node").alias("fp"), "root", "component_id")


_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_hashes(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the rows' shingles one after another, their number by row): words as for the fingerprint, the whole sequence if it is shorter."""
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    lower[[0x20, *range(0x09, 0x0E)]] = 0
    for first, data, starts in groups(texts):
        low = lower[data]
        a, b = word_spans(low > 0)
        words, bounds = word_hashes(low, a, b), np.searchsorted(a, starts)
        n = np.diff(bounds)
        count = np.where(n >= size, n - size + 1, n > 0).astype(np.int64)
        at, held = spread(bounds[:-1], count), np.minimum(np.repeat(n, count), size)
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            there = held > k
            h[there] += words[at[there] + k] * _A[k]
        yield first, mix(h), count


@F.pandas_udf(BinaryType())
def binned(sets: pd.Series) -> pd.Series:
    """Of a set how many shingles are in each of BINS bins, 255 at most."""
    return pd.Series([np.minimum(np.bincount(s & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes() for s in sets], dtype=object)


def finer(s: np.ndarray) -> np.ndarray:
    """Of a set how many shingles are in each bin, 255 at most; the number of bins, a power of two, grows with the set."""
    n = min(MOST_BINS, max(BINS, 1 << (len(s) // BIN_SIZE).bit_length() - 1)) if len(s) >= BIN_SIZE else BINS
    return np.minimum(np.bincount(s & (n - 1), minlength=n), 255).astype(np.uint8)


@F.pandas_udf(BinaryType())
def finely_binned(sets: pd.Series) -> pd.Series:
    return pd.Series([finer(s).tobytes() for s in sets], dtype=object)


def folded(bins: np.ndarray, n: int) -> np.ndarray:
    """Rows of counts in ``n`` bins instead of more; as before 255 at most, so that two rows never come apart."""
    return np.minimum(bins.reshape(len(bins), -1, n).sum(axis=1), 255).astype(np.uint8)


@F.pandas_udf(StructType([StructField("fp", LongType()), StructField("s", ArrayType(IntegerType()))]))
def sketch(texts: pd.Series) -> pd.DataFrame:
    """64 bits from the shingles' hashes, repeats included, and the distinct shingles as 32 bits of their hashes, sorted."""
    prints, sets = np.zeros(len(texts), np.int64), []
    for first, h, count in shingle_hashes(texts.tolist(), WORDS):
        for k, part in enumerate(np.split(h, np.cumsum(count)[:-1]), first):
            sets.append(np.unique(part.astype(np.uint32).view(np.int32)))
            if len(part):
                ones = np.zeros(64, np.int64)
                for at in range(0, len(part), HASHES):
                    ones += np.unpackbits(part[at : at + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                prints[k] = np.packbits(ones * 2 > len(part)).view(">u8").astype(np.uint64).view(np.int64)[0]
    return pd.DataFrame({"fp": prints, "s": pd.Series(sets, dtype=object)})


def prefixes(frequent, similarity: float):
    """Of a set its rarest shingles, as many as make sure that any set that is ``similarity`` alike has one of them among its own."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def of(sets: pd.Series) -> pd.Series:
        known, often = frequent.value
        out = []
        for s in sets:
            at = np.searchsorted(known, s)
            at[at == len(known)] = 0
            n = np.where(known[at] == s, often[at], 0) if len(known) else np.zeros(len(s), np.int64)
            most = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 if len(s) else 0
            out.append(s[np.lexsort((s, n))[:most]])
        return pd.Series(out, dtype=object)

    return of


def frequent_shingles(sets: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample of ``n`` sets, sorted, and how often they are in it."""
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    by = sets.sample(fraction=share, seed=7).select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    rows = by.orderBy(F.desc("n"), "x").limit(FREQUENT).toPandas().sort_values("x")
    return rows["x"].to_numpy(np.int32), rows["n"].to_numpy(np.int64)


def shared_shingles(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many members each set (sorted) of ``x`` shares with each of ``y``; of a set and itself (``y`` is ``x``) only those that others have, too.

    Counted by ranges of the shingles, so that about HELD of them are at hand, however large the sets are.
    """
    edges = np.linspace(-(1 << 31), 1 << 31, sum(len(s) for s in (x if y is x else [*x, *y])) // HELD + 2).astype(np.int64)
    out = np.zeros((len(x), len(y)), np.float32)
    for low, high in zip(edges[:-1], edges[1:]):
        part = lambda sets: [s[slice(*np.searchsorted(s, [low, high]))] for s in sets] if len(edges) > 2 else sets  # noqa: B023, E731
        own = part(x)
        out += shared_in_range(own, own if y is x else part(y))
    return out


def shared_in_range(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """As ``shared_shingles``: those that many sets have are counted by matrix products, the others pair by pair."""
    out = np.zeros((len(x), len(y)), np.float32)
    places = [np.concatenate(sets) for sets in (x, y)]
    both = np.unique(places[0]) if y is x else np.intersect1d(*places)
    held = []
    for sets, every in zip((x, y), places):
        at = np.searchsorted(both, every)
        at[at == len(both)] = 0
        found = both[at] == every if len(both) else np.zeros(len(every), bool)
        held.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[found], at[found]))
    count = [np.bincount(column, minlength=len(both)) for _, column in held]
    pairs = count[0] * count[1]
    often = np.flatnonzero(pairs * FEW > len(x) * len(y))
    name = np.full(len(both), -1)
    name[often] = np.arange(len(often))
    for low in range(0, len(often), COLUMNS):
        width = min(COLUMNS, len(often) - low)
        parts = []
        for sets, (row, column) in zip((x, y), held):
            here = (name[column] >= low) & (name[column] < low + width)
            one = np.zeros((len(sets), width), np.float32)
            one[row[here], name[column[here]] - low] = 1
            parts.append(one)
        out += parts[0] @ parts[1].T
    seldom = (pairs * FEW <= len(x) * len(y)) & (pairs > (1 if y is x else 0))
    (a, column), (b, other) = ((row[o], c[o]) for row, c in held for o in [np.flatnonzero(seldom[c])[np.argsort(c[seldom[c]], kind="stable")]])
    first, n = np.searchsorted(other, column), count[1][column]
    upto, k = np.cumsum(n), 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS, "right")))
        np.add.at(out, (np.repeat(a[k:to], n[k:to]), b[spread(first[k:to], n[k:to])]), 1)
        k = to
    return out


def alike(similarity: float):
    """Per cell: a spanning forest, over the groups that are there, of the pairs of sets that are alike; rows come sorted by cell."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        own, comp, sets = part["own"].to_numpy(), part["comp"].to_numpy(), [np.asarray(s, np.int32) for s in part["s"]]
        node, n = part["node"].to_numpy(), np.array([len(s) for s in sets], np.int64)
        low, high = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        x = [sets[k] for k in low]
        y = x if own.min() == own.max() else [sets[k] for k in high]
        shared, held = shared_shingles(x, y), []
        step = max(1, HASHES // len(high))
        for k in range(0, len(low), step):  # so many rows that few pairs are held at once
            rows, part_shared = low[k : k + step], shared[k : k + step].astype(np.int64)
            near = (part_shared >= similarity * (n[rows][:, None] + n[high][None, :] - part_shared)) & (comp[rows][:, None] != comp[high][None, :])
            a, b = np.nonzero(near)
            if len(a):
                a, b = rows[a], high[b]
                kept = forest(comp[a][:, None], comp[b][:, None], np.zeros(len(a), np.int64))
                held.append((a[kept], b[kept]))
        if not held:
            return pd.DataFrame({"a": node[:0], "b": node[:0]})
        a, b = (np.concatenate(x) for x in zip(*held))
        kept = forest(comp[a][:, None], comp[b][:, None], np.zeros(len(a), np.int64))
        return pd.DataFrame({"a": node[a[kept]], "b": node[b[kept]]})

    return by_block(links)


def closer(similarity: float):
    """As ``alike``, of the pairs whose sizes and finer counts do not forbid ``similarity``, over the sets: if two are that alike, their counts differ by no more than they do."""

    def links(part: pd.DataFrame) -> pd.DataFrame:
        own, comp, node, n = (part[c].to_numpy() for c in ("own", "comp", "node", "n"))
        size = part["bins"].str.len().to_numpy()
        levels = {}  # by number of bins: the rows of the higher block, by size, and their counts
        high = own == own.max()
        for s in np.unique(size[high]):
            rows = np.flatnonzero(high & (size == s))
            rows = rows[np.argsort(n[rows], kind="stable")]
            levels[s] = rows, {s: np.frombuffer(b"".join(part["bins"].iloc[rows]), np.uint8).reshape(-1, s)}
        held = []
        for a in np.flatnonzero(own == own.min()):
            mine = np.frombuffer(part["bins"].iloc[a], np.uint8)[None]
            for s, (rows, counts) in levels.items():
                low, to = np.searchsorted(n[rows], [np.floor(similarity * n[a]), np.ceil(n[a] / similarity) + 1])
                if low == to:
                    continue
                m = min(s, len(mine[0]))
                if m not in counts:
                    counts[m] = folded(counts[s], m)
                theirs, one, b = counts[m][low:to], folded(mine, m), rows[low:to]
                apart = (np.maximum(theirs, one) - np.minimum(theirs, one)).sum(axis=1, dtype=np.uint32)
                b = b[(apart <= (n[a] + n[b]) * (1 - similarity) / (1 + similarity) + 1e-6) & (comp[a] != comp[b])]
                if len(b):
                    held.append((np.full(len(b), a), b))
            if sum(len(b) for _, b in held) > PAIRS:
                held = [near(node, *held)]
        a, b = near(node, *held) if held else (slice(0), slice(0))
        return pd.DataFrame({"a": node[a], "b": node[b]})

    def near(node: np.ndarray, *held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*held))
        kept = forest(node[a][:, None], node[b][:, None], np.zeros(len(a), np.int64))
        return a[kept], b[kept]

    return by_block(links)


def by_block(links):
    """``links`` of the rows of each cell, i and j; rows come sorted by these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            for _, part in batch.groupby(["cell", "i", "j"], sort=False):
                if kept and (kept[-1][["cell", "i", "j"]].iloc[0] != part[["cell", "i", "j"]].iloc[0]).any():
                    yield links(pd.concat(kept))
                    kept = []
                kept.append(part)
        if kept:
            yield links(pd.concat(kept))

    return run


def possible(similarity: float):
    """A spanning forest of the pairs that meet in a cell, are of two groups, and whose sizes, places of the shingle and counts by bin do not forbid ``similarity``; rows come sorted by cell.

    What two sets share is at most what is left of either from their first common
    shingle on, and their bins differ by no more than the sets do.
    """

    def of(part: pd.DataFrame) -> pd.DataFrame:
        cell = part[["cell", "i", "j"]].to_numpy()
        end = np.append(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1, len(cell))
        node, held = part["node"].to_numpy(), []
        comp, n, left = part["comp"].to_numpy(), part["n"].to_numpy(np.int64), (part["n"] - part["at"]).to_numpy(np.int64)
        bins = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(-1, BINS)
        count = end[np.searchsorted(end, np.arange(len(cell)), "right")] - np.arange(len(cell)) - 1
        upto, k = np.cumsum(count), 0
        while k < len(cell):
            to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS, "right")))
            x, y = np.repeat(np.arange(k, to), count[k:to]), spread(np.arange(k, to) + 1, count[k:to])
            least = similarity * (n[x] + n[y]) / (1 + similarity) - 1e-6
            ok = np.flatnonzero((comp[x] != comp[y]) & (np.minimum(left[x], left[y]) >= least))
            for low in range(0, len(ok), HASHES):
                here = ok[low : low + HASHES]
                a, b = x[here], y[here]
                apart = np.abs(bins[a].astype(np.int16) - bins[b]).sum(axis=1)
                near = apart <= n[a] + n[b] - 2 * least[here]
                a, b = node[a[near]], node[b[near]]
                kept = forest(a[:, None], b[:, None], np.zeros(len(a), np.int64)) if len(a) else []
                held.append((a[kept], b[kept]))
            k = to
        if not held:
            return pd.DataFrame({"a": node[:0], "b": node[:0]})
        a, b = (np.concatenate(x) for x in zip(*held))
        kept = forest(a[:, None], b[:, None], np.zeros(len(a), np.int64)) if len(a) else []
        return pd.DataFrame({"a": a[kept], "b": b[kept]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            cell = batch[["cell", "i", "j"]].to_numpy()
            whole = int(np.argmax((cell == cell[-1]).all(axis=1)))  # where the last cell, which may go on, begins
            if whole or (kept and (kept[-1][["cell", "i", "j"]].to_numpy()[-1] != cell[-1]).any()):
                yield of(pd.concat([*kept, batch.iloc[:whole]], ignore_index=True))
                kept = []
            kept.append(batch.iloc[whole:])
        if kept:
            yield of(pd.concat(kept, ignore_index=True))

    return run


def grouped(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with ``comp``: the group that each node is in so far (``labels``: node, root)."""
    known = nodes.join(labels.select("node", F.col("root").alias("comp")), "node", "left")
    return known.withColumn("comp", F.coalesce("comp", "node"))


def met_in_cells(cells: DataFrame, whole: bool) -> DataFrame:
    """(cell, i, j, own, node, comp, and what else ``cells`` has): cells where more than one group meets, by blocks; with ``whole`` all blocks of a crowded cell meet, else each only itself."""
    at = Window.partitionBy("cell")
    open_ = cells.withColumns({"_low": F.min("comp").over(at), "_high": F.max("comp").over(at), "_n": F.count(F.lit(1)).over(at)}).where("_low <> _high")
    blocks = F.ceil(F.col("_n") / SETS).cast("int")
    dealt = open_.select(*cells.columns, blocks.alias("_b"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    met_by = F.sequence(F.lit(0), F.col("_b") - 1) if whole else F.array("own")
    return dealt.withColumn("_o", F.explode(met_by)).select(*cells.columns, F.least("own", "_o").alias("i"), F.greatest("own", "_o").alias("j"), "own")


def in_cells(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").select("cell", "i", "j", "own", "comp", "node", *columns)


def alike_links(cells: DataFrame, prints: DataFrame, similarity: float, whole: bool) -> DataFrame:
    """(a, b): links between sets of one cell (``cells``: cell, node, row, comp) that join groups which were apart; only sets of such cells are read from ``prints`` and moved."""
    open_ = materialize(met_in_cells(cells, whole), "similar-open")
    rows = marked(prints.select("row", "s"), open_, ["row"], "inner")
    return materialize(in_cells(rows, "s").mapInPandas(alike(similarity), "a long, b long").distinct(), "similar-links")


def possible_cells(rare: DataFrame, similarity: float) -> DataFrame:
    """(cell, node): the components of all pairs that a shared rare shingle and the bounds of ``possible`` leave open, so that a set is sent to one cell and not to each of its shingles.

    ``rare``: node, comp, n, bins and p, the rare shingles. Of these only the places go to the cells at first.
    """
    cells = rare.select("node", "comp", F.posexplode("p").alias("at", "cell"))
    rows = met_in_cells(cells, True).join(rare.select("node", "n", "bins"), "node")
    open_ = materialize(in_cells(rows, "n", "at", "bins").mapInPandas(possible(similarity), "a long, b long").distinct(), "similar-possible")
    return linked_roots(open_).select(F.col("root").alias("cell"), "node")


def closer_cells(cells: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """(cell, node): the components of the pairs inside ``cells`` (cell, node, row, comp) that finer counts leave open; the sets stay where they are, only their counts move."""
    open_ = materialize(met_in_cells(cells, True), "similar-wide")
    rows = materialize(open_.select("row").distinct(), "similar-rows")
    counts = marked(prints.select("row", "s"), rows, ["row"], "inner").select("row", F.size("s").cast("long").alias("n"), finely_binned("s").alias("bins"))
    met = open_.join(materialize(counts, "similar-counts"), "row")
    left = materialize(in_cells(met, "n", "bins").mapInPandas(closer(similarity), "a long, b long").distinct(), "similar-closer")
    return linked_roots(left).select(F.col("root").alias("cell"), "node")


def row_key(key: Column) -> Column:
    """The key as text, never null and never equal for a null and another key."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: key, text_hash, root, component_id, linked at a Jaccard similarity of the five-word shingle sets of at least ``similarity``."""
    docs = bounded_batches(docs)
    sketched = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), sketch(text).alias("w"))
    numbered = sketched.select("id", "text_hash", "w.fp", "w.s", F.xxhash64("w.s").alias("node"), F.monotonically_increasing_id().alias("row"))
    prints = materialize(numbered, "similar-prints")
    # of equal sets one row stands for all; a set stays in its row and is read from there
    classes = materialize(prints.groupBy("node").agg(F.min("id").alias("first"), F.min("fp").alias("fp"), F.min("row").alias("row")), "similar-classes")
    near = components(links(classes.select("fp").distinct()))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).toDF("fp", "cell")
    sets = marked(prints.select("row", "s"), classes.select("row", "node"), ["row"], "inner")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(sets, classes.count()))
    rare = sets.select("node", "row", F.size("s").alias("n"), binned("s").alias("bins"), prefixes(frequent, similarity)("s").alias("p"))
    rare = materialize(rare, "similar-prefixes")
    by_print = classes.join(near, "fp", "left").select(F.coalesce("cell", "fp").alias("cell"), "node", "row", F.col("node").alias("comp"))
    found = alike_links(by_print, prints, similarity, False)
    early = rare.select("node", "row", F.slice("p", 1, EARLY).alias("p"))
    early = grouped(early, linked_roots(found)).select("node", "row", "comp", F.explode("p").alias("cell"))
    found = found.unionByName(alike_links(early, prints, similarity, False))
    rare = materialize(grouped(rare, linked_roots(found)), "similar-grouped")
    places = rare.select("node", "row", "comp")
    last = closer_cells(possible_cells(rare, similarity).join(places, "node"), prints, similarity).join(places, "node")
    found = found.unionByName(alike_links(last, prints, similarity, True))
    named = components_of(classes.select("node", "first"), found)
    return lookup(prints.select("id", "text_hash", "node"), named, "node").select(F.col("id").alias(key), "text_hash", "root", "component_id")


def linked_roots(links: DataFrame) -> DataFrame:
    """(node, root) of all that a link has."""
    labels = components(links)
    return materialize(labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct()), "similar-roots")


def keep_first(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``found`` (key, text_hash, root, component_id): one that names it, of repeated rows one.

    What goes, or came more than once, is marked; all other rows stay where they are.
    """
    found = materialize(found.select(row_key(F.col(key)).alias("k"), F.col("text_hash").alias("h"), "root", F.col(key).eqNullSafe(F.col("component_id")).alias("names")), "kept-found")
    rows = found.groupBy("k", "h", "root").agg(F.bool_or("names").alias("names"), F.count(F.lit(1)).alias("n"))
    chosen = found.where("names").groupBy("root").agg(F.min(F.struct("k", "h")).alias("c")).select("root", "c.k", "c.h", F.lit(True).alias("chosen"))
    marks = rows.join(chosen, ["root", "k", "h"], "left").where("chosen IS NULL OR n > 1")
    mk, mh, mark = (fresh(docs, c) for c in ("_k", "_h", "_mark"))
    marks = materialize(marks.select(F.col("k").alias(mk), F.col("h").alias(mh), F.when(F.col("chosen"), "again").otherwise("goes").alias(mark)), "kept-marks")
    seen = marked(docs.withColumns({mk: row_key(F.col(key)), mh: F.xxhash64(text)}), marks, [mk, mh], "left")
    again = seen.where(F.col(mark) == "again").dropDuplicates([mk, mh])
    return seen.where(F.col(mark).isNull()).unionByName(again).select(*docs.columns)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of similar texts, the one with the smallest key."""
    return keep_first(docs, similar_groups(docs, key, text, similarity), key, text)

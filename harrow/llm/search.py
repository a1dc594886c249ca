"""Exact BM25 top-k search over sharded inverted indexes with block-max pruning.

Index: every task turns the documents it reads into shards of bounded size, one
row each: sorted term hashes, and for each term its postings (document number,
frequency). A shard's documents are numbered so that like ones stand together
(``arranged``). No text is shuffled. Global statistics (documents, words, document
frequency of each term) are summed over the shards.

Search: a shard's documents are cut into ranges of RANGE, and like queries of a
block are searched together, a chunk at once. A term that many documents of a range
hold is a row of the range's matrix, else it has postings. Postings are added up
first, for all documents. What the matrix can add is at most the sum of its largest
contributions to the query's terms, and at most all it holds of the document;
ranges are scored by falling bound with matrix products, of their documents only
those that can beat the k-th hit of a query so far: the block-max test. A task
hands the k-th hit on from shard to shard and gives its hits once, at its end.
Contributions are whole numbers of 1e-6, so sums are exact (far under 2^53), bounds
are never under a score, and ties are ties; among equal scores the smaller document
id wins, and a range of larger ids with an equal bound is pruned too. Tasks' hits
are merged exactly, as all use the global statistics.

A departure from the usual algorithm: there is no pivot that skips from document
to document by a query's sorted lists, which numpy cannot do for many queries at
once; the same bounds choose whole ranges of documents instead, best first.

Queries are broadcast in blocks of about QUERY_BLOCK terms, a pass over the index
each. A block's hits are written before the next block is read, so the driver, the
plan and the executors hold one block at a time, however many queries there are.

Defined results: words are runs of letters, digits and non-ASCII, lower-cased
A-Z; null and empty texts have none, match nothing and find nothing; rows
without an id are not indexed and ask nothing; repeated rows are hits of their
own; queries with equal terms are searched once; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.bytetext import ascii_words, groups, word_hashes
from harrow.llm.common import bounded_batches, materialize, scratch_dir, spread

K1, B, SCALE = 1.2, 0.75, 1e6
#: A shard is closed at so many documents or words; documents in a range.
SHARD_DOCS, SHARD_WORDS, RANGE = 4096, 1 << 20, 256
#: Query terms of a broadcast block; queries searched at once; postings held at once while scoring.
QUERY_BLOCK, QUERY_CHUNK, POSTINGS = 1 << 21, 1 << 8, 1 << 15
#: A term that so many documents of a range hold is a row of the range's matrix there, the commonest HOT_TERMS of them; elsewhere it has postings.
HOT, HOT_TERMS = 12, 1024
#: Likeness is seen by so many of the commonest terms, in so many steps; parts of at most so many are not halved again.
LIKE_TERMS, LIKE_STEPS, LIKE_LEAST = 256, 8, 64
#: A query that is cut has the terms that weigh most in it: largest idf * tf (K1 + 1) / (tf + K1).
QUERY_TERMS, TOP = 16, 10

HITS = "query long, doc_id long, score long"
INDEX = "n_docs long, n_words long, ids binary, lengths binary, terms binary, offsets binary, docs binary, tfs binary"


def term_rows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, term hash) of every word, in text order."""
    for first, data, starts in groups(texts):
        low, a, b = ascii_words(data)
        yield first + np.searchsorted(starts, a, "right") - 1, word_hashes(low, a, b)


def arranged(rows: np.ndarray, code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """An order of ``len(size)`` rows in which like ones stand together, by size among those: of (row, number of a term) pairs without repeats.

    Rows are halved along the direction in which their commonest terms differ most
    (power iteration), until parts are small. Any order is right; ranges of like
    documents have bounds close to their scores, and in one language share few
    terms with queries in another.
    """
    n, count = len(size), np.bincount(code)
    seen = np.argsort(-count, kind="stable")[:LIKE_TERMS]
    column = np.full(len(count), -1)
    column[seen] = np.arange(len(seen))
    place = column[code]
    x = np.zeros((n, len(seen)), np.float32)
    x[rows[place >= 0], place[place >= 0]] = 1
    x /= np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)
    first = np.cos(np.arange(len(seen), dtype=np.float32))
    out, parts = [], [(np.arange(n), 0)]
    while parts:
        part, depth = parts.pop()
        if len(part) > LIKE_LEAST and depth < LIKE_STEPS:
            y = x[part] - x[part].mean(axis=0)
            v = first
            for _ in range(LIKE_STEPS):
                v = y.T @ (y @ v)
                v = v / max(float(np.sqrt(v @ v)), 1e-30)
            side = y @ v > 0
            if side.any() and not side.all():
                parts += [(part[side], depth + 1), (part[~side], depth + 1)]
                continue
        out.append(part[np.argsort(size[part], kind="stable")])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def shard_row(ids: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> pd.DataFrame:
    by_term = np.argsort(terms, kind="stable")  # and by row, as rows come in their order
    t, d = terms[by_term], rows[by_term]
    new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (d[1:] != d[:-1])]) if len(t) else np.zeros(0, np.int64)
    tfs = np.diff(np.r_[new, len(t)])
    t, d = t[new], d[new]
    opens = np.r_[True, t[1:] != t[:-1]] if len(t) else np.zeros(0, bool)
    start, code = np.flatnonzero(opens), np.cumsum(opens) - 1
    lengths = np.bincount(rows, minlength=len(ids))
    order = arranged(d, code, lengths)
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    again = np.argsort(code * len(ids) + number[d])
    d, tfs, lengths = number[d[again]], tfs[again], lengths[order]
    return pd.DataFrame(
        {
            "n_docs": [len(ids)], "n_words": [len(rows)], "ids": [ids[order].astype(np.int64).tobytes()], "lengths": [lengths.astype(np.int32).tobytes()],
            "terms": [t[start].tobytes()], "offsets": [np.r_[start, len(t)].astype(np.int32).tobytes()], "docs": [d.astype(np.uint16).tobytes()], "tfs": [tfs.astype(np.int32).tobytes()],
        }
    )


def index_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids: list = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        keys, texts = batch.iloc[:, 0].to_numpy(), batch.iloc[:, 1].tolist()
        for s in range(0, len(keys), 512):
            part = texts[s : s + 512]
            for rows, terms in term_rows(part):
                held.append((rows + len(ids), terms))
                size += len(terms)
            ids.extend(keys[s : s + 512])
            if len(ids) + 512 > SHARD_DOCS or size >= SHARD_WORDS:
                yield shard_row(np.array(ids, np.int64), np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                ids, held, size = [], [], 0
    if ids:
        yield shard_row(np.array(ids, np.int64), np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all rows, written to the shared folder: one row per shard."""
    kept = bounded_batches(docs).where(F.col(key).isNotNull()).select(F.col(key).cast("long"), text)
    return materialize(kept.mapInPandas(index_shards, INDEX), "search-index")


def shard_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for terms, offsets in zip(batch["terms"], batch["offsets"]):
            yield pd.DataFrame({"term": np.frombuffer(terms, np.int64), "df": np.diff(np.frombuffer(offsets, np.int32)).astype(np.int64)})


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards."""
    return index.select("terms", "offsets").mapInPandas(shard_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def text_terms(texts: pd.Series) -> pd.Series:
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for rows, terms in term_rows(texts.tolist()):
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for r, t in zip(np.split(rows, cuts), np.split(terms, cuts)):
            if len(r):
                name, place, tf = np.unique(t, return_index=True, return_counts=True)
                out[r[0]] = [{"term": a, "tf": b, "place": c} for a, b, c in zip(name.view(np.int64).tolist(), tf.tolist(), place.tolist())]
    return pd.Series(out, dtype=object)


def idf(df, n: int):
    return F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def queries_from(docs: DataFrame, frequencies: DataFrame, n: int, terms: int | None = QUERY_TERMS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(query, term, idf) with the ``terms`` terms that weigh most (earlier in the text first; None: all), and (key, query) with one query for equal texts."""
    split = F.pandas_udf(text_terms, "array<struct<term:bigint,tf:int,place:int>>")
    asked = docs.where(F.col(key).isNotNull()).select(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"), text)
    members = asked.groupBy("sha").agg(F.min(key).alias("query"))
    first = asked.groupBy("sha").agg(F.min(key).alias("query"), F.first(text).alias("text"))
    each = first.select("query", F.explode(split("text")).alias("t")).select("query", "t.term", "t.tf", "t.place").join(frequencies, "term")
    each = each.withColumn("idf", idf(F.col("df"), n))
    if terms is not None:
        best = Window.partitionBy("query").orderBy((F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1))).desc(), "place")
        each = each.withColumn("r", F.row_number().over(best)).where(F.col("r") <= terms)
    return each.select("query", "term", "idf"), asked.select(key, "sha").join(members, "sha").select(F.col(key), "query")


class Queries:
    """A block of queries as arrays, like ones together, terms by query; a term's idf is the same in all of them."""

    def __init__(self, query: np.ndarray, term: np.ndarray, idf: np.ndarray):
        ids, number = np.unique(query, return_inverse=True)
        self.terms, first, code = np.unique(term.view(np.uint64), return_index=True, return_inverse=True)
        order = arranged(number, code, np.bincount(number, minlength=len(ids)))
        self.ids, place = ids[order], np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        number = place[number]
        order = np.argsort(number, kind="stable")
        self.idf, self.code, self.number = idf[first], code[order].astype(np.int32), number[order].astype(np.int32)


class Shard:
    """A shard's postings of the terms that a block of queries has, as whole contributions."""

    def __init__(self, row, average: float, queries: Queries):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.n_ranges = -(-len(self.ids) // RANGE)
        own, offsets = np.frombuffer(row.terms, np.uint64), np.frombuffer(row.offsets, np.int32).astype(np.int64)
        docs = np.frombuffer(row.docs, np.uint16).astype(np.int64)
        tf, length = np.frombuffer(row.tfs, np.int32).astype(np.float64), np.frombuffer(row.lengths, np.int32).astype(np.float64)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[docs] / average))
        _, at, code = np.intersect1d(own, queries.terms, assume_unique=True, return_indices=True)
        size = offsets[at + 1] - offsets[at]
        take = spread(offsets[at], size)
        docs, gain = docs[take], np.rint(np.repeat(queries.idf[code], size) * part[take] * SCALE)
        start = np.r_[0, np.cumsum(size)]
        span = docs // RANGE
        opens = np.ones(len(span), bool)
        opens[1:] = span[1:] != span[:-1]
        opens[start[:-1]] = True
        block = np.flatnonzero(opens)
        held = np.diff(np.r_[block, len(docs)])
        block_term, block_range = np.searchsorted(start, block, "right") - 1, span[block]
        # the commonest terms of a range are held as its matrix, all others as postings
        common = held >= HOT
        for r in np.flatnonzero(np.bincount(block_range[common], minlength=self.n_ranges) > HOT_TERMS):
            own_blocks = np.flatnonzero(common & (block_range == r))
            common[own_blocks[np.argsort(-held[own_blocks], kind="stable")[HOT_TERMS:]]] = False
        self.local = np.full(len(queries.terms), -1)  # by term of the block: its place here, or -1
        self.local[code] = np.arange(len(at))
        self.hot = np.full(len(at) + 1, -1)  # by place: row of the bounds, or -1; the last is what is not here
        names = np.unique(block_term[common])
        self.hot[names] = np.arange(len(names))
        self.bounds = np.zeros((len(names), self.n_ranges))
        self.bounds[self.hot[block_term[common]], block_range[common]] = np.maximum.reduceat(gain, block)[common] if len(block) else 0
        # by range: its rows of the bounds, and a matrix of their contributions
        self.matrices, self.most = [], np.zeros(len(self.ids))  # and by document, what its range's matrix gives at most
        in_range = np.flatnonzero(common)
        in_range = np.split(in_range[np.argsort(block_range[in_range], kind="stable")], np.cumsum(np.bincount(block_range[in_range], minlength=self.n_ranges))[:-1])
        for r, own_blocks in enumerate(in_range):
            post = spread(block[own_blocks], held[own_blocks])
            matrix = np.zeros((len(own_blocks), min(RANGE, len(self.ids) - r * RANGE)))
            matrix[np.repeat(np.arange(len(own_blocks)), held[own_blocks]), docs[post] - r * RANGE] = gain[post]
            self.matrices.append((self.hot[block_term[own_blocks]], matrix))
            self.most[r * RANGE : (r + 1) * RANGE] = matrix.sum(axis=0)
        rare = np.flatnonzero(np.repeat(~common, held))
        self.docs, self.gain, self.start = docs[rare], gain[rare], np.searchsorted(rare, start)
        self.least_id = np.array([self.ids[r * RANGE : (r + 1) * RANGE].min() for r in range(self.n_ranges)], np.int64)


def best_of(query: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int):
    """The first k of each query by falling score, then document."""
    order = np.lexsort((doc, -score, query))
    query, score, doc = query[order], score[order], doc[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, "left")
    keep = place < k
    return query[keep], score[keep], doc[keep]


class Best:
    """A task's best hits so far, by query of the block; its worst kept hit bounds what later shards must beat."""

    def __init__(self, n: int, k: int):
        self.k, self.hits = k, (np.zeros(0, np.int64),) * 3
        self.least, self.last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.hits = best_of(*(np.concatenate(x) for x in zip(self.hits, (query, score, ids))), self.k)
        q = self.hits[0]
        ends = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) if len(q) else np.zeros(0, np.int64)
        full = ends[np.diff(np.r_[-1, ends]) == self.k]
        self.least[q[full]], self.last[q[full]] = self.hits[1][full], self.hits[2][full]


def search_shard(shard: Shard, queries: Queries, best: Best) -> None:
    """Adds the hits in one shard, for a chunk of the queries at a time."""
    found = []
    for first in range(0, len(queries.ids), QUERY_CHUNK):
        n = min(QUERY_CHUNK, len(queries.ids) - first)
        a, b = np.searchsorted(queries.number, [first, first + n])
        part = slice(first, first + n)
        q, score, ids = search_chunk(shard, n, queries.number[a:b].astype(np.int64) - first, shard.local[queries.code[a:b]], best.least[part].copy(), best.last[part].copy(), best.k)
        found.append((q + first, score, ids))
    if found:
        best.add(*(np.concatenate(x) for x in zip(*found)))


def search_chunk(shard: Shard, n: int, number: np.ndarray, terms: np.ndarray, least: np.ndarray, last: np.ndarray, k: int):
    """(query, score, document id) of what can be among each query's k best. ``least``, ``last``: the score and id to be beaten; equal scores lose from that id on."""
    hot = shard.hot[terms]
    held = np.flatnonzero(hot >= 0)
    hot = hot[held]
    column = np.full(len(shard.bounds), -1)  # of the terms in this chunk
    names = np.flatnonzero(np.bincount(hot, minlength=len(shard.bounds)))
    column[names] = np.arange(len(names))
    asked = np.zeros((n, len(names)))
    asked.ravel()[number[held] * len(names) + column[hot]] = 1
    scores = np.zeros((n, len(shard.ids)))
    flat, known = scores.ravel(), np.flatnonzero(terms >= 0)
    q, first = number[known] * len(shard.ids), shard.start[terms[known]]
    count = shard.start[terms[known] + 1] - first
    some = np.flatnonzero(count)
    q, first, count = q[some], first[some], count[some]
    size = np.cumsum(count)
    shift, cut, before = first - size + count, 0, 0
    while cut < len(size):  # in pieces that stay in the processor's cache
        to = max(cut + 1, int(np.searchsorted(size, before + POSTINGS, "right")))
        post = np.arange(before, size[to - 1])
        post += np.repeat(shift[cut:to], count[cut:to])
        key = shard.docs.take(post)
        key += np.repeat(q[cut:to], count[cut:to])
        np.add.at(flat, key, shard.gain.take(post))
        cut, before = to, size[to - 1]
    begins = np.arange(shard.n_ranges) * RANGE
    # what the postings give is known; the matrix gives at most a query's bound and a document's sum
    most = np.repeat(asked @ shard.bounds[names], np.diff(np.r_[begins, len(shard.ids)]), axis=1)
    most = np.rint(np.minimum(most, shard.most, out=most)) + scores
    bound = np.maximum.reduceat(most, begins, axis=1)
    hits = (np.zeros(0, np.int64),) * 3
    for r in np.argsort(-bound.sum(axis=0), kind="stable"):
        can = (bound[:, r] > least) | ((bound[:, r] == least) & (bound[:, r] > 0) & (shard.least_id[r] < last))
        rows = np.flatnonzero(can)
        if not len(rows):
            continue
        part = slice(begins[r], begins[r] + RANGE)
        docs = np.flatnonzero((most[rows, part] >= least[rows][:, None]).any(axis=0))
        own, matrix = shard.matrices[r]
        here = np.flatnonzero(column[own] >= 0)
        found = scores[rows, part].take(docs, axis=1) + asked[np.ix_(rows, column[own[here]])] @ matrix[here].take(docs, axis=1)
        floor = np.maximum(least[rows], 1)
        open_ = np.flatnonzero(least[rows] == 0)
        if len(open_) and found.shape[1] > k:
            floor[open_] = np.maximum(floor[open_], -np.partition(-found[open_], k - 1, axis=1)[:, k - 1])
        row, doc = np.nonzero(found >= floor[:, None])
        row, score, ids = rows[row], found[row, doc].astype(np.int64), shard.ids[begins[r] + docs[doc]]
        keep = (score > least[row]) | (ids < last[row])
        if not keep.any():
            continue
        hits = best_of(*(np.concatenate(x) for x in zip(hits, (row[keep], score[keep], ids[keep]))), k)
        ends = np.flatnonzero(np.r_[hits[0][1:] != hits[0][:-1], True]) if len(hits[0]) else np.zeros(0, np.int64)
        full = ends[np.diff(np.r_[-1, ends]) == k]
        row, score, ids = (x[full] for x in hits)
        better = (score > least[row]) | ((score == least[row]) & (ids < last[row]))
        least[row[better]], last[row[better]] = score[better], ids[better]
    return hits


def search(index: DataFrame, queries: DataFrame, n_terms: int, k: int = TOP) -> DataFrame:
    """(query, doc_id, score, rank): the k best documents of each query over all shards; ``n_terms``: rows of ``queries``."""
    context = index.sparkSession.sparkContext
    total = index.agg(F.sum("n_docs").alias("d"), F.sum("n_words").alias("w")).first()
    average = max(1e-9, (total["w"] or 0) / max(1, total["d"] or 0))
    blocks = n_terms // QUERY_BLOCK + 1
    # so many tasks that all cores work; each hands its best scores from shard to shard and gives its best hits once
    dealt = index.coalesce(2 * context.defaultParallelism)
    folder = f"{scratch_dir(index.sparkSession).rstrip('/')}/search-hits-{uuid.uuid4().hex}"
    blocked = materialize(queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).repartition(blocks, "block"), "search-blocks")
    for b in range(blocks):
        block = blocked.where(F.col("block") == b).select("query", "term", "idf").toArrow()
        held = context.broadcast(Queries(block["query"].to_numpy(), block["term"].to_numpy(), block["idf"].to_numpy()))
        dealt.mapInPandas(searcher(held, average, k), HITS).write.mode("append").parquet(folder)
        held.destroy()
    hits = index.sparkSession.read.schema(HITS).parquet(folder)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "doc_id", (F.col("score") / SCALE).alias("score"), "rank")


def searcher(held, average: float, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = held.value
        best = Best(len(queries.ids), k)
        for batch in batches:
            for row in batch.itertuples():
                search_shard(Shard(row, average, queries), queries, best)
        query, score, doc = best.hits
        for s in range(0, len(query), 1 << 16):
            yield pd.DataFrame({"query": queries.ids[query[s : s + (1 << 16)]], "doc_id": doc[s : s + (1 << 16)], "score": score[s : s + (1 << 16)]})

    return run


def top_similar(docs: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text", k: int = TOP, terms: int | None = QUERY_TERMS) -> DataFrame:
    """(query_id, doc_id, score, rank): for each row of ``asked`` its k best documents."""
    index = build_index(docs, key, text)
    n = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]
    queries, members = queries_from(asked, document_frequencies(index), n, terms, key, text)
    queries = materialize(queries, "search-queries")
    hits = search(index, queries, queries.count(), k)
    asking = members.select(F.col(key).alias("query_id"), "query")
    return asking.join(hits, "query").select("query_id", F.col("doc_id").alias("hit_id"), "score", "rank")

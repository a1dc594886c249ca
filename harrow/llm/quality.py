"""Quality classifier: supervised subword embeddings.

A document's features are its words (as written, between blanks), the character
3- and 4-grams of each word with its blanks, and each immediate repetition of a
word. Features are hashed into buckets with a learned vector each; a document is
the average of its features' vectors, a softmax layer follows, and both are
trained by plain stochastic gradient descent in numpy.

The output layer is linear in the average, so for scoring each bucket's vector
is multiplied by it once: what is broadcast is one number per bucket.

Defined results: null and empty texts have the score that the bias gives; without
labelled rows of both classes every score is the share of label 1 (0.5 without
labels); whole texts are scored; rows are independent. Other columns pass
through, but one with the name of the output, which is a parameter, is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from harrow.llm.common import bounded_batches
from harrow.llm.bytetext import groups, word_hashes, word_spans
from harrow.llm.training import labelled_sample

BUCKETS_LOG2, DIMENSIONS, EPOCHS, RATE, SEED = 18, 8, 6, 3.0, 7
ACCEPT = 0.7
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def features(data: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of all features of a byte array of texts that start at ``begins``; places are ascending in each pair."""
    shift = np.uint32(32 - BUCKETS_LOG2)
    inside = data > 32
    text = np.where(inside, data, np.uint8(32)).astype(np.uint32)
    out = []
    for n in (3, 4):
        size = len(text) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint32)
        ok = np.ones(size, bool)
        for k in range(n):
            h = (h ^ text[k : k + size]) * _MULTIPLIERS[k]
            if 0 < k < n - 1:
                ok &= inside[k : k + size]
        place = np.flatnonzero(ok)
        h = h[place]
        out.append((place, ((h ^ (h >> np.uint32(15))) * _MULTIPLIERS[0] >> shift).astype(np.int64)))
    starts, ends = word_spans(inside)
    words = word_hashes(data, starts, ends)
    out.append((starts, (words >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)))
    of = np.searchsorted(begins, starts, "right")  # a word that ends the text before is no repeat
    again = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1])) + 1
    out.append((starts[again], np.full(len(again), 1 << BUCKETS_LOG2)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # one number per bucket: logit of label 1 against 0
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, data, starts in groups(texts):
            total, count = np.zeros(len(starts) - 1), np.zeros(len(starts) - 1)
            for place, bucket in features(data, starts):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket], dtype=np.float64)])
                at = np.searchsorted(place, starts - 1)
                total += sums[at[1:]] - sums[at[:-1]]
                count += at[1:] - at[:-1]
            out[first : first + len(total)] += total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(texts: list[str], labels: np.ndarray) -> Model:
    """SGD over documents; each one's buckets are counted once."""
    size = (1 << BUCKETS_LOG2) + 1
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(size, np.float32), float(np.log(p / (1 - p))))
    bags = []
    for t in texts:
        found = [b for _, data, starts in groups([t]) for _, b in features(data, starts)]
        ids, n = np.unique(np.concatenate(found), return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, part = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = part @ vectors[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= np.float32(rate * 0.1) * p
            vectors[ids] -= rate * np.outer(part, back) * len(ids) ** 0.5
    step = layer[:, 1] - layer[:, 0]
    return Model((vectors @ step).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed: Column | None = None, text: str = "text") -> Model:
    sample = labelled_sample(docs, labels, [label], allowed, text=text)
    return train(sample[text].to_pylist(), np.array(sample[label].to_pylist(), np.int64).clip(0, 1))


def with_quality(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Add ``score`` double from 0 to 1. The model has a fixed size (1 MB) and is broadcast."""
    held = bounded_batches(df).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(texts.tolist()))

    return df.withColumn(score, scored(F.col(text)))

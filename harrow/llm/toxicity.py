"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models on which of the
selected marks a document holds; each later model also gets the probabilities
that the earlier ones give. For training these are out-of-fold: a document's
earlier probabilities come from models that have not seen it. The last category
is the one that decides.

Words are runs of letters, digits and non-ASCII, lower-cased A-Z; a document's
marks are its words, the 5-byte pieces of them and their beginnings of 4 to 8
bytes, so that inflected forms share some; what it holds more than once is a mark
besides. Presence, not share, is what counts, so a long document cannot hide a
word. Marks that go with the last category are selected by chi-square, in every
fold anew, so that out-of-fold probabilities owe nothing to a row's own label;
models have a slight ridge penalty.

Defined results: null and empty texts hold no mark; a category without both
classes in the sample has its share as probability everywhere; whole texts are
scored; rows are independent. Other columns pass through, but one with the name of
the output, which is a parameter, is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import bounded_batches
from harrow.llm.bytetext import ascii_words, groups, mix, word_hashes
from harrow.llm.training import labelled_sample

#: The chain, in order; the label table's expressions that define each category.
CATEGORIES = {"toxic_prose": "int(toxic = 1 AND quality = 1)", "toxic_junk": "int(toxic = 1 AND quality = 0)", "toxic": "int(toxic = 1)"}
MARKS, SUPPORT, GRAM, FOLDS, STEPS, PENALTY, REJECT = 256, 0.005, 5, 4, 200, 3e-6, 0.5
#: Documents of the last category that hold a mark, at least.
LEAST = 3
#: Texts whose marks are held at once while fitting.
BLOCK = 64
#: Beginnings of longer words, in bytes, that are marks of their own: inflected forms share them.
PREFIXES = (4, 5, 6, 7, 8)
#: Marks are selected at this chi-square at least (one degree of freedom; hardly a chance find among a hundred thousand).
CHI_SQUARE = 20.0


def held_marks(texts: list[str | None], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and every GRAM bytes inside a word, repeats included; only those in ``only`` if given."""
    rows, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    maybe = None
    if only is not None:
        maybe = np.zeros(1 << 16, bool)
        maybe[(only >> np.uint64(48)).astype(np.int64)] = True
    for first, data, starts in groups(texts):
        low, a, b = ascii_words(data)
        gram = np.flatnonzero(low[: len(low) - GRAM + 1] > 0)
        word_end = b[np.searchsorted(a, gram, "right") - 1] if len(gram) else gram
        gram = gram[gram + GRAM <= word_end]
        spans = [(a, b, 0), (gram, gram + GRAM, 0)] + [(a[b - a > n], a[b - a > n] + n, n) for n in PREFIXES]
        for x, y, kind in spans:
            h = word_hashes(low, x, y)
            if kind:
                h = mix(h ^ np.uint64(kind))  # a beginning is another mark than the same bytes elsewhere
            if maybe is not None:
                here = maybe[(h >> np.uint64(48)).astype(np.int64)]
                h, x = h[here], x[here]
            marks.append(h)
            rows.append(first + np.searchsorted(starts, x, "right") - 1)
    return np.concatenate(rows), np.concatenate(marks)


#: What turns a mark into the mark of holding it more than once.
_AGAIN = np.uint64(0xA0761D6478BD642F)


def again(marks: np.ndarray) -> np.ndarray:
    return mix(marks ^ _AGAIN)


def with_repeats(rows: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, mark), and for what a row holds more than once a second mark."""
    order = np.lexsort((marks, rows))
    rows, marks = rows[order], marks[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (marks[1:] != marks[:-1])
    start = np.flatnonzero(first)
    twice = start[np.diff(np.append(start, len(rows))) > 1]
    return np.concatenate([rows[start], rows[twice]]), np.concatenate([marks[start], again(marks[twice])])


def with_bases(chosen: np.ndarray, every: np.ndarray) -> np.ndarray:
    """What to look for in a text, sorted: the chosen marks, and those of ``every`` that some of them count."""
    return np.union1d(chosen, every[np.isin(again(every), chosen)])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a logistic model with a slight ridge penalty, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = PENALTY * len(y) * np.eye(len(w))
    loss = lambda v: float(np.logaddexp(0, np.where(y > 0, -(x @ v), x @ v)).sum() + (np.diag(penalty) * v * v).sum() / 2)
    now = loss(w)
    for _ in range(STEPS):
        p = probability(x[:, :-1], w)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (p - y) + np.diag(penalty) * w)
        size = 1.0
        while (after := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w, gain, now = w - size * step, now - after, after
        if gain < 1e-6 * max(1.0, now):
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    marks: np.ndarray  # sorted hashes of the selected marks
    looked_up: np.ndarray  # sorted hashes to look for in a text: those, and the marks that some of them count
    weights: list[np.ndarray]  # per category: marks, earlier probabilities, bias

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        row, held = with_repeats(*held_marks(texts, self.looked_up))
        mark = np.minimum(np.searchsorted(self.marks, held), max(0, len(self.marks) - 1))
        known = self.marks[mark] == held if len(self.marks) else np.zeros(0, bool)
        row, mark = (row[known], mark[known]) if len(self.marks) else (np.zeros(0, np.int64),) * 2
        out = np.zeros((len(texts), len(self.categories)))
        for k, w in enumerate(self.weights):
            z = np.bincount(row, weights=w[: len(self.marks)][mark], minlength=len(texts)) + out[:, :k] @ w[len(self.marks) : len(self.marks) + k] + w[-1]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def presence(rows: np.ndarray, marks: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    x = np.zeros((n, len(chosen)), np.float32)
    if len(chosen):
        at = np.minimum(np.searchsorted(chosen, marks), len(chosen) - 1)
        known = chosen[at] == marks
        x[rows[known], at[known]] = 1
    return x


def strongest(held: np.ndarray, hit: np.ndarray, rows: int, positive: float) -> np.ndarray:
    """Which marks go most with the label, in their order: over CHI_SQUARE, in SUPPORT of its documents, at most 2 MARKS. ``held`` and ``hit``: documents, and those with the label, that hold each."""
    share = positive / rows
    expected = held * share
    chi = (hit - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - held / rows), 1e-9)
    able = np.flatnonzero((chi >= CHI_SQUARE) & (hit > expected) & (hit >= max(LEAST, SUPPORT * positive)))
    return able[np.argsort(-chi[able], kind="stable")[: 2 * MARKS]]


def select_marks(rows: np.ndarray, marks: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At most MARKS of the strongest marks. ``rows`` and ``marks`` are distinct pairs.

    Of marks that the same documents hold, as pieces of one word are, one is taken.
    """
    if not len(y) or y.min() == y.max():
        return np.zeros(0, np.uint64)
    names, at = np.unique(marks, return_inverse=True)
    held = np.bincount(at, minlength=len(names)).astype(float)
    hit = np.bincount(at, weights=y[rows], minlength=len(names))
    able = strongest(held, hit, len(y), y.sum())
    columns = presence(rows, marks, names[np.sort(able)], len(y))
    place = np.searchsorted(np.sort(able), able)
    first: dict[bytes, int] = {}
    for k in np.argsort(place):
        first.setdefault(columns[:, place[k]].tobytes(), k)
    return np.sort(names[able[sorted(first.values())[:MARKS]]])


def marks_of(texts: list[str], wanted: np.ndarray, every: np.ndarray):
    """(rows, index in ``wanted``) of the wanted marks, distinct, BLOCK texts at a time."""
    looked_up = with_bases(wanted, every)
    for s in range(0, len(texts) if len(wanted) else 0, BLOCK):
        row, mark = with_repeats(*held_marks(texts[s : s + BLOCK], looked_up))
        at = np.minimum(np.searchsorted(wanted, mark), len(wanted) - 1)
        known = wanted[at] == mark
        yield row[known] + s, at[known]


def possible_marks(texts: list[str], y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks, all marks of the label's documents): every mark that a fold's models, or the last, could select.

    Counted by fold in arrays, without keeping which document holds what.
    """
    name, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    positive = [t for t, label in zip(texts, y) if label]
    for s in range(0, len(positive), BLOCK):  # no fold can choose a mark that LEAST documents with the label do not hold
        new = np.concatenate([with_repeats(*held_marks([t]))[1] for t in positive[s : s + BLOCK]])
        new, n = np.unique(new, return_counts=True)
        every, at = np.unique(np.concatenate([name, new]), return_inverse=True)
        name, count = every, np.bincount(at, weights=np.concatenate([count, n]), minlength=len(every)).astype(np.int64)
    able = name[count >= LEAST]
    held, hit = np.zeros((FOLDS, len(able))), np.zeros((FOLDS, len(able)))
    for row, at in marks_of(texts, able, name):
        cell = fold[row] * len(able) + at
        held += np.bincount(cell, minlength=held.size).reshape(held.shape)
        hit += np.bincount(cell, weights=y[row], minlength=held.size).reshape(held.shape)
    chosen = [np.zeros(0, np.int64)]
    for out in (*range(FOLDS), None):
        inside = np.arange(FOLDS) != out
        rows, positives = int(inside[fold].sum()), float(y[inside[fold]].sum())
        if 0 < positives < rows:
            chosen.append(strongest(held[inside].sum(axis=0), hit[inside].sum(axis=0), rows, positives))
    return able[np.unique(np.concatenate(chosen))], name


def train(texts: list[str], labels: np.ndarray, categories: list[str]) -> Chain:
    y = labels.astype(np.float64)
    n, last = len(texts), len(categories) - 1
    fold = np.arange(n) % FOLDS  # rows come ordered by a hash
    able, name = possible_marks(texts, y[:, -1], fold)
    pairs = [(np.zeros(0, np.int64),) * 2, *marks_of(texts, able, name)]
    rows, marks = np.concatenate([r for r, _ in pairs]), able[np.concatenate([at for _, at in pairs])]
    # what stands in for a row's earlier probabilities comes from models, marks and all, that have not seen the row
    unseen = np.zeros((n, last))
    for f in range(FOLDS):
        out = fold == f
        seen = ~out[rows]
        number = np.cumsum(~out) - 1
        marks_f = select_marks(number[rows[seen]], marks[seen], y[~out, -1])
        x = presence(rows, marks, marks_f, n).astype(np.float64)
        for k in range(last):
            w = logistic(np.hstack([x[~out], unseen[~out, :k]]), y[~out, k])
            unseen[out, k] = probability(np.hstack([x[out], unseen[out, :k]]), w)
    chosen = select_marks(rows, marks, y[:, -1])
    x = presence(rows, marks, chosen, n).astype(np.float64)
    weights = [logistic(np.hstack([x, unseen[:, :k]]), y[:, k]) for k in range(len(categories))]
    return Chain(categories, chosen, with_bases(chosen, name), weights)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, text: str = "text") -> Chain:
    known = labels.where("toxic IS NOT NULL").select("doc_id", *[F.expr(e).alias(c) for c, e in categories.items()]).na.fill(0, list(categories))
    sample = labelled_sample(docs, known, list(categories), text=text)
    y = np.array([sample[c].to_pylist() for c in categories], np.int64).T.reshape(-1, len(categories))
    return train(sample[text].to_pylist(), y, list(categories))


def with_toxicity(df: DataFrame, chain: Chain, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``: struct with a probability per category. The chain has a fixed size and is broadcast."""
    held = bounded_batches(df).sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"{c} double" for c in chain.categories))
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(held.value.probabilities(texts.tolist()), columns=held.value.categories)

    return df.withColumn(out, scored(F.col(text)))

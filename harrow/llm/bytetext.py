"""Hashes of words and character n-grams of many texts at once, in numpy.

Texts are joined to one byte array, a separator between them; a word's hash is a
difference of prefix sums, so nothing here loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once; a longer text is handled by itself.
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    size = 1 << max(10, int(n - 1).bit_length()) if n > 1 else 1024
    if size not in _powers:
        if size > 4 * CHUNK:
            _powers.clear()
        both = []
        for base in (_P, _INVERSE):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[size] = tuple(both)
    p, q = _powers[size]
    return p[:n], q[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def groups(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, start of each row in them): rows in groups of about CHUNK bytes, each followed by a blank."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= CHUNK or i + 1 == len(texts):
            starts = np.cumsum([1] + [len(x) + 1 for x in held])
            yield at, np.frombuffer(b" " + b" ".join(held) + b" ", np.uint8), starts
            at, held, size = i + 1, [], 0


def word_spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the first and last byte are False."""
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return change[::2], change[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever it stands."""
    p, q = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts])


def ascii_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with everything but letters, digits and non-ASCII made 0, and the words' spans."""
    table = np.zeros(256, np.uint8)
    table[0x30:0x3A] = np.arange(0x30, 0x3A)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    low = table[data]
    return low, *word_spans(low > 0)

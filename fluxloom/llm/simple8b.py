"""Simple-8b: each 64-bit word holds a 4-bit selector and as many equal-width values as fit in 60 bits.

The vectorised encoder finds, for every place, the densest selector that its next
values allow; the walk from word to word doubles its stride. A value of more than
60 bits takes an escape word and then a word of its own.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: selector -> (values in a word, bits of each).
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15


COUNTS = np.array([c for c, _ in SELECTORS] + [1, 1, 0], np.int64)


def encode(values: np.ndarray) -> np.ndarray:
    """uint64 values as uint64 words. The last word may be padded with zeros: the reader knows how many values there are."""
    v = np.concatenate([np.asarray(values, np.uint64), np.zeros(60, np.uint64)])
    n = len(v) - 60
    if not n:
        return np.empty(0, np.uint64)
    # what fits a selector fits all sparser ones, so the number of those that fit tells the densest
    fitting = np.zeros(n, np.uint8)
    for count, bits in SELECTORS:
        fits, have = v < np.uint64(1 << bits), 1
        while have < count:
            more = min(have, count - have)
            fits = fits[: len(fits) - more] & fits[more:]
            have += more
        fitting += fits[:n]
    choice = np.where(fitting, np.uint8(len(SELECTORS)) - fitting, np.uint8(ESCAPE))
    at = walked(COUNTS[choice])
    kind = choice[at]
    size = np.where(kind == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    out[place] = kind.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        if len(own := np.flatnonzero(kind == s)):
            word, first = out[place[own]], at[own]
            for i in range(count):
                word |= v[first + i] << np.uint64(i * bits)
            out[place[own]] = word
    if len(own := np.flatnonzero(kind == ESCAPE)):
        out[place[own] + 1] = v[at[own]]
    return out


def walked(step: np.ndarray) -> np.ndarray:
    """0, and each place that step leads to from the one before: after i + 2**k steps stands what 2**k steps make of the place after i."""
    n = len(step)
    far = np.minimum(np.arange(n) + step, n).astype(np.int32)
    far = np.append(far, np.int32(n))
    at = np.zeros(1, np.int32)
    while at[-1] < n:
        at = np.concatenate([at, far[at]])
        far = far[far]
    return at[: np.searchsorted(at, n)]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values that encode() packed."""
    words = np.ascontiguousarray(words, np.uint64)
    if not n:
        return np.empty(0, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (kind == ESCAPE).any():  # the word after an escape is data, whatever its upper bits
        i = 0
        marks = np.flatnonzero(kind == ESCAPE)
        for m in marks.tolist():
            if m >= i:
                raw[m + 1] = True
                i = m + 2
    kind[raw] = -1
    count = np.where(raw, 1, np.where(kind == ESCAPE, 0, COUNTS[kind]))
    place = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s, (c, bits) in enumerate(SELECTORS):
        if len(own := np.flatnonzero(kind == s)):
            payload, at, mask = words[own], place[own], np.uint64((1 << bits) - 1)
            for i in range(c):
                out[at + i] = (payload >> np.uint64(i * bits)) & mask
    out[place[raw]] = words[raw]
    return out[:n]

"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document of label 1 is preferred to one of label 0; logistic loss on the
differences of their features gives weights, so each document gets one number, its
margin. The threshold is a quantile of the margins of the fitted sample: the share
of label 0 in it. Scores are a logistic map of margins that puts that quantile at
the stated score (0.3).

Features are all of the whole text: what its bytes, words and lines are like (SURFACE,
nothing that names a kind of junk), and its words and character trigrams, hashed into
65,536 buckets. Of the buckets those get a weight in which the labels of the fitted
sample differ most, so what a low text looks like is learned.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SURFACE = ["bias", "log_words", "upper", "digits", "marks", "foreign", "blanks", "entropy", "word_chars", "word_spread", "distinct", "word_repeats", "lines", "line_repeats", "line_ends"]
#: Buckets of hashed words, and as many of hashed trigrams.
BITS = 15
BUCKETS = 1 << BITS
WIDTH = len(SURFACE) + 2 * BUCKETS
_KINDS = np.array([1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 4 if b > 127 else 5 if b in b" \t\n\r\x0b\x0c" else 3 if 33 <= b < 127 and not 97 <= b < 123 else 0 for b in range(256)])
#: A text's bytes are counted and hashed up to so many at a time, to a blank if there is one (longer words are cut).
STRIDE = 1 << 16


def surface(text: bytes) -> list[float]:
    """Numbers of one text, each from 0 to 1; an empty text gives those of no words."""
    words = text.split()
    n, whole = len(words), np.frombuffer(text, np.uint8)
    per_word, per_byte = 1 / max(n, 1), 1 / max(len(text), 1)
    counts = np.zeros(256)
    for k in range(0, len(whole), STRIDE):
        counts += np.bincount(whole[k : k + STRIDE], minlength=256)
    share = counts[counts > 0] * per_byte
    kinds = np.bincount(_KINDS, counts, 6) * per_byte
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    lines = [x for line in text.split(b"\n") if (x := line.strip())]
    return [
        1.0,
        min(1.0, np.log1p(n) / 20),
        *kinds[1:],
        -float(share @ np.log2(share)) / 8,
        min(1.0, lengths.mean() / 20),
        min(1.0, lengths.std() / 20),
        len(set(words)) * per_word,
        sum(map(eq, words, words[1:])) * per_word,
        min(1.0, len(lines) * per_word),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(x[-1] in b".!?" for x in lines) / max(len(lines), 1),
    ]


_BLANKS = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_UP = np.cumprod(np.full(STRIDE + 1, 0x9E3779B97F4A7C15, np.uint64))
_DOWN = np.cumprod(np.full(STRIDE + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))


def grams(text: bytes, buckets: np.ndarray | None = None) -> np.ndarray:
    """Roots of the shares of words, and of trigrams (A-Z as a-z), in the buckets asked for (None: each); trigrams' follow words'."""
    out = np.zeros((2, BUCKETS))
    whole = np.frombuffer(text.translate(common.LOWER), np.uint8)
    with np.errstate(over="ignore"):
        k = 0
        while k < len(whole):
            end = min(k + STRIDE, len(whole))
            if end < len(whole) and len(blank := np.flatnonzero(_BLANKS[whole[k:end]])):
                end = k + int(blank[-1]) + 1
            b = whole[k:end]
            edge = np.diff(np.concatenate([[True], _BLANKS[b], [True]]).astype(np.int8))
            first, past = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * _UP[: len(b)])])
            out[0] += np.bincount(common.mixed((total[past] - total[first]) * _DOWN[first]) % np.uint64(BUCKETS), minlength=BUCKETS)
            x = whole[k : end + 2].astype(np.uint32)
            out[1] += np.bincount(((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=BUCKETS)
            k = end
    share = 1 / np.maximum(out.sum(axis=1), 1)
    if buckets is None:
        return np.sqrt(out * share[:, None]).ravel()
    return np.sqrt(out.ravel()[buckets] * share[buckets >> BITS])


def features(text: bytes, buckets: np.ndarray | None = None) -> np.ndarray:
    return np.concatenate([surface(text), grams(text, buckets)]).astype(np.float32)


def matrix(texts: list[bytes], buckets: np.ndarray | None = None) -> np.ndarray:
    return np.array([features(t, buckets) for t in texts], np.float32).reshape(len(texts), WIDTH if buckets is None else len(SURFACE) + len(buckets))


@dataclass(frozen=True)
class Ranker:
    weights: tuple[float, ...]  # of SURFACE, then of the buckets
    cut: float  # the margin that gets the score `at`
    scale: float
    at: float
    buckets: tuple[int, ...] = ()

    def of(self, texts: list[bytes]) -> np.ndarray:
        return self.scores(matrix(texts, np.array(self.buckets, np.int64)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x.astype(np.float64) @ np.array(self.weights) - self.cut) / self.scale + np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, at: float = 0.3, n_pairs: int = 60_000, steps: int = 40, l2: float = 1e-3, seed: int = 7) -> Ranker:
    """Newton steps, solved by conjugate gradients, on the logistic loss of feature differences; pairs are drawn with a fixed seed and never held as differences. Without both labels, all margins are equal."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    k = x.shape[1] if x.ndim == 2 else WIDTH
    if not len(good) or not len(bad):
        return Ranker((0.0,) * k, 0.0, 1.0, at)
    x = np.asarray(x, np.float64)
    draw = np.random.default_rng(seed)
    i, j = draw.choice(good, n_pairs), draw.choice(bad, n_pairs)
    back = lambda c: x.T @ (np.bincount(i, c, len(x)) - np.bincount(j, c, len(x))) / n_pairs
    loss = lambda w: np.logaddexp(0, -((x @ w)[i] - (x @ w)[j])).mean() + l2 / 2 * w @ w
    w = np.zeros(k)
    now = loss(w)
    for _ in range(steps):
        m = x @ w
        p = 1 / (1 + np.exp(np.clip(m[i] - m[j], -500, 500)))
        down = back(p) - l2 * w  # against the gradient
        if np.abs(down).max() < 1e-7:
            break
        step, rest = np.zeros(k), down.copy()
        way, square = rest.copy(), rest @ rest
        for _ in range(100):
            u = x @ way
            curved = back(p * (1 - p) * (u[i] - u[j])) + l2 * way
            far = square / (way @ curved)
            step, rest = step + far * way, rest - far * curved
            square, old = rest @ rest, square
            if square < 1e-6 * (down @ down):
                break
            way = rest + square / old * way
        size = 1.0
        while (then := loss(w + size * step)) > now - 1e-4 * size * (down @ step) and size > 1e-6:
            size /= 2
        w, now = w + size * step, then
    margin = np.sort(x @ w)
    cut = (margin[len(bad) - 1] + margin[min(len(bad), len(margin) - 1)]) / 2  # the quantile at the share of label 0
    return Ranker(tuple(w.tolist()), float(cut), float(max(np.std(margin) / 4, 1e-9)), at)


def held_out(doc: Column) -> Column:
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(5)) == 0


def telling(counts: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The buckets, at most `most` and ascending, whose share of texts differs most between two labels, in standard deviations. counts: texts of label 0 and 1 that have each bucket; n: texts of each label."""
    share = counts / np.maximum(n, 1)
    both = counts.sum(axis=1) / max(n.sum(), 1)
    far = np.abs(share[:, 1] - share[:, 0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12))
    best = np.argsort(-far, kind="stable")[:most]
    return np.sort(best[counts[best].sum(axis=1) > 0])


def fit(docs: DataFrame, labels: DataFrame, most: int = 10_000, most_buckets: int = 1024, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Fit on at most `most` labelled rows, the first by a hash of their id; held-out ids and null ids or labels are left out.

    Two passes over that sample: one counts, for each bucket, the texts of each label that
    have it (65,536 numbers, whatever the corpus), the other brings SURFACE and the
    `most_buckets` most telling buckets. What comes to the driver is `most` rows of up to
    6 kB (what is not zero), or more only where ids are repeated in docs; the fit holds
    them as 8 kB each.
    """
    common.tuned(docs.sparkSession)
    doc = F.col(id_col).cast("long")
    chosen = labels.select(doc.alias("doc"), F.col(label_col).cast("int").alias("y")).where("doc is not null and y in (0, 1)").where(~held_out(F.col("doc"))).orderBy(F.xxhash64("doc"), "doc", "y").limit(most)
    joined = common.keyed(docs, id_col, text_col).join(F.broadcast(chosen), "doc").select("doc", "dig", "y", "text")  # at most `most` rows of 12 bytes

    def seen(batches):
        counts = np.zeros((2, 2 * BUCKETS + 1), np.int64)  # the last: texts
        for b in batches:
            for t, y in zip(common.texts(b), common.column(b, "y").to_pylist()):
                counts[y, np.flatnonzero(grams(t))] += 1
                counts[y, -1] += 1
        y, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[y, at])], ["y", "bucket", "n"])

    table = np.zeros((2 * BUCKETS + 1, 2))
    found = joined.mapInArrow(common.freeing(seen), "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table[found["bucket"].to_numpy(), found["y"].to_numpy()] = found["n"].to_numpy()
    buckets = telling(table[:-1], table[-1], most_buckets) if table[-1].all() else np.zeros(0, np.int64)

    def run(batches):
        for b in batches:
            x = matrix(common.texts(b), buckets)
            there = [np.flatnonzero(row).astype(np.uint16) for row in x]
            packed = [pa.array([v.tobytes() for v in vs], pa.binary()) for vs in (there, [row[t] for row, t in zip(x, there)])]
            yield pa.RecordBatch.from_arrays([common.column(b, "doc"), common.column(b, "dig"), common.column(b, "y"), *packed], ["doc", "dig", "y", "at", "v"])

    rows = joined.mapInArrow(common.freeing(run), "doc long, dig long, y int, at binary, v binary").toArrow()
    order = np.lexsort([rows[c].to_numpy() for c in ("dig", "y", "doc")])
    x = np.zeros((len(order), len(SURFACE) + len(buckets)))
    for k, row in enumerate(order.tolist()):
        x[k, np.frombuffer(rows["at"][row].as_py(), np.uint16)] = np.frombuffer(rows["v"][row].as_py(), np.float32)
    y = rows["y"].to_numpy()[order]
    del rows, found
    return replace(fit_pairs(x, y), buckets=tuple(buckets.tolist()))


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row of docs; a null text scores as an empty one. Map only: no shuffle.

    Null ids, repeated rows and empty tables need no rule; equal texts tie; a text of any
    length is read whole; other columns are left behind.
    """
    common.tuned(docs.sparkSession)
    schema = pa.schema([("doc", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([common.column(b, "doc"), pa.array(ranker.of(common.texts(b)))], schema=schema)

    return common.keyed(docs, id_col, text_col).select("doc", "text").mapInArrow(common.freeing(run), "doc long, score double").withColumnRenamed("doc", id_col)


def accepted(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text scores ranker.at or more; a null text scores as an empty one, and equal texts go or stay together. Map only."""
    common.tuned(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(ranker.of(common.texts(b, text_col)) >= ranker.at))

    return docs.mapInArrow(common.freeing(run), docs.schema)


def op8_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    ranker = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, ranker).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ranker.at).cast("int").alias("predicted"))

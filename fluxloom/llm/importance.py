"""Importance resampling towards a target corpus: hashed n-gram counts, log ratios, a Gumbel draw.

Each block of texts (an Arrow batch, or a piece of a very long text) has an integer
dictionary: its distinct words get ids, an n-gram is the tuple of its words' ids, found as
(id of the gram without its last word, id of that word). Each distinct tuple's bytes are put
together and hashed once in a block, and the buckets are joined back to the tuple's places.
Ids live and die with their block: no dictionary grows with the corpus, and no tuple is
shuffled. Stored are each document's buckets; counts of buckets are summed in each task
before they are shuffled, and a bucket's gain is one of `buckets` numbers.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

#: Words of a block, and bytes of a text that are cut into words at once.
BLOCK_WORDS, PIECE_BYTES = 1 << 19, 8 << 20


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The text's words (A-Z lowered), piece by piece; pieces end between words, however long one is."""
    plain, at = text.translate(common.PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + size) if at + size < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def gram_buckets(words: list[bytes], ends: np.ndarray, n: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length 1 to n: places where a gram of it starts, ascending, and its bucket there.

    ends[k]: the place after the last word of the text that word k belongs to; no gram crosses it.
    """
    ids = defaultdict()
    ids.default_factory = ids.__len__
    word = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    known = list(ids)
    at, gram, tuples = np.arange(len(words)), word, np.arange(len(known))[:, None]
    out = []
    for size in range(1, n + 1):
        if size > 1:
            fits = at + size <= ends[at]
            at, gram = at[fits], gram[fits]
            key, first, gram = np.unique(gram * len(known) + word[at + size - 1], return_index=True, return_inverse=True)
            tuples = np.column_stack([tuples[key // max(1, len(known))], word[at[first] + size - 1]])
        hashed = np.fromiter((zlib.crc32(b" ".join([known[k] for k in t])) % buckets for t in tuples.tolist()), np.int64, len(tuples))
        out.append((at, hashed[gram]))
    return out


def block_counts(held: list[tuple[int, list[bytes], int]], n: int, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(row, buckets of its grams) of a block. held: row, words, how many of them only begin no gram here (they were in the piece before)."""
    words = [w for _, ws, _ in held for w in ws]
    sizes = np.array([len(ws) for _, ws, _ in held])
    stop = np.cumsum(sizes)
    grams = gram_buckets(words, np.repeat(stop, sizes), n, buckets)
    out = []
    for (row, ws, old), last in zip(held, stop.tolist(), strict=True):
        begin = last - len(ws)
        mine = []
        for size, (at, found) in enumerate(grams, 1):
            # of a piece that goes on, a gram counts where its last word is new
            a, b = np.searchsorted(at, [begin + max(0, old - size + 1), last])
            mine.append(found[a:b])
        out.append((row, np.concatenate(mine)))
    return out


def number(buckets: int) -> np.dtype:
    """How bucket numbers are stored: little-endian, as short as may be."""
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def features(docs: DataFrame, n: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, dig, n_words, n_features and grams (bucket numbers, one for each gram)."""
    if not 0 < buckets <= 1 << 20 or n < 1:
        raise ValueError("n is 1 or more, buckets are 1 to 2^20")
    kind = number(buckets)
    common.tuned(docs.sparkSession)
    schema = pa.schema([("doc", pa.int64()), ("dig", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("grams", pa.binary())])

    def rows(batches):
        for b in batches:
            raw = common.texts(b)
            counts, found = [0] * len(raw), defaultdict(list)
            held, size = [], 0

            def flush():
                for row, grams in block_counts(held, n, buckets):  # noqa: B023
                    found[row].append(grams.astype(kind).tobytes())  # noqa: B023
                held.clear()  # noqa: B023

            for k, text in enumerate(raw):
                tail: list[bytes] = []
                for words in pieces(text):
                    counts[k] += len(words)
                    held.append((k, tail + words, len(tail)))
                    tail = (tail + words)[-(n - 1) :] if n > 1 else []
                    size += len(words)
                    if size >= BLOCK_WORDS:
                        flush()
                        size = 0
            if held:
                flush()
            for k, (doc, dig) in enumerate(zip(common.column(b, "doc").to_pylist(), common.column(b, "dig").to_pylist(), strict=True)):
                grams = b"".join(found.pop(k, []))
                yield [doc, dig, counts[k], len(grams) // kind.itemsize, grams]

    return common.keyed(docs, id_col, text_col).mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema)), "doc long, dig long, n_words long, n_features long, grams binary")


def totals(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, s): how often a bucket stands in all rows, summed in each task first."""
    schema, kind = pa.schema([("bucket", pa.int64()), ("s", pa.int64())]), number(buckets)

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for grams in common.texts(b, "grams"):
                sums += np.bincount(np.frombuffer(grams, kind), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], schema=schema)

    return found.select("grams").mapInArrow(run, "bucket long, s long").groupBy("bucket").agg(F.sum("s").alias("s"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Of each bucket 1000 times the log of its share in the target over that in the corpus, each count raised by 1, rounded down. `buckets` numbers, whatever the input."""
    all_ = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = all_.join(totals(raw, buckets), "bucket", "left").join(totals(target, buckets).withColumnRenamed("s", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = common.written(both, "bucket-counts")
    sums = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1.0) * float(sums.s + buckets) / ((F.col("s") + 1.0) * float(sums.t + buckets))
    return [r.gain for r in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).sort("bucket").collect()]


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_features, weight, score and rank (from 1; null: not drawn).

    weight is the floored mean gain of the row's grams of 1 to n words (none: 0), score adds
    a Gumbel number made of seed and id; of the rows with min_words or more, `percent` per
    cent with the highest scores are drawn, without replacement. Ties go to the smaller id,
    null ids (drawn for as empty ones) after all others; repeated rows have equal scores and
    take ranks one after another. Null texts have no words; other columns are left behind;
    an empty table gives no rows, an empty target equal shares of all buckets. Texts of any
    length are read whole, piece by piece. The draw sorts rows of numbers by range.
    """
    raw, wanted = common.written(features(docs, n, buckets, id_col, text_col), "grams"), features(target.select(F.lit(0).alias("i"), F.col(target_col).alias("t")), n, buckets, "i", "t")
    gain = np.array(gains(raw, wanted, buckets), np.int64)  # `buckets` numbers: 8 MB at most
    schema = pa.schema([("doc", pa.int64()), ("dig", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    kind = number(buckets)

    def weigh(batches):
        for b in batches:
            weight = [int(gain[np.frombuffer(g, kind)].sum()) // max(1, len(g) // kind.itemsize) for g in common.texts(b, "grams")]
            yield pa.RecordBatch.from_arrays([*(common.column(b, c) for c in schema.names[:-1]), pa.array(weight, pa.int64())], schema=schema)

    weighed = raw.mapInArrow(weigh, "doc long, dig long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    scored = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))).withColumn("short", F.col("n_words") < min_words)
    placed = common.ranked(scored, [F.col("short"), F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("dig")], "scores")
    drawn = placed.where("not short").count() * percent // 100
    rank = F.when(~F.col("short") & (F.col("rank") < drawn), F.col("rank") + 1)
    return placed.select(F.col("doc").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op12_dsir_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")

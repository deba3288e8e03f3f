"""Substring dedup: windows of words that also start in a document with a smaller id.

Rows whose whole text also stands under a smaller id lose all words at once, and take no
further part. Of the other rows:

Pass 1 counts windows in a count-min sketch. A window counts by one 10-word gram of
it, chosen by the window's own words (the least hash), so equal windows count under
the same gram, once for each document; a gram's estimate is never below the
documents that hold any of its windows. The grams are written and counted first, and
the sketch has CELLS cells a gram in each of its two rows, so its share of false
repeats is the same for any input. Tasks' sketches are merged slice by slice. While a
bit for each cell takes no more than `broadcast_bytes`, the bits go to the workers;
beyond that the sketch stays a table of its cells, and grams are joined to it.

Pass 2 emits only windows estimated to stand twice or more, and groups them
exactly by 96 bits of their words: the smallest id of each window, combined before
the shuffle, is joined back. A sketch that fills up would let more windows through and
lose none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files
from .sketch import CountMin, build_full

GRAM = 10
#: Cells of each row of the sketch for each gram, at least.
CELLS = 4
#: Of the sketch's bits in every worker: enough for 64 million grams, some 8 GB of text.
BROADCAST_BYTES = 64 << 20
#: Groups of equal texts (three numbers each) that may be broadcast: 32 MB.
BROADCAST_ROWS = 1_000_000
NULL_ID = -(1 << 63)


def grams(words_hashed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams that stand for the n-word windows, and how many windows (in order) each stands for."""
    g = common.windows(words_hashed, min(GRAM, n))
    at, first = common.anchors(g, n - min(GRAM, n) + 1)
    return g[at], np.diff(first, append=max(len(words_hashed) - n + 1, 0))


BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverses modulo 2**64, up to n at least."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """32 bits of each n-word window by a polynomial over the mixed word hashes, apart from common.windows()."""
    with np.errstate(over="ignore"):
        up, down = powers(len(h))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mixed(h + np.uint64(99)) * up[: len(h)])])
        return (common.mixed((total[n:] - total[:-n]) * down[: len(h) - n + 1]) >> np.uint64(32)).astype(np.uint32)


def marked(docs: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """doc, key (doc, or NULL_ID for null), dig, text, and copy: whether the text also stands under a smaller id. Equal texts are told by 128 bits."""
    slim = common.keyed(docs, id_col, text_col).select("doc", F.coalesce("doc", F.lit(NULL_ID)).alias("key"), "dig", F.xxhash64(F.lit(1), "text").alias("dig2"), "text")
    first = common.written(slim.groupBy("dig", "dig2").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").drop("last"), "copies")
    first = F.broadcast(first) if first.count() <= broadcast_rows else first
    return slim.join(first, ["dig", "dig2"], "left").select("doc", "key", "dig", "text", F.coalesce(F.col("first") < F.col("key"), F.lit(False)).alias("copy"))


def gram_rows(rows: DataFrame, n: int) -> DataFrame:
    """(key, dig, gram, at) of each gram that stands for windows, once for each document."""

    def run(batches):
        word = common.WordHashes()
        for b in batches:
            out = []
            for key, dig, t in zip(common.column(b, "key").to_pylist(), common.column(b, "dig").to_pylist(), common.texts(b), strict=True):
                w = t.split()
                if len(w) >= n:
                    g, at = np.unique(grams(word.of(w), n)[0], return_index=True)
                    out.append((np.full(len(g), key), np.full(len(g), dig), g.view(np.int64), at.astype(np.int32)))
            cells = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["key", "dig", "gram", "at"])

    return rows.select("key", "dig", "text").mapInArrow(common.freeing(run), "key long, dig long, gram long, at int")


def joined_grams(table: DataFrame, width: int) -> DataFrame:
    """The grams whose cells, in both rows of a sketch that is a table, count two or more."""
    for row in (0, 1):
        table = table.withColumn("cell", F.pmod(F.xxhash64(F.lit(row), "gram"), F.lit(1 << width)))
        twice = common.written(table.groupBy("cell").count().where("count > 1").select("cell"), "sketch-cells")
        table = table.join(twice, "cell", "left_semi").drop("cell")
    return table


def repeated_windows(rows: DataFrame, n: int, broadcast_bytes: int) -> DataFrame:
    """(key, dig, starts) of windows that also start in a document with a smaller id; a null id is the smallest."""
    spark = rows.sparkSession
    own = rows.where(~F.col("copy"))
    table = common.written(gram_rows(own, n), "grams")
    width = max(18, (CELLS * table.count() - 1).bit_length())
    shape = CountMin(log2_width=width, depth=2, most=2)
    small = shape.size // 8 <= broadcast_bytes
    if small:

        def hashes(batches):
            for b in batches:
                yield common.column(b, "gram").to_numpy(zero_copy_only=False).view(np.uint64)

        bits = spark.sparkContext.broadcast(build_full(table.select("gram"), hashes, shape))
        texts = own.select("key", "dig", "text", F.lit(None).cast("array<long>").alias("grams"))
    else:
        kept = joined_grams(table, width).groupBy("key", "dig").agg(F.collect_list("gram").alias("grams"))  # of one document
        texts = own.select("key", "dig", "text").join(kept, ["key", "dig"])

    def emit(batches):
        word = common.WordHashes()
        for b in batches:
            out = []
            kept = [None] * b.num_rows if small else common.column(b, "grams").to_pylist()
            for key, dig, t, known in zip(common.column(b, "key").to_pylist(), common.column(b, "dig").to_pylist(), common.texts(b), kept, strict=True):
                w = t.split()
                if len(w) < n:
                    continue
                h = word.of(w)
                g, stands_for = grams(h, n)
                twice = shape.full(bits.value, g) if small else np.isin(g.view(np.int64), known)
                start = np.flatnonzero(np.repeat(twice, stands_for))
                if len(start):
                    out.append((np.full(len(start), key), np.full(len(start), dig), start, common.windows(h, n)[start], rolling(h, n)[start]))
                if sum(len(x[0]) for x in out[-64:]) > 200_000:
                    yield packed(out)
                    out = []
            yield packed(out)

    def packed(out):
        cells = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint32)]
        return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), pa.array(cells[1], pa.int64()), pa.array(cells[2].astype(np.int32)), pa.array(cells[3].view(np.int64)), pa.array(cells[4].view(np.int32))], ["key", "dig", "start", "w1", "w2"])

    # both written: windows are hashed once, and the join has two shuffles of its own, so a frequent window's rows can be split
    found = common.written(texts.mapInArrow(common.freeing(emit), "key long, dig long, start int, w1 long, w2 int"), "window-rows")
    first = common.written(found.groupBy("w1", "w2").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").drop("last"), "windows")
    return found.join(first, ["w1", "w2"]).where("first < key").groupBy("key", "dig").agg(F.collect_list("start").alias("starts"))


def dedup(docs: DataFrame, n: int = 50, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, broadcast_rows: int = BROADCAST_ROWS, digests: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, n_removed and kept_text (kept words joined by one space; with digests kept_sha256 in its place).

    A word goes if an n-word window over it also starts in a document with a smaller
    id. Windows are judged on the input. A null text has no words; a null id counts
    as smaller than all others; rows that share an id never remove each other's
    words; texts of fewer than n words stay whole; other columns are left behind; an empty
    table stays so. A text of any length is read whole, its arrays taking some 60 bytes a
    word.
    """
    common.tuned(docs.sparkSession)
    own = marked(docs, id_col, text_col, broadcast_rows)
    starts = repeated_windows(own, n, broadcast_bytes)
    both = own.alias("a").join(starts.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.dig") == F.col("b.dig")), "left").select("a.doc", "a.text", "a.copy", "b.starts")
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def rows(batches):
        for b in batches:
            lists = common.column(b, "starts")
            flat, offsets, valid = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            for k, (doc, copy, t) in enumerate(zip(common.column(b, "doc").to_pylist(), common.column(b, "copy").to_pylist(), common.texts(b), strict=True)):
                w, n_removed = t.split(), 0
                if copy and len(w) >= n:
                    kept, n_removed = b"", len(w)
                elif valid[k]:
                    at = flat[offsets[k] : offsets[k + 1]]
                    mark = np.zeros(len(w) + 1, np.int64)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + n, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    n_removed = int(gone.sum())
                    kept = b" ".join([w[i] for i in np.flatnonzero(~gone).tolist()])
                else:
                    kept = b" ".join(w)
                yield [doc, len(w), n_removed, hashlib.sha256(kept).hexdigest() if digests else kept.decode()]

    return both.mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema, 1024)), "doc long, n_words long, n_removed long, kept string").withColumnsRenamed({"doc": id_col, "kept": "kept_sha256" if digests else "kept_text"})


def op9_count_min_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"), digests=True)

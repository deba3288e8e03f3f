"""What the corpus operators share: the shared folder, written tables, row keys, word hashes, anchors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written before Python workers start; an Arrow batch holds at most so many bytes, so long texts do not pile up.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, with its scheme. Where that is unset, a temporary one of our own if all runs on this machine; else an error, as executors have no folder in common that we know."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="fluxloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    if "://" not in at:  # as Spark reads it: on its default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        at = re.sub(r"^file:/(?!/)", "file:///", at)
    return at.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: the lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def tuned(spark: SparkSession, most_bytes: int = BATCH_BYTES, rows: int = 2000) -> None:
    """Bound the bytes of an Arrow batch (rows vary from nothing to megabytes)."""
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
    except Exception as e:  # a session whose settings are closed keeps its own bound
        if "CANNOT_MODIFY" not in str(e):
            raise
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives a worker's memory back to the machine when its task ends: workers live on beside later stages."""

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return freed


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (long, null kept), dig (hash of the text) and text (binary; null: empty).

    Other columns are left behind, so names in them cannot clash. (doc, dig) names
    a row; rows that agree in both are equal for every operator here.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("dig"), text.cast("binary").alias("text"))


def carried(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, dig and row: all columns of docs as one struct, so that none of their names can clash. `row.*` gives them back."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("dig"), F.struct("*").alias("row"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.binary())
    return [t or b"" for t in col.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z: what is no digit, letter or byte over 127 turns into a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Lower case of A-Z alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, seed: int = 0, most: int = 150_000):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < self.most:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """A hash of each n consecutive entries of h (of length len(h) - n + 1, or none)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        x = mixed(h + np.uint64(salt) * MIX)
        # doubling: acc covers `have` entries, step[k] covers 2**k
        step, size, acc, have = x, 1, None, 0
        while True:
            if n & size:
                if acc is None:
                    acc, have = step, size
                else:
                    k = len(step) - have
                    acc = mixed(acc[:k] * np.uint64(0xD6E8FEB86659FD93) + step[have : have + k] + np.uint64(size))
                    have += size
            if size * 2 > n:
                break
            step = mixed(step[: len(step) - size] * np.uint64(0xA0761D6478BD642F) + step[size:])
            size *= 2
        return acc[:m]


def anchors(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the smallest entry (leftmost of equals) of every w consecutive entries.

    Places in ascending order, and for each the first window (by its start) that has
    it; its windows go on to the first one of the next place. A window's place
    depends on its own entries alone, so equal windows have equal places. Entries
    count by their upper 32 bits; the lower 32 of the key are the place.
    """
    m = len(h)
    if m < w:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    if w > 1:  # van Herk: minima of blocks of w from both ends, then one look at each window
        full = np.concatenate([key, np.full((-m) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
        left = np.minimum.accumulate(full, axis=1).ravel()
        right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        key = np.minimum(right[: m - w + 1], left[w - 1 : m])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first


def ranked(df: DataFrame, order: list[Column], what: str, name: str = "rank") -> DataFrame:
    """df as a written table with the rank (long, from 0) of each row in the order given; rows equal in it come one after another.

    Rows are dealt to ranges by sampled bounds and sorted there, so no task sorts more
    than a range; only the ranges' row counts, one number a partition, meet at the driver.
    """
    spark = df.sparkSession
    sorted_ = df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(sorted_.select("*", F.spark_partition_id().alias(f"{name}_part"), within.alias(f"{name}_within")), what)
    before, total = [], 0
    for r in placed.groupBy(f"{name}_part").count().sort(f"{name}_part").collect():
        before.append((r[0], total))
        total += r[1]
    start = spark.createDataFrame(before, f"{name}_part int, {name}_start long")
    out = placed.join(F.broadcast(start), f"{name}_part")
    return out.withColumn(name, F.col(f"{name}_start") + F.col(f"{name}_within")).drop(f"{name}_part", f"{name}_within", f"{name}_start")

"""Token-id files: Simple-8b blocks with an index, one file per range of document ids.

A file is: magic, the blocks' words, then the footer as little-endian arrays: word
offsets of the blocks (uint64), ids in each block (uint32), document ids (int64), a
byte that marks null document ids, ids in each document (uint32); then the numbers
of blocks and documents (uint64 each) and the magic again. Blocks hold BLOCK ids
but for the last, so any stretch of a file can be decoded from its block on.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, files, simple8b
from .bpe import LibraryBpe, loaded, vocabulary_path

MAGIC, BLOCK = b"FLX8B\x00\x00\x01", 1 << 16
CACHE_BYTES = 128 << 20  # of a worker, kept between its tasks
ROLL_IDS = 1 << 23  # about 20 MB of file


class ShardWriter:
    """Streams documents into one file; holds at most a block of ids and the index."""

    def __init__(self, out):
        self.out, self.held, self.n_held = out, [], 0
        self.offsets, self.counts, self.docs, self.nulls, self.lengths, self.words, self.n_ids = [], [], [], [], [], 0, 0
        out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held or [np.empty(0, np.uint32)])
        at = 0
        while len(ids) - at >= BLOCK or last and at < len(ids):
            block = ids[at : at + BLOCK]
            words = simple8b.encode(block)
            self.out.write(words.astype("<u8").tobytes())
            self.offsets.append(self.words)
            self.counts.append(len(block))
            self.words += len(words)
            at += len(block)
        self.held, self.n_held = [ids[at:]], len(ids) - at

    def close(self) -> int:
        self._flush(True)
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.counts, "<u4").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.lengths, "<u4").tobytes())
        self.out.write(struct.pack("<QQ", len(self.offsets), len(self.docs)) + MAGIC)
        self.out.close()
        return self.n_ids


class ShardReader:
    """Decodes a file's bytes, all of it or one document."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("no token-id file, or it is cut off")
        n_blocks, n_docs = struct.unpack("<QQ", data[-24:-8])
        at = len(data) - 24
        parts = []
        for n, kind in ((n_docs, "<u4"), (n_docs, "u1"), (n_docs, "<i8"), (n_blocks, "<u4"), (n_blocks, "<u8")):
            at -= n * np.dtype(kind).itemsize
            parts.append(np.frombuffer(data, kind, n, at))
        self.lengths, self.nulls, self.docs, self.counts, self.offsets = parts
        self.words = np.frombuffer(data, "<u8", (at - 8) // 8, 8)
        self.ends = np.append(self.offsets[1:], len(self.words)).astype(np.int64)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths

    def block(self, k: int) -> np.ndarray:
        return simple8b.decode(self.words[int(self.offsets[k]) : int(self.ends[k])], int(self.counts[k]))

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n - 1 of the file; only the blocks that hold them are decoded."""
        if not n:
            return np.empty(0, np.uint32)
        k = range(start // BLOCK, (start + n - 1) // BLOCK + 1)
        return np.concatenate([self.block(b) for b in k])[start - k[0] * BLOCK :][:n].astype(np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        held, first, block = np.empty(0, np.uint32), 0, 0
        for doc, null, start, n in zip(self.docs.tolist(), self.nulls.tolist(), self.starts.tolist(), self.lengths.tolist(), strict=True):
            more = []
            have = first + len(held)
            while have < start + n:
                more.append(self.block(block).astype(np.uint32))
                have += len(more[-1])
                block += 1
            if more:
                held, first = np.concatenate([held[start - first :], *more]), start
            yield (None if null else doc), start, held[start - first : start - first + n]


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, roll: int = ROLL_IDS) -> DataFrame:
    """Encode docs into files in ascending order of id (then of a hash of the text); return the manifest (shard, seq, file, n_docs, n_ids), written once.

    A shard goes on in a new file after `roll` ids; readers hold one file at a time. A
    document is never parted, however long.

    Documents are dealt out by sampled id ranges, texts once over the network. Null
    ids come first. A null text is empty: its only id is end_id. Rows repeated in the
    table are written as often as they stand there; other columns are left behind. An
    empty table gives files without documents. A document whose coded ids take 2 GB or more
    makes a file that Spark does not read back as one row: an error on reading.
    """
    spark = docs.sparkSession
    common.tuned(spark)
    path = path or vocabulary_path()
    tail = np.array([end_id], np.int32)
    dealt = common.keyed(docs, id_col, text_col).repartitionByRange(shards or common.parts(spark), "doc", "dig").sortWithinPartitions("doc", "dig")
    schema = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def rows(batches):
        from pyspark import TaskContext

        shard, seq, writer = TaskContext.get().partitionId(), 0, None
        bpe = loaded(path, LibraryBpe, cache_bytes=CACHE_BYTES)
        for b in batches:
            for doc, ids in zip(common.column(b, "doc").to_pylist(), bpe.encode_batch(common.texts(b)), strict=True):
                if writer is None:
                    out = files.FileOut(folder, f"ids-{shard:06d}-{seq:06d}", ".fx8")
                    writer = ShardWriter(out)
                writer.add(doc, np.append(ids, tail))
                if writer.n_ids >= roll:
                    yield [shard, seq, out.name, len(writer.docs), writer.close()]
                    seq, writer = seq + 1, None
        if writer:
            yield [shard, seq, out.name, len(writer.docs), writer.close()]

    return common.written(dealt.mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema)), "shard long, seq long, file string, n_docs long, n_ids long"), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, digests: bool = False) -> DataFrame:
    """doc, start (ids of all documents before it), n_tokens and ids (or with digests ids_crc32), from the files the manifest lists."""
    base = manifest.select("file", (F.sum("n_ids").over(Window.orderBy("shard", "seq")) - F.col("n_ids")).alias("base"))  # a row per file
    last = ("ids_crc32", pa.int64(), "long") if digests else ("ids", pa.binary(), "binary")
    schema = pa.schema([("file", pa.string()), ("doc", pa.int64()), ("own_start", pa.int64()), ("n_tokens", pa.int64()), last[:2]])

    def rows(batches):
        for b in batches:
            for name, content in zip(common.column(b, "name").to_pylist(), common.column(b, "content").to_pylist(), strict=True):
                for doc, start, ids in ShardReader(content).documents():
                    raw = ids.astype("<u4").tobytes()
                    yield [name, doc, start, len(ids), zlib.crc32(raw) if digests else raw]

    back = files.read_files(spark, manifest, folder).mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema, 2048)), f"file string, doc long, own_start long, n_tokens long, {last[0]} {last[2]}")
    return back.join(base, "file").select("doc", (F.col("own_start") + F.col("base")).alias("start"), "n_tokens", last[0])


def op10_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.new_folder(spark, "token-ids")
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, manifest, digests=True).withColumnRenamed("doc", "doc_id")

"""Binary files in the shared folder: written by tasks, listed in a manifest, read back by Spark."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from . import common


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{common.shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


class FileOut:
    """A file under a name no other attempt uses; it counts only if the manifest lists it, so a lost or repeated task leaves no trace in the result."""

    def __init__(self, folder: str, stem: str, suffix: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.path = f"{folder}/{self.name}"
        self.out = fs.open_output_stream(posixpath.join(root, self.name), compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def read_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """path and content of each file in the folder that the manifest (column file) lists."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.join(manifest.select(F.col("file").alias("name")), "name", "left_semi")


def batches_of(rows: Iterator[list], schema: pa.Schema, most: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of up to `most` rows; one is full, too, when its texts and binaries reach most_bytes."""
    held: list[list] = []
    long = [k for k, f in enumerate(schema) if pa.types.is_string(f.type) or pa.types.is_binary(f.type)]
    size = 0
    for row in rows:
        held.append(row)
        for k in long:
            size += len(row[k] or b"")
        if len(held) >= most or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    yield _batch(held, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

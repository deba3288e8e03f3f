"""Count-min sketches made by the tasks and merged slice by slice. Whoever builds one gives its size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MIX, freeing, mixed

SLICE = 1 << 18
#: Sketches of so many cells are counted in place by each task; larger ones by sorting what it touched.
DENSE_CELLS = 1 << 21


@dataclass(frozen=True)
class CountMin:
    """depth rows of 2**log2_width cells; a cell counts up to `most` and stays there (a task counts up to 255 between two sends)."""

    log2_width: int = 24
    depth: int = 2
    most: int = 2

    @property
    def kind(self) -> type:
        return np.uint8 if self.most < 256 else np.uint32

    @property
    def size(self) -> int:
        return self.depth << self.log2_width

    def cells(self, h: np.ndarray) -> list[np.ndarray]:
        """For each row, the cell of each hash, numbered through all rows."""
        return [(mixed(h + np.uint64(d + 1) * MIX) >> np.uint64(64 - self.log2_width)).astype(np.int64) + (d << self.log2_width) for d in range(self.depth)]

    def estimate(self, counts: np.ndarray, h: np.ndarray) -> np.ndarray:
        """At least min(true count, most) for each hash."""
        out = None
        with np.errstate(over="ignore"):
            for c in self.cells(h):
                out = counts[c] if out is None else np.minimum(out, counts[c])
        return out


    def full(self, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether each hash's count may be `most`: of the bits that build_full() makes."""
        out = np.ones(len(h), bool)
        with np.errstate(over="ignore"):
            for c in self.cells(h):
                out &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
        return out


def build_full(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shape: CountMin) -> np.ndarray:
    """A bit for each cell, set if it counts shape.most: shape.size bits come to the driver."""
    return build(docs, hashes, shape, full=True)


def build(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shape: CountMin, full: bool = False) -> np.ndarray:
    """Counts over all hashes that `hashes` yields. Tasks send the cells they touched; each slice is merged as its rows stream by; the merged cells (shape.size of them) come to the driver."""
    spark = docs.sparkSession
    out_schema = pa.schema([("slice", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    dense = shape.size <= DENSE_CELLS

    def partial(batches):
        held, n = [], 0
        whole = np.zeros(shape.size if dense else 0, np.int64)

        def flush():
            if dense:
                cells = np.flatnonzero(whole)
                counts = whole[cells]
                whole[:] = 0
            else:
                cells, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = np.minimum(counts, min(shape.most, 255)).astype(np.uint8)
            cut = np.searchsorted(cells, np.arange(0, shape.size + SLICE, SLICE))
            rows = [(k, cells[a:b], counts[a:b]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(packed(*r) for r in rows), strict=True), out_schema, strict=True)], schema=out_schema)

        def packed(k, cells, counts):
            at = (cells % SLICE).astype("<u4")
            if len(at) * 5 < SLICE:
                return k, at.tobytes(), counts.tobytes()
            whole = np.zeros(SLICE, np.uint8)
            whole[at] = counts
            return k, b"", whole.tobytes()

        with np.errstate(over="ignore"):
            for h in hashes(batches):
                if dense:
                    for c in shape.cells(h):
                        np.add(whole, np.bincount(c, minlength=len(whole)), out=whole)
                else:
                    held += shape.cells(h)
                n += len(h)
                if n > (4_000_000 if dense else 500_000):
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def merge(batches):
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cells, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                whole = slices.setdefault(k, np.zeros(SLICE, shape.kind))
                at = np.frombuffer(cells, "<u4") if cells else slice(None)
                whole[at] = np.minimum(whole[at].astype(np.uint64) + np.frombuffer(counts, np.uint8), shape.most)
        done = [np.packbits(s >= shape.most).tobytes() if full else s.tobytes() for s in slices.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array(done, pa.binary()), pa.array([b""] * len(slices), pa.binary())], schema=out_schema)

    kinds = "slice int, cells binary, counts binary"
    n_slices = max(1, shape.size // SLICE)
    merged = docs.mapInArrow(freeing(partial), kinds).repartition(min(n_slices, 64), "slice").mapInArrow(freeing(merge), kinds)
    counts = np.zeros(n_slices * SLICE // 8 if full else n_slices * SLICE, np.uint8 if full else shape.kind)
    size = len(counts) // n_slices
    for r in merged.toLocalIterator():
        counts[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.cells, counts.dtype)
    return counts

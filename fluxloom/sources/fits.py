"""FITS images as a data source, spark.read.format("fits_image"), and as a sink, df.write.format("fits_planes").

Each file's first (or named) 2-D image, plain or tile-compressed (see tilezip), is cut into
row blocks; a block is one input partition and reads its own byte ranges. Filters on y leave
out blocks, and the option x leaves out columns, before anything is read. Files are opened
through pyarrow's filesystems, so a path is a local one or a URI that they know.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import tilezip

_TYPES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
_BLOCK = 2880


def open_input(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return fs.open_input_file(at)


def parse_card(card: str) -> tuple[str, object] | None:
    key = card[:8].strip()
    if card[8:10] != "= " or not key:
        return None
    body = card[10:].strip()
    if body.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'", body)
        return key, m[1].replace("''", "'").rstrip() if m else ""
    v = body.split("/", 1)[0].strip()
    if v in ("T", "F"):
        return key, v == "T"
    try:
        return key, int(v)
    except ValueError:
        try:
            return key, float(v.replace("D", "E"))
        except ValueError:
            return key, v


def headers(f) -> list[tuple[dict, int]]:
    """(header, offset of its data) of every unit in the file."""
    out, at = [], 0
    size = f.size()
    while at < size:
        head: dict = {}
        done = False
        while not done:
            f.seek(at)
            raw = f.read(_BLOCK)
            if len(raw) < _BLOCK:
                return out
            at += _BLOCK
            for k in range(0, _BLOCK, 80):
                card = raw[k : k + 80].decode("ascii", "replace")
                if card.startswith("END") and not card[3:].strip():
                    done = True
                    break
                if kv := parse_card(card):
                    head.setdefault(*kv)
        out.append((head, at))
        n = abs(head.get("BITPIX", 8)) // 8 * head.get("GCOUNT", 1) * (math.prod(head.get(f"NAXIS{i + 1}", 0) for i in range(head["NAXIS"])) + head.get("PCOUNT", 0)) if head.get("NAXIS") else 0
        at += math.ceil(n / _BLOCK) * _BLOCK
    return out


def is_plane(head: dict) -> bool:
    return head.get("NAXIS") == 2 and head.get("XTENSION", "IMAGE") == "IMAGE" and head.get("BITPIX") in _TYPES


def image_unit(f, name: str | None = None) -> tuple[dict, int]:
    """The named unit, or the first 2-D image, plain or compressed."""
    for head, at in headers(f):
        if (is_plane(head) or tilezip.is_compressed(head)) and (name is None or head.get("EXTNAME") == name):
            return head, at
    raise ValueError(f"no 2-D image{f' named {name}' if name else ''}")


def size_of(head: dict) -> tuple[int, int]:
    """Width and height of a unit's image."""
    return (head["ZNAXIS1"], head["ZNAXIS2"]) if tilezip.is_compressed(head) else (head["NAXIS1"], head["NAXIS2"])


def scaled(head: dict, data: np.ndarray, blank: str = "BLANK") -> np.ndarray:
    out = data.astype(float) * head.get("BSCALE", 1) + head.get("BZERO", 0)
    return np.where(data == head[blank], np.nan, out) if blank in head and data.dtype.kind != "f" else out


#: Bytes apart at which rows are read one by one rather than with what lies between.
APART = 4096


def rows_of(path: str, name: str | None, y0: int, y1: int, x0: int = 0, x1: int | None = None) -> tuple[dict, np.ndarray]:
    """The header and the pixels y0 to y1, x0 to x1 (half open) of a unit; no other bytes of it are read, but for gaps under APART."""
    with open_input(path) as f:
        head, at = image_unit(f, name)
        w, _ = size_of(head)
        x1 = w if x1 is None else min(x1, w)
        if tilezip.is_compressed(head):
            return head, tilezip.rows(f, head, at, y0, y1)[:, x0:x1]
        kind = np.dtype(_TYPES[head["BITPIX"]])
        size = kind.itemsize
        if (w - (x1 - x0)) * size < APART:
            f.seek(at + y0 * w * size)
            data = np.frombuffer(f.read((y1 - y0) * w * size), kind).reshape(-1, w)[:, x0:x1]
        else:
            data = np.empty((y1 - y0, x1 - x0), kind)
            for k in range(y1 - y0):
                f.seek(at + ((y0 + k) * w + x0) * size)
                data[k] = np.frombuffer(f.read((x1 - x0) * size), kind)
    return head, scaled(head, data)


class _Rows(InputPartition):
    def __init__(self, path, y0, y1):
        self.path, self.y0, self.y1 = path, y0, y1


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["path"].split(",") if p]
        self.name, self.rows = options.get("hdu"), int(options.get("rows", 256))
        self.x0, self.x1 = (int(v) for v in options["x"].split(",")) if options.get("x") else (0, None)
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters) -> Iterator:
        """Take bounds of y, and paths, from the filters; Spark applies all of them again."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("y",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif column == ("path",) and isinstance(f, EqualTo):
                self.only = value
            yield f

    def partitions(self):
        out = []
        for p in self.paths:
            if self.only is not None and p != self.only:
                continue
            with open_input(p) as f:
                h = size_of(image_unit(f, self.name)[0])[1]
            end = h if self.high is None else min(h, self.high)
            out += [_Rows(p, y, min(end, y + self.rows)) for y in range(self.low, end, self.rows)]
        return out or [_Rows("", 0, 0)]

    def read(self, part):
        if part.y0 >= part.y1:
            return
        head, block = rows_of(part.path, self.name, part.y0, part.y1, self.x0, self.x1)
        text = {k: str(v) for k, v in head.items()}
        for k, row in enumerate(block):
            yield part.path, part.y0 + k, row.tolist(), text


class FitsImage(DataSource):
    """One row per image row: path, y, values, header. Options: path (comma-separated), hdu, rows (per partition), x (first,end of the columns). Filters on y and path are pushed down."""

    @classmethod
    def name(cls):
        return "fits_image"

    def schema(self):
        return "path string, y int, values array<double>, header map<string,string>"

    def reader(self, schema):
        return _Reader(self.options)


def wcs_of(head: dict) -> dict:
    """A header's tangent projection as the other modules take it: places counted from 0."""
    get = lambda k, z=0.0: float(head.get(k, z))
    return {"crval1": get("CRVAL1"), "crval2": get("CRVAL2"), "crpix1": get("CRPIX1") - 1, "crpix2": get("CRPIX2") - 1, "cd11": get("CD1_1"), "cd12": get("CD1_2"), "cd21": get("CD2_1"), "cd22": get("CD2_2")}


#: Largest difference of two grids' matrices (degrees a pixel): a fixed value.
SAME_GRID = 1e-12


def aligned(spark: SparkSession, path: str, wcs: dict, width: int, height: int, hdu: str | None = None):
    """(rows, wcs): rows (y, values) of another plane on the pixels of an image (its projection, width and height), and that projection as the plane has it.

    The planes share a grid, and lie apart by the rounded difference of their reference
    pixels. Only the byte ranges of these pixels are read. Other grids, and an image that
    reaches beyond the plane, are errors.
    """
    from pyspark.sql import functions as F

    with open_input(path) as f:
        head, _ = image_unit(f, hdu)
    there, (full_w, full_h) = wcs_of(head), size_of(head)
    if any(abs(there[k] - wcs[k]) > SAME_GRID for k in ("cd11", "cd12", "cd21", "cd22")):
        raise ValueError("the grids of plane and image differ")
    x0, y0 = (int(round(there[k] - wcs[k])) for k in ("crpix1", "crpix2"))
    if x0 < 0 or y0 < 0 or x0 + width > full_w or y0 + height > full_h:
        raise ValueError("the image reaches beyond the plane")
    register(spark)
    rows = spark.read.format("fits_image").option("x", f"{x0},{x0 + width}")
    rows = (rows.option("hdu", hdu) if hdu else rows).load(path).where((F.col("y") >= y0) & (F.col("y") < y0 + height))
    return rows.select((F.col("y") - y0).alias("y"), "values"), there | {"crpix1": there["crpix1"] - x0, "crpix2": there["crpix2"] - y0}


def card(k, v) -> str:
    if isinstance(v, bool):
        body = f"{'T' if v else 'F':>20}"
    elif isinstance(v, (int, float)):
        body = f"{v!r:>20}"
    else:
        body = "'" + str(v).replace("'", "''").ljust(8)[:66] + "'"
    return f"{k[:8]:<8}= {body}".ljust(80)[:80]


def padded(b: bytes, c: bytes) -> bytes:
    return b + c * (-len(b) % _BLOCK)


def unit_header(first: bool, width: int, height: int, more: dict) -> bytes:
    """The header of a float32 image, padded."""
    cards = [card("SIMPLE", True) if first else "XTENSION= 'IMAGE   '".ljust(80), card("BITPIX", -32), card("NAXIS", 2), card("NAXIS1", width), card("NAXIS2", height)]
    cards += [] if first else [card("PCOUNT", 0), card("GCOUNT", 1)]
    return padded("".join(cards + [card(k, v) for k, v in more.items()] + ["END".ljust(80)]).encode("ascii", "replace"), b" ")


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class _PlaneWriter(DataSourceWriter):
    """Tasks write their rows at their places in a file of another name; the commit writes the headers and gives it its own."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in self.path:
            raise ValueError("fits_planes writes at places within a file, so it needs a file system that all tasks mount")
        self.names = [n for n in options["planes"].split(",") if n]
        self.width, self.height = int(options["width"]), int(options["height"])
        first = json.loads(options.get("header", "{}"))
        self.heads = [unit_header(k == 0, self.width, self.height, (first if k == 0 else {}) | {"EXTNAME": n}) for k, n in enumerate(self.names)]
        self.body = math.ceil(4 * self.width * self.height / _BLOCK) * _BLOCK
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        with open(self.part, "wb") as f:
            f.truncate(self.start(len(self.names)))

    def start(self, k: int) -> int:
        return sum(len(h) + self.body for h in self.heads[:k])

    def write(self, rows):
        n = 0
        with open(self.part, "r+b") as f:
            for r in rows:
                plane = self.names.index(r["plane"])
                values = np.array([np.nan if v is None else v for v in r["values"]], ">f4")
                if len(values) != self.width or not 0 <= r["y"] < self.height:
                    raise ValueError(f"row {r['y']} of {r['plane']} does not fit the plane")
                f.seek(self.start(plane) + len(self.heads[plane]) + 4 * self.width * r["y"])
                f.write(values.tobytes())
                n += 1
        return _Written(n)

    def commit(self, messages):
        rows = sum(m.rows for m in messages if m)
        if rows != len(self.names) * self.height:
            self.abort(messages)
            raise ValueError(f"{rows} rows of {len(self.names)} planes of {self.height}")
        with open(self.part, "r+b") as f:
            for k, head in enumerate(self.heads):
                f.seek(self.start(k))
                f.write(head)
        os.replace(self.part, self.path)

    def abort(self, messages):
        if os.path.exists(self.part):
            os.remove(self.part)


class FitsPlanes(DataSource):
    """Sink of rows (plane, y, values), one for each row of each plane, as one file of float32 images. Options: path, planes (names in order, comma-separated), width, height, header (JSON, of the first plane)."""

    @classmethod
    def name(cls):
        return "fits_planes"

    def schema(self):
        return "plane string, y int, values array<double>"

    def writer(self, schema, overwrite):
        return _PlaneWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make source and sink known to the session, and let it push filters down to the source, which asks for that."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsImage)
    spark.dataSource.register(FitsPlanes)


def write_planes(pixels, path: str, planes: list[str], width: int, height: int, header: dict | None = None, mode: str = "append") -> None:
    """pixels (x, y and one column for each plane) as a FITS file of these planes; what is missing is NaN. A task holds rows, not planes."""
    from pyspark.sql import functions as F

    spark = pixels.sparkSession
    register(spark)
    every = spark.range(height).select(F.col("id").cast("int").alias("y"))
    row = lambda c: F.map_from_entries(F.collect_list(F.struct("x", F.col(c).cast("double").alias("v"))))
    lines = every.join(pixels.groupBy("y").agg(*[row(c).alias(c) for c in planes]), "y", "left")  # of one row
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.try_element_at(F.col(c), x))
    out = lines.select("y", F.explode(F.array(*(F.struct(F.lit(c).alias("plane"), dense(c).alias("values")) for c in planes))).alias("p")).select("p.plane", "y", "p.values")
    w = out.write.format("fits_planes").mode(mode).option("planes", ",".join(planes)).option("width", width).option("height", height)
    w.option("header", json.dumps(header or {})).save(path)


def write_image(path: str, data: np.ndarray, header: dict | None = None, extra: list[tuple[str, np.ndarray]] = ()) -> None:
    """A small float32 image at hand (and named extensions) as a FITS file."""
    units = [("", data, header or {}), *((n, a, {"EXTNAME": n}) for n, a in extra)]
    with open(path, "wb") as f:
        for k, (_, a, more) in enumerate(units):
            f.write(unit_header(k == 0, a.shape[1], a.shape[0], more) + padded(np.ascontiguousarray(a, ">f4").tobytes(), b"\0"))

"""FITS binary tables as a data source, spark.read.format("fits_table"), and as a sink, write_table.

All rows of such a table have one width, so a range of rows is a range of bytes: a
partition reads its own range, and a task writes its rows at their places. Both sides
work on whole Arrow batches.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.cut import cut
from . import fits

#: Letter of a form: numpy's type, bytes of one, Spark's type. Those without a type are passed over, and an error if asked for.
KINDS = {"L": ("u1", 1, "boolean"), "B": ("u1", 1, "int"), "I": (">i2", 2, "int"), "J": (">i4", 4, "int"), "K": (">i8", 8, "bigint"), "E": (">f4", 4, "float"), "D": (">f8", 8, "double"), "A": ("S", 1, "string")}
OTHERS = {"X": 1, "C": 8, "M": 16, "P": 8, "Q": 16}
#: Spark's types: letter of their form.
LETTERS = {"boolean": "L", "tinyint": "I", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D", "string": "A"}
BATCH = 20_000


@dataclass
class Field:
    name: str
    kind: str
    repeat: int
    at: int  # byte within a row
    null: int | None = None
    scale: float = 1.0
    zero: float = 0.0

    def spark(self) -> str:
        if self.kind not in KINDS:
            raise ValueError(f"column {self.name}: form {self.kind} is not read")
        one = KINDS[self.kind][2]
        if self.scale != 1 or self.zero != 0:
            one = "bigint" if self.kind in "BIJ" and self.scale == 1 and self.zero == int(self.zero) else "double"
        return one if self.kind == "A" or self.repeat == 1 else f"array<{one}>"

    def dtype(self):
        return f"S{self.repeat}" if self.kind == "A" else (KINDS[self.kind][0], (self.repeat,))


def fields_of(head: dict) -> list[Field]:
    out, at = [], 0
    for k in range(1, head["TFIELDS"] + 1):
        n, kind = re.match(r"(\d*)([A-Z])", head[f"TFORM{k}"].strip()).groups()
        n = int(n or 1)
        out.append(Field(str(head.get(f"TTYPE{k}", f"col{k}")), kind, n, at, head.get(f"TNULL{k}"), head.get(f"TSCAL{k}", 1), head.get(f"TZERO{k}", 0)))
        at += -(-n // 8) if kind == "X" else n * (KINDS[kind][1] if kind in KINDS else OTHERS[kind])
    if at != head["NAXIS1"]:
        raise ValueError("forms and row width differ")
    return out


def table_unit(f, name: str | None = None) -> tuple[dict, int]:
    """Header and offset of the first table, or of that with the name."""
    for head, at in fits.headers(f):
        if head.get("XTENSION") == "BINTABLE" and not head.get("ZIMAGE") and (name is None or head.get("EXTNAME") == name):
            return head, at
    raise ValueError("no table" if name is None else f"no table {name}")


def decoded(field: Field, raw: np.ndarray) -> pa.Array:
    """A column of row bytes as Arrow values of field.spark()."""
    if field.kind == "A":
        return pa.array([v.split(b"\0", 1)[0].rstrip(b" ").decode("utf-8", "replace") for v in raw.tolist()], pa.string())
    flat, none = raw.reshape(-1), None
    flat = flat.astype(flat.dtype.newbyteorder("="))
    if field.kind == "L":
        flat, none = flat == ord("T"), ~np.isin(flat, [ord("T"), ord("F")])
    elif field.null is not None and field.kind in "BIJK":
        none = flat == field.null
    kind = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[re.sub(r"array<(.*)>", r"\1", field.spark())]
    if field.scale != 1 or field.zero != 0:
        flat = flat.astype(np.int64) + int(field.zero) if pa.types.is_integer(kind) else flat * float(field.scale) + float(field.zero)
    values = pa.array(flat, mask=none).cast(kind)
    return values if field.repeat == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * field.repeat, pa.int32()), values)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.paths = [p for p in options["path"].split(",") if p]
        self.name, self.rows, self.columns = options.get("hdu"), int(options.get("rows", 200_000)), list(schema.names)

    def partitions(self):
        out = []
        for p in self.paths:
            with fits.open_input(p) as f:
                n = table_unit(f, self.name)[0]["NAXIS2"]
            out += [_Range(p, k, min(n, k + self.rows)) for k in range(0, n, self.rows)]
        return out or [_Range("", 0, 0)]

    def read(self, part):
        if part.first >= part.end:
            return
        with fits.open_input(part.path) as f:
            head, at = table_unit(f, self.name)
            have = {x.name: x for x in fields_of(head)}
            asked = [have[c] for c in self.columns]
            width = head["NAXIS1"]
            kind = np.dtype({"names": [str(k) for k in range(len(asked))], "formats": [x.dtype() for x in asked], "offsets": [x.at for x in asked], "itemsize": width})
            for k in range(part.first, part.end, BATCH):
                n = min(BATCH, part.end - k)
                f.seek(at + k * width)
                raw = np.frombuffer(f.read(n * width), kind)
                if len(raw) != n:
                    raise ValueError(f"{part.path} ends early")
                yield pa.RecordBatch.from_arrays([decoded(x, raw[str(j)]) for j, x in enumerate(asked)], self.columns)


@dataclass
class _Written(WriterCommitMessage):
    rows: int


def encoded(kind: str, repeat: int, least: int, values: pa.Array, plain: bool) -> np.ndarray:
    """A column's row bytes: nulls are an empty string, no letter of a boolean, the least integer or NaN; arrays are filled with the same up to `repeat`."""
    if kind == "A":
        return np.array([(v or "").encode() for v in values.to_pylist()], f"S{max(repeat, 1)}")
    blank = {"L": 0, "E": np.nan, "D": np.nan}.get(kind, least)
    letters = lambda v: pc.if_else(v, ord("T"), ord("F")) if kind == "L" else v
    numbers = lambda v: letters(v).fill_null(blank).to_numpy(zero_copy_only=False).astype(KINDS[kind][0])
    if plain:
        return numbers(values).reshape(-1, 1)
    out = np.full((len(values), repeat), blank, KINDS[kind][0])
    size = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(values)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = numbers(pc.list_flatten(values))
    return out


class _Writer(DataSourceArrowWriter):
    """Tasks write their rows at their places in a file of another name; the commit gives it its own."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in self.path:
            raise ValueError("fits_table writes at places within a file, so it needs a file system that all tasks mount")
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.fields, self.rows = json.loads(options["fields"]), int(options["rows"])  # name, letter, repeat, least, whether one value
        self.kind = np.dtype([(str(k), f"S{max(r, 1)}" if letter == "A" else (KINDS[letter][0], (r,))) for k, (_, letter, r, _, _) in enumerate(self.fields)])
        first = [fits.card("SIMPLE", True), fits.card("BITPIX", 8), fits.card("NAXIS", 0), fits.card("EXTEND", True)]
        cards = ["XTENSION= 'BINTABLE'".ljust(80)] + [fits.card(k, v) for k, v in {"BITPIX": 8, "NAXIS": 2, "NAXIS1": self.kind.itemsize, "NAXIS2": self.rows, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(self.fields)}.items()]
        for k, (name, letter, r, least, _) in enumerate(self.fields, 1):
            cards += [fits.card(f"TTYPE{k}", name), fits.card(f"TFORM{k}", f"{max(r, 1) if letter == 'A' else r}{letter}")]
            cards += [fits.card(f"TNULL{k}", least)] if letter in "IJK" else []
        cards += [fits.card(k, v) for k, v in json.loads(options.get("header", "{}")).items()]
        self.head = b"".join(fits.padded("".join(c + ["END".ljust(80)]).encode("ascii", "replace"), b" ") for c in (first, cards))
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        body = self.rows * self.kind.itemsize
        with open(self.part, "wb") as f:
            f.write(self.head)
            f.truncate(len(self.head) + body + -body % fits._BLOCK)

    def write(self, iterator):
        n = 0
        with open(self.part, "r+b") as f:
            for b in iterator:
                rows = np.zeros(b.num_rows, self.kind)
                for k, (_, letter, repeat, least, plain) in enumerate(self.fields):
                    rows[str(k)] = encoded(letter, repeat, least, b.column(k), plain)
                at = b.column(len(self.fields)).to_numpy()
                order = np.argsort(at, kind="stable")
                for run in np.split(order, np.flatnonzero(np.diff(at[order]) != 1) + 1):
                    if len(run):
                        f.seek(len(self.head) + int(at[run[0]]) * self.kind.itemsize)
                        f.write(rows[run].tobytes())
                n += b.num_rows
        return _Written(n)

    def commit(self, messages):
        rows = sum(m.rows for m in messages if m)
        if rows != self.rows:
            self.abort(messages)
            raise ValueError(f"{rows} rows of {self.rows}")
        os.replace(self.part, self.path)

    def abort(self, messages):
        if os.path.exists(self.part):
            os.remove(self.part)


class FitsTable(DataSource):
    """Rows of a FITS binary table. Options: path (comma-separated), hdu (its name; else the first), rows (per partition), columns (comma-separated; else all that can be read).

    Integers of the null value and undefined booleans are null; scaled integers are what
    they stand for; NaN stays NaN; strings end at a null byte and lose blanks at their end.
    """

    @classmethod
    def name(cls):
        return "fits_table"

    def schema(self):
        with fits.open_input(self.options["path"].split(",")[0]) as f:
            have = fields_of(table_unit(f, self.options.get("hdu"))[0])
        asked = self.options.get("columns")
        if asked is None:
            have = [x for x in have if x.kind in KINDS]
        else:
            by = {x.name: x for x in have}
            if gone := [c for c in asked.split(",") if c not in by]:
                raise ValueError(f"no column {', '.join(gone)}")
            have = [by[c] for c in asked.split(",")]
        return ", ".join(f"`{x.name}` {x.spark()}" for x in have)

    def reader(self, schema):
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def read_table(spark, path: str, hdu: str | None = None, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(FitsTable)
    r = spark.read.format("fits_table")
    r = r.option("hdu", hdu) if hdu else r
    return (r.option("columns", ",".join(columns)) if columns else r).load(path)


def write_table(df: DataFrame, path: str, order: list[str] | None = None, header: dict | None = None, mode: str = "append") -> None:
    """df as one FITS table, its rows in the order of the columns `order` (None: as they come).

    Rows are sorted by ranges and stored; their places are the counts of the partitions
    before theirs, so no task holds more than its part. Null numbers become NaN or the
    least integer of their type, which is an error as a value; null strings and arrays
    become empty ones, shorter arrays are filled up with null numbers. Dates are text,
    decimals doubles; maps and structs are errors. An empty table gives a table of no rows.
    """
    spark = df.sparkSession
    spark.dataSource.register(FitsTable)
    fields = []  # name, letter, whether one value
    flat = []
    for k, f in enumerate(df.schema.fields):
        kind, plain = f.dataType.simpleString(), True
        if kind.startswith("array<"):
            kind, plain = kind[6:-1], False
        if kind.startswith("decimal") or kind.startswith(("date", "timestamp")):
            new = "double" if kind.startswith("decimal") else "string"
            kind = new
        if kind not in LETTERS or not plain and kind == "string":
            raise ValueError(f"column {f.name}: no form for {f.dataType.simpleString()}")
        fields.append([f.name, LETTERS[kind], plain])
        flat.append(F.col(f"`{f.name}`").cast(kind if plain else f"array<{kind}>").alias(f"c{k}"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = cut(ranged.select(*flat, F.spark_partition_id().alias("_part"), within.alias("_row")))
    least = {"I": -(1 << 15), "J": -(1 << 31), "K": -(1 << 63)}
    one = lambda k: F.col(f"c{k}")
    # of strings and arrays their greatest length, of integers how many have the value that stands for null
    asked = [F.max(F.octet_length(one(k))) if letter == "A" else F.max(F.size(one(k))) if not plain else F.count_if(one(k) == least[letter]) if letter in least else F.lit(0) for k, (_, letter, plain) in enumerate(fields)]
    per = kept.groupBy("_part").agg(F.count("*").alias("n"), *[a.alias(f"m{k}") for k, a in enumerate(asked)]).orderBy("_part").collect()  # a row for each partition
    top = [max((r[f"m{k}"] or 0 for r in per), default=0) for k in range(len(fields))]
    for (name, letter, plain), m in zip(fields, top):
        if plain and letter in least and m:
            raise ValueError(f"column {name} holds the integer that stands for null")
    starts = np.cumsum([0] + [r.n for r in per]).tolist()
    first = spark.createDataFrame([(r["_part"], s) for r, s in zip(per, starts)], "_part int, _start long")
    out = kept.join(F.broadcast(first), "_part").select(*[f"c{k}" for k in range(len(fields))], (F.col("_start") + F.col("_row")).alias("_at"))
    spec = [[name, letter, (max(m, 0) if letter == "A" or not plain else 1), least.get(letter, 0), plain] for (name, letter, plain), m in zip(fields, top)]
    w = out.write.format("fits_table").mode(mode).option("fields", json.dumps(spec)).option("rows", starts[-1])
    w.option("header", json.dumps(header or {})).save(path)

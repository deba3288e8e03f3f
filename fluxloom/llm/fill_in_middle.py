"""Fill-in-middle texts: a rope is split at two unit ranks and its parts are set in another order.

A rope's leaves are short strings that cache how many units begin in them and how many
code points they have; inner nodes cache the sums. A split goes down one path by rank and
shares all other subtrees, concatenation makes one node, so no text is copied until the
rope is read. The way back searches the sentinels, splits a rope of the output at their
code-point ranks and sets the parts in their first order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

PREFIX, SUFFIX, MIDDLE = SENTINELS = "<P>", "<S>", "<M>"
#: Code points of a leaf.
LEAF = 4096
#: Starts of units: every code point; words with the space before them; lines with their end.
UNITS = {"point": None, "word": re.compile(r"^|(?<=\S)(?=\s)"), "line": re.compile(r"^|(?<=\n)(?!\Z)")}


class Leaf:
    """text[start:end], with the places (in it) where units begin; None: everywhere."""

    __slots__ = ("text", "starts", "units", "points", "depth")

    def __init__(self, text: str, starts: list[int] | None):
        self.text, self.starts, self.depth = text, starts, 0
        self.points = len(text)
        self.units = self.points if starts is None else len(starts)

    def cut(self, at: int) -> tuple[Leaf, Leaf]:
        if self.starts is None:
            return Leaf(self.text[:at], None), Leaf(self.text[at:], None)
        return Leaf(self.text[:at], [x for x in self.starts if x < at]), Leaf(self.text[at:], [x - at for x in self.starts if x >= at])

    def place(self, unit: int) -> int:
        return unit if self.starts is None else self.starts[unit]


class Node:
    __slots__ = ("left", "right", "units", "points", "depth")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.units, self.points = left.units + right.units, left.points + right.points
        self.depth = 1 + max(left.depth, right.depth)


Rope = Leaf | Node
EMPTY = Leaf("", [])


def joined(*ropes: Rope) -> Rope:
    """The ropes one after another; empty ones add no node."""
    out = EMPTY
    for r in ropes:
        if r.points:
            out = Node(out, r) if out.points else r
    return out


def rope(text: str, unit: str = "point", leaf: int = LEAF) -> Rope:
    """A balanced rope of the text."""
    pieces = [Leaf(text[a : a + leaf], None) for a in range(0, len(text), leaf)]
    if UNITS[unit] and text:
        begins = [[] for _ in pieces]
        for m in UNITS[unit].finditer(text):
            begins[m.start() // leaf].append(m.start() % leaf)
        pieces = [Leaf(p.text, b) for p, b in zip(pieces, begins, strict=True)]
    while len(pieces) > 1:
        pieces = [Node(*pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0] if pieces else EMPTY


def split(r: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """What stands before the unit (or code point) of this rank, from 0, and the rest; all and nothing where the rank is the count."""
    if rank >= getattr(r, by):
        return r, EMPTY
    if isinstance(r, Leaf):
        return r.cut(r.place(rank) if by == "units" else rank)
    here = getattr(r.left, by)
    if rank < here:
        a, b = split(r.left, rank, by)
        return a, joined(b, r.right)
    a, b = split(r.right, rank - here, by)
    return joined(r.left, a), b


def leaves(r: Rope) -> Iterator[str]:
    held = [r]
    while held:
        x = held.pop()
        if isinstance(x, Leaf):
            yield x.text
        else:
            held += (x.right, x.left)


def flat(r: Rope) -> str:
    return "".join(leaves(r))


def draws(doc: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on seed and id alone; a null id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))


def rearranged(text: str, doc: int | None, seed: int, unit: str, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and of middle, output."""
    h1, h2, h3, h4 = draws(doc, seed)
    whole = rope(text, unit)
    n = whole.units
    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    rest, suffix = split(whole, two)
    prefix, middle = split(rest, one)
    p, s, m = (Leaf(x, []) for x in SENTINELS)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    out = joined(s, suffix, p, prefix, m, middle) if form == "spm" else joined(p, prefix, s, suffix, m, middle)
    return n, form, prefix.points, middle.points, flat(out)


def restored(output: str, form: str) -> str:
    """The text again, from output and form alone. No sentinel stands in a text that was rearranged, and none can arise across a border, as none ends as it begins."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second, len(first))
    last = output.index(MIDDLE, at + len(second))
    whole = rope(output)
    rest, middle = split(whole, last, "points")
    a, b = split(rest, at, "points")
    a, b, middle = split(a, len(first), "points")[1], split(b, len(second), "points")[1], split(middle, len(MIDDLE), "points")[1]
    return flat(joined(b, middle, a) if form == "spm" else joined(a, middle, b))


def transform(docs: DataFrame, seed: int = 1, unit: str = "point", rate: int = 90, spm_rate: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    unit: point, word (with the space before it) or line; rate and spm_rate: per cent. A
    null text counts as empty; empty texts and those that hold a sentinel stay plain. A
    row's cuts depend on seed and id alone, so repeated rows come out equal and a task run
    again gives the same; a null id is drawn for as an empty one. Other columns are left
    behind; an empty table gives no rows. Texts are whole at any length: a task holds one
    text, its leaves and its output. Map only: no shuffle.
    """
    common.tuned(docs.sparkSession)
    if unit not in UNITS:
        raise ValueError(f"unit is none of {', '.join(UNITS)}")
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    def rows(batches):
        for b in batches:
            for doc, text in zip(common.column(b, "doc").to_pylist(), common.texts(b), strict=True):
                *told, out = rearranged(text.decode("utf-8", "surrogateescape"), doc, seed, unit, rate, spm_rate)
                yield [doc, *told, out.encode("utf-8", "surrogateescape")]

    made = common.keyed(docs, id_col, text_col).select("doc", "text").mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema)), "doc long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumnRenamed("doc", id_col).withColumn("output", F.col("output").cast("string"))


def restore(made: DataFrame, id_col: str = "doc_id", out_col: str = "output", form_col: str = "form", others: tuple[str, ...] = ()) -> DataFrame:
    """Per row of transform()'s table: its other columns that are named, form, output, and text, rebuilt from output and form. A null output is an empty text; a null form is plain."""
    common.tuned(made.sparkSession)
    kept = made.select(F.struct(F.col(id_col), *others).alias("row"), F.coalesce(F.col(form_col), F.lit("plain")).alias("form"), F.coalesce(F.col(out_col), F.lit("")).cast("binary").alias("output"))

    def run(batches):
        for b in batches:
            back = [restored(o.decode("utf-8", "surrogateescape"), f).encode("utf-8", "surrogateescape") for o, f in zip(common.texts(b, "output"), common.column(b, "form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.binary())], names=["row", "form", "output", "text"])

    out = kept.mapInArrow(common.freeing(run), kept.withColumn("text", F.lit(b"")).schema)
    return out.select("row.*", "form", F.col("output").cast("string").alias("output"), F.col("text").cast("string").alias("text"))


def op11_rope_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(transform(common.table(spark, sf_dir, "documents")), others=("n", "prefix_chars", "middle_chars"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))

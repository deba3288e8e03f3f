"""Quality rules: cross-document line frequency after rules on each document.

Pass 1 hashes each document's distinct normalised lines and counts, for each host
and line, distinct documents: documents of equal texts are one, so a group of exact
copies, however large, does not reject itself (deduplication decides about it). Both
steps of the count combine before they shuffle. Lines over the limit are removed in
pass 2; documents that keep too little are rejected.

The frequent lines go to the workers as two sorted arrays if they are no more than
broadcast_rows; beyond that, lines are joined to them by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

SYMBOLS = re.compile(rb"[#*$%&|<>]")
DIGITS = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that continue a UTF-8 character: without them, a byte is a code point.
CONTINUATION = bytes(range(0x80, 0xC0))
REPEAT = 8


def document_lines(text: bytes) -> Iterator[tuple[int, int]]:
    """(hash, words) of each line with a word, after A-Z became a-z, digits 0, and white space one space."""
    for line in text.split(b"\n"):
        if words := line.split():
            yield xxhash.xxh3_64_intdigest(b" ".join(words).translate(DIGITS)), len(words)


def repeated_words(words: list[bytes], n: int = REPEAT) -> int:
    """Words inside n-word windows that the text holds twice or more. Exact: windows are named by pairs of the names of their halves."""
    m = len(words)
    if m <= n:
        return 0
    first: dict[bytes, int] = {}
    name = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, m)
    size = 1
    while size < n:
        pair = name[: len(name) - size] * m + name[size:]
        _, name = np.unique(pair, return_inverse=True)
        size *= 2
    twice = np.flatnonzero(np.bincount(name)[name] > 1)
    if not len(twice):
        return 0
    mark = np.zeros(m + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + n, -1)
    return int((np.cumsum(mark[:m]) > 0).sum())


def measures(text: bytes) -> list:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    joined = b"".join(words)
    seen, dup = set(), 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line.strip(b" \t\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
    return [len(words), len(joined.translate(None, CONTINUATION)), len(SYMBOLS.findall(text)), dup, repeated_words(words)]


def line_rows(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, lines, digs = [], [], []
        for host, dig, text in zip(common.column(b, "host").to_pylist(), common.column(b, "dig").to_pylist(), common.texts(b), strict=True):
            own = {h for h, _ in document_lines(text)}
            lines.extend(own)
            hosts.append(np.full(len(own), host, np.int64))
            digs.append(np.full(len(own), dig, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hosts or [np.empty(0, np.int64)])), pa.array(np.array(lines, np.uint64).view(np.int64)), pa.array(np.concatenate(digs or [np.empty(0, np.int64)]))], ["host", "line", "dig"])


def frequent_lines(docs: DataFrame, max_docs: int) -> DataFrame:
    """(host, line) in more than max_docs documents of different texts of the host."""
    lines = docs.mapInArrow(common.freeing(line_rows), "host long, line long, dig long").distinct()
    return lines.groupBy("host", "line").count().where(F.col("count") > max_docs).select("host", "line")


class LineSet:
    """Rows (host, line) in two sorted arrays: 16 bytes a row."""

    def __init__(self, hosts: np.ndarray, lines: np.ndarray):
        order = np.lexsort((lines, hosts))
        self.hosts, self.lines = hosts[order], lines[order]

    def has(self, host: int, lines: list[int]) -> np.ndarray:
        """For each line (an unsigned hash), whether it is a frequent one of the host."""
        a, b = np.searchsorted(self.hosts, (host, host), side="left")[0], np.searchsorted(self.hosts, host, side="right")
        if a == b or not lines:
            return np.zeros(len(lines), bool)
        own, seen = self.lines[a:b], np.array(lines, np.uint64).view(np.int64)
        return own[np.minimum(np.searchsorted(own, seen), len(own) - 1)] == seen


def apply_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 50,
    min_left: float = 0.75,
    min_words: int = 20,
    max_repeat_pct: int = 30,
    broadcast_rows: int = 1_000_000,
    with_text: bool = False,
) -> DataFrame:
    """Per row of docs: id, measures, base_failed, n_removed_words, kept (and cleaned_text with with_text).

    A document is rejected by the base rules (fewer than min_words words, or more
    than max_repeat_pct % repeated words) or if the lines over the limit leave less
    than min_left of its words, or a text that the base rules reject. A line is over the limit in more than max_docs documents
    of different texts of one host. A null text is empty (rejected: no words); a null
    host is a host of its own; rows repeated in the table, or under another id, are one
    document to the count, and each gets its own row; a text of any length is read
    whole; other columns are left behind.
    """
    spark = docs.sparkSession
    common.tuned(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("dig"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.xxhash64(F.col(host_col).cast("string")).alias("host"))
    often = common.written(frequent_lines(slim, max_docs), "frequent-lines")
    n_often = often.count()
    tail = [("n_removed_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())] + [("cleaned_text", pa.string())] * with_text
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc", pa.int64()), *[(c, pa.int64()) for c in names], *tail])
    kinds = f"doc long, {', '.join(f'{c} long' for c in names)}, n_removed_words long, base_failed boolean, kept boolean{', cleaned_text string' * with_text}"

    def failed(n_words: int, n_repeat: int) -> bool:
        return n_words < min_words or 100 * n_repeat > max_repeat_pct * n_words

    def verdict(text: bytes, frequent: Callable[[list[int]], np.ndarray]) -> list:
        lines, m = list(document_lines(text)), measures(text)
        gone = frequent([h for h, _ in lines])
        removed = sum(n for (_, n), x in zip(lines, gone.tolist(), strict=True) if x)
        bad = failed(m[0], m[4])
        kept, cleaned = not bad and m[0] - removed >= min_left * m[0], text
        if removed and (kept or with_text):
            left, at = [], 0
            for x in text.split(b"\n"):
                worded = bool(x.split())
                if not (worded and gone[at]):
                    left.append(x)
                at += worded
            cleaned = b"\n".join(left)
            kept = kept and not failed(*measures(cleaned)[::4])
        return [*m, removed, bad, kept, *[cleaned.decode()] * with_text]

    if n_often <= broadcast_rows:
        held = often.toArrow()
        sent = spark.sparkContext.broadcast(LineSet(*(held.column(c).to_numpy() for c in ("host", "line"))))

        def rows(batches):
            for b in batches:
                for doc, host, text in zip(common.column(b, "doc").to_pylist(), common.column(b, "host").to_pylist(), common.texts(b), strict=True):
                    yield [doc, *verdict(text, lambda lines: sent.value.has(host, lines))]  # noqa: B023

        return slim.mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema, 1024)), kinds).withColumnRenamed("doc", id_col)

    line_schema = pa.schema([("doc", pa.int64()), ("dig", pa.int64()), ("host", pa.int64()), ("line", pa.int64())])

    def own_lines(batches):
        for b in batches:
            for doc, dig, host, text in zip(*(common.column(b, c).to_pylist() for c in ("doc", "dig", "host")), common.texts(b), strict=True):
                for h in {h for h, _ in document_lines(text)}:
                    yield [doc, dig, host, h - (1 << 64) if h >> 63 else h]

    # a document's frequent lines are at most its lines
    hits = slim.mapInArrow(lambda it: files.batches_of(own_lines(it), line_schema), "doc long, dig long, host long, line long").join(often, ["host", "line"]).groupBy("doc", "dig", "host").agg(F.collect_set("line").alias("out"))
    both = slim.alias("a").join(hits.alias("b"), common.same(F.col("a.doc"), F.col("b.doc")) & (F.col("a.dig") == F.col("b.dig")) & (F.col("a.host") == F.col("b.host")), "left").select("a.doc", "a.text", "b.out")

    def joined_rows(batches):
        for b in batches:
            for doc, text, out in zip(common.column(b, "doc").to_pylist(), common.texts(b), common.column(b, "out").to_pylist(), strict=True):
                own = {h & 0xFFFFFFFFFFFFFFFF for h in out or ()}
                yield [doc, *verdict(text, lambda lines: np.array([h in own for h in lines], bool))]  # noqa: B023

    return both.mapInArrow(common.freeing(lambda it: files.batches_of(joined_rows(it), schema, 1024)), kinds).withColumnRenamed("doc", id_col)


def op3_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(common.table(spark, sf_dir, "documents"))

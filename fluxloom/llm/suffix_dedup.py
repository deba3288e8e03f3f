"""Suffix-array dedup: bytes under strings of n bytes that also start elsewhere.

A sparse suffix array. Each n-byte window holds at least one anchor, a place chosen
by the window's own bytes (the least hash of its 32-byte grams), so equal windows
hold anchors at equal offsets. Only suffixes that begin at anchors are sorted, and
only those whose first GRAM bytes (the leading token) stand at two anchors or more.

1. Count the anchors' grams; keep the suffixes whose gram repeats.
2. An anchor's windows start one after another. Cut its suffix at the end of the last
   and add, as a prefix, the bytes from the start of the first. A task writes equal
   pairs (prefix, suffix) twice at most: as often as it takes to see that they repeat.
3. Sampled splitters range-partition the rows by leading tokens (suffix first, then
   prefix, then a hash of both). Splitters stand between tokens; a token of more rows
   than a bucket sorts at a time, however many, is parted. They are cut to the bytes that
   part their neighbours. A bucket sorts its suffixes, and its reversed prefixes, by
   multikey quicksort over 8-byte symbols and takes the common lengths of neighbours.
   The window that starts o bytes left of an anchor repeats if another row is in its run
   of suffixes with n - o common bytes and in its run of prefixes with o common bytes.
4. Such a run may go on in another bucket only if it has n - o bytes in common with a
   splitter at its bucket's end, as buckets are ranges. Windows of these runs are
   compared across buckets, by 128 bits of their bytes: those that repeat in their
   bucket are named once, the others ask whether another bucket names them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

GRAM = 32


# -- one text --------------------------------------------------------------------------


def gram_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    m = len(text) - GRAM + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    x = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
    with np.errstate(over="ignore"):
        h = x[:m] * np.uint64(0x9E3779B97F4A7C15)
        for k, c in ((8, 0xD6E8FEB86659FD93), (16, 0xA0761D6478BD642F), (24, 0xE7037ED1A0B428DB)):
            h ^= h >> np.uint64(29)
            h = (h + x[k : k + m]) * np.uint64(c)
        return common.mixed(h)


def text_anchors(text: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all n-byte windows, the first window of each, and their gram hashes."""
    h = gram_hashes(text)
    at, first = common.anchors(h, n - GRAM + 1)
    return at, first, h[at]


# -- sorting ---------------------------------------------------------------------------


def symbols(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of big-endian 8-byte symbols; short strings are padded with zeros."""
    width = (width + 7) // 8 * 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), ">u8").reshape(len(strings), width // 8).astype(np.uint64)


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and for each place in it the bytes that its row has in common with the one before (0 first).

    Multikey quicksort of all open runs at once: a run is parted by a pivot's symbol
    in less, equal and more; the equal part goes on to the next symbol.
    """
    m, k = rows.shape
    order = np.arange(m)
    run, depth = np.zeros(m, np.int64), np.zeros(m, np.int64)  # of each place in the order; a run's places are together
    active = np.arange(m if k else 0)
    while len(active):
        own, at = run[active], depth[active]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(begin, len(own)))
        open_ = np.repeat((size > 1) & (at[begin] < k), size)
        if not open_.all():
            active = active[open_]
            continue
        key = rows[order[active], at]
        three = np.sort(np.stack([key[begin], key[begin + size // 2], key[begin + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        part = (key > pivot).astype(np.int64) + (key >= pivot)
        group = np.repeat(np.arange(len(begin)), size) * 3 + part
        by = np.argsort(group, kind="stable")
        order[active] = order[active][by]
        depth[active] = at[by] + (part[by] == 1)
        run[active] = group[by]
    common_bytes = np.zeros(m, np.int64)
    for i in range(1, m, 1 << 14):
        now = np.arange(i, min(m, i + (1 << 14)))
        diff = rows[order[now]] ^ rows[order[now - 1]]
        first = (diff != 0).argmax(axis=1) if k else np.zeros(len(now), np.int64)
        there = diff[np.arange(len(now)), first] if k else np.zeros(len(now), np.uint64)
        common_bytes[now] = np.where(there != 0, 8 * first + _equal_bytes(there), 8 * k)
    return order, common_bytes


def _equal_bytes(diff: np.ndarray) -> np.ndarray:
    out = np.zeros(len(diff), np.int64)
    for b in range(1, 8):
        out += diff < np.uint64(1 << (64 - 8 * b))
    return out


def repeated_offsets(left: list[bytes], right: list[bytes], count: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """For distinct rows (bytes left of an anchor, reversed; bytes from it on; how often the pair stands): runs (first, last) of o such that the n-byte window o bytes left of the anchor stands twice or more."""
    m = len(right)
    n_left = np.fromiter(map(len, left), np.int64, m)
    n_right = np.fromiter(map(len, right), np.int64, m)
    low = np.maximum(n - n_right, 0)  # the window must end inside the text
    r_order, r_common = multikey_sort(symbols(right, n))
    l_order, l_common = multikey_sort(symbols(left, max(8, int(n_left.max(initial=0)))))
    r_most, l_most = np.empty(m, np.int64), np.empty(m, np.int64)  # common with any other row
    r_most[r_order] = np.maximum(r_common, np.append(r_common[1:], 0))
    l_most[l_order] = np.maximum(l_common, np.append(l_common[1:], 0))
    twice = np.zeros((m, int(n_left.max(initial=0)) + 1), bool)
    whole = count > 1
    for o in range(twice.shape[1]):
        able = (n_left >= o) & (low <= o)
        twice[able & whole, o] = True
        pick = np.flatnonzero(able & (r_most >= n - o) & (l_most >= o))
        if len(pick) < 2:
            continue
        r_run, l_run = np.empty(m, np.int64), np.zeros(m, np.int64)
        r_run[r_order] = np.cumsum(r_common < n - o)
        if o:
            l_run[l_order] = np.cumsum(l_common < o)
        pair = r_run[pick] * (m + 1) + l_run[pick]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        twice[pick[by[1:][same]], o] = True
        twice[pick[by[:-1][same]], o] = True
    edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for (i, a), (_, b) in zip(np.argwhere(edge == 1).tolist(), np.argwhere(edge == -1).tolist(), strict=True):
        out[i].append((a, b - 1))
    return out


# -- tables ----------------------------------------------------------------------------

_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
#: Bytes of the suffix, and of the prefix, by which rows are dealt.
LEAD = 64
#: Rows of a bucket that are sorted at a time, pairs that a task remembers to have written, leads sampled for each partition.
BUCKET_ROWS, REMEMBERED, SAMPLED = 30_000, 400_000, 16


def contexts(slim: DataFrame, n: int) -> DataFrame:
    """(c1, c2, right, left, doc, dig, at) of every anchor whose gram repeats; left is reversed. The bytes are null where the task has written the pair (c1, c2) twice before."""

    def anchor_rows(batches):
        for b in batches:
            out = []
            for doc, dig, t in zip(common.column(b, "doc").to_pylist(), common.column(b, "dig").to_pylist(), common.texts(b), strict=True):
                at, _, h = text_anchors(t, n)
                if len(at):
                    out.append((h.view(np.int64), np.full(len(at), common_id(doc)), np.full(len(at), dig), at.astype(np.int32)))
            cells = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["gram", "doc", "dig", "at"])

    grams = slim.mapInArrow(common.freeing(anchor_rows), "gram long, doc long, dig long, at int")
    # written, so that the join has two shuffles of its own and a frequent gram's rows can be split
    twice = common.written(grams.groupBy("gram").count().where("count > 1").select("gram"), "repeated-grams")
    lists = grams.join(twice, "gram").groupBy("doc", "dig").agg(F.array_distinct(F.collect_list("at")).alias("at"))
    mine = F.coalesce(F.col("a.doc"), F.lit(NULL_ID))
    both = slim.alias("a").join(lists.alias("b"), (mine == F.col("b.doc")) & (F.col("a.dig") == F.col("b.dig"))).select("b.doc", "b.dig", "a.text", "b.at")
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc", pa.int64()), ("dig", pa.int64()), ("at", pa.int32())])

    def rows(batches):
        seen: dict[int, int] = {}
        for b in batches:
            for doc, dig, t, wanted in zip(*(common.column(b, c).to_pylist() for c in ("doc", "dig", "text", "at")), strict=True):
                places, first, _ = text_anchors(t, n)
                ends = np.append(first[1:], len(t) - n + 1) + n - 1  # of each anchor's last window
                own = dict(zip(places.tolist(), zip(first.tolist(), ends.tolist(), strict=True), strict=True))
                if len(seen) > REMEMBERED:
                    seen.clear()
                for a in wanted:
                    p, end = own[a]
                    left, right = t[p:a][::-1], t[a:end]
                    c = xxhash.xxh3_128_intdigest(len(right).to_bytes(4, "little") + right + left)
                    times = seen[c] = seen.get(c, 0) + 1
                    yield [(c >> 64) - (1 << 63), (c & 0xFFFFFFFFFFFFFFFF) - (1 << 63), *((right, left) if times < 3 else (None, None)), doc, dig, a]

    return both.mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema)), "c1 long, c2 long, right binary, left binary, doc long, dig long, at int")


NULL_ID = -(1 << 63)


def common_id(doc: int | None) -> int:
    return NULL_ID if doc is None else doc


def lead_of(right: bytes, left: bytes, c1: int) -> bytes:
    return right[:LEAD] + left[:LEAD] + (c1 & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")


def common_length(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    size = max(len(a), len(b))
    x = int.from_bytes(a.ljust(size, b"\0"), "big") ^ int.from_bytes(b.ljust(size, b"\0"), "big")
    return min(size - (x.bit_length() + 7) // 8, len(a), len(b))


def splitters(leads: list[bytes], target: float, most: float) -> list[bytes]:
    """Ascending splitters that leave about `target` of the sample's leads to a bucket. They stand between tokens (the first GRAM bytes); only a token of more than `most` leads is parted, where neighbours have the fewest bytes in common. A splitter has no more bytes than it takes to part its neighbours."""
    leads = sorted(leads)
    out: set[bytes] = set()
    step, size, i = max(1, int(most)), 0, 0

    def part(at: int) -> None:
        out.add(leads[at][: common_length(leads[at - 1], leads[at]) + 1])

    while i < len(leads):
        j = i + 1
        while j < len(leads) and leads[j][:GRAM] == leads[i][:GRAM]:
            j += 1
        if i and size and (size + j - i > target or j - i > most):
            part(i)
            size = 0
        if j - i > most:
            for mid in range(i + step, j, step):
                gaps = [(common_length(leads[k - 1], leads[k]), abs(k - mid), k) for k in range(max(i + 1, mid - step // 3), min(j - 1, mid + step // 3) + 1) if leads[k - 1] != leads[k]]
                if gaps:
                    part(min(gaps)[2])
            size = target  # the next token begins another bucket
        else:
            size += j - i
        i = j
    return sorted(out)


def bucket_rows(batches, n: int, most: int, bounds: list[bytes]):
    """(c1, c2, runs) of the rows with windows that repeat in the bucket, and (c1, c2, w1, w2, o) of other windows that may stand in other buckets; windows of that kind that repeat in the bucket come as (w1, w2) alone. Bucket k lies between the splitters k - 1 and k of bounds."""
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("runs", _RUNS), ("w1", pa.int64()), ("w2", pa.int64()), ("o", pa.int32())])
    buckets: dict[int, dict[tuple[int, int], list]] = {}
    for b in batches:
        for k, c1, c2, right, left in zip(*(common.column(b, c).to_pylist() for c in ("bucket", "c1", "c2", "right", "left")), strict=True):
            rows = buckets.setdefault(k, {})  # equal pairs are one row
            if (c1, c2) in rows:
                rows[c1, c2][2] += 1
            else:
                rows[c1, c2] = [right, left, 1]

    def solved(part: list[tuple[tuple[int, int], list]], ends: list[bytes]):
        runs = repeated_offsets([r[1] for _, r in part], [r[0] for _, r in part], np.array([r[2] for _, r in part]), n)
        named: set[int] = set()
        for (c, (right, left, _)), own in zip(part, runs, strict=True):
            if own:
                yield [*c, [{"lo": a, "hi": z} for a, z in own], None, None, None]
            lead = lead_of(right, left, c[0])
            shared = max((common_length(lead, e) for e in ends), default=0)
            if shared >= min(LEAD, len(right)):
                shared = n  # how far they agree after it is not known
            whole, k = left[::-1] + right, len(left)
            for o in range(max(0, n - len(right), n - shared), k + 1):
                w = xxhash.xxh3_128_intdigest(whole[k - o : k - o + n])
                here = any(a <= o <= z for a, z in own)
                if not (here and w in named):
                    yield [*((None, None) if here else c), None, (w >> 64) - (1 << 63), (w & 0xFFFFFFFFFFFFFFFF) - (1 << 63), None if here else o]
                if here:
                    named.add(w)

    def all_rows():
        for k in sorted(buckets):
            held = list(buckets.pop(k).items())
            inner: list[bytes] = []
            if len(held) > most:  # a bucket of its own for each share
                lead = lambda x: lead_of(x[1][0], x[1][1], x[0][0])
                every = max(1, most // 64)
                inner = splitters([lead(x) for x in held[::every]], most / every / 2, most / every)
            parts: list[list] = [[] for _ in range(len(inner) + 1)]
            for x in held:
                parts[bisect_right(inner, lead(x)) if inner else 0].append(x)
            del held
            ends = [*bounds[max(0, k - 1) : k], *inner, *bounds[k : k + 1]]
            low = len(bounds[max(0, k - 1) : k])
            for i in range(len(parts)):
                if part := parts[i]:
                    at = i + low  # of the splitter above it
                    yield from solved(part, [*(ends[at - 1 : at] if at else []), *ends[at : at + 1]])
                parts[i] = []

    yield from files.batches_of(all_rows(), schema)


def repeated_spans(slim: DataFrame, n: int, most: int) -> DataFrame:
    """(doc, dig, spans): starts lo..hi of n-byte windows that also start elsewhere; doc is NULL_ID for null."""
    spark = slim.sparkSession
    found = common.written(contexts(slim, n), "suffixes")
    whole = found.where("right is not null")
    lead = F.concat(F.substring("right", 1, LEAD), F.substring("left", 1, LEAD), F.unhex(F.lpad(F.hex("c1"), 16, "0")))
    parts = common.parts(spark)
    total = whole.count()
    share = min(1.0, SAMPLED * parts / max(1, total))
    sample = [bytes(r[0]) for r in whole.sample(share, seed=7).select(lead).collect()]  # some SAMPLED leads a partition
    bounds = splitters(sample, len(sample) / parts, max(most, total / parts) * share)

    @F.pandas_udf("int")
    def bucket(leads: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in leads], dtype="int32")

    dealt = whole.select("c1", "c2", "right", "left", bucket(lead).alias("bucket")).repartitionById(parts, "bucket")
    solved = common.written(dealt.mapInArrow(common.freeing(lambda it: bucket_rows(it, n, most, bounds)), "c1 long, c2 long, runs array<struct<lo:int,hi:int>>, w1 long, w2 long, o int"), "buckets")
    edges = solved.where("runs is null")
    twice = common.written(edges.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.count("c1").alias("asking")).where("n > 1 and asking > 0").select("w1", "w2"), "edge-windows")
    run = F.struct(F.col("o").alias("lo"), F.col("o").alias("hi"))
    across = edges.where("c1 is not null").select("c1", "c2", "w1", "w2", "o").join(twice, ["w1", "w2"]).groupBy("c1", "c2").agg(F.collect_set(run).alias("runs"))  # of one pair: n at most
    runs = solved.where("runs is not null").select("c1", "c2", "runs").unionByName(across)
    span = F.transform("runs", lambda r: F.struct((F.col("at") - r.hi).alias("lo"), (F.col("at") - r.lo).alias("hi")))
    return found.select("c1", "c2", "doc", "dig", "at").join(runs, ["c1", "c2"]).groupBy("doc", "dig").agg(F.flatten(F.collect_list(span)).alias("spans"))


def dedup(docs: DataFrame, n: int = 200, id_col: str = "doc_id", text_col: str = "text", most: int = BUCKET_ROWS, digests: bool = False) -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans and kept (binary; with digests kept_sha256 in its place).

    Removes each byte under an n-byte string that also starts anywhere else, the
    same text included; strings are judged on the input and never cross documents. A
    null text is empty; null ids are ids like others; rows repeated in the table
    repeat each other's strings, so they lose all windows; texts shorter than n stay
    whole; other columns are left behind. A bucket's rows are sorted up to `most` at a
    time; the result is the same for any number. A text of any length is read whole, its
    arrays taking some 50 bytes for each of its own.
    """
    if n < GRAM:
        raise ValueError(f"n is at least {GRAM}")
    common.tuned(docs.sparkSession)
    slim = common.keyed(docs, id_col, text_col)
    spans = repeated_spans(slim, n, most)
    mine = F.coalesce(F.col("a.doc"), F.lit(NULL_ID))
    both = slim.alias("a").join(spans.alias("b"), (mine == F.col("b.doc")) & (F.col("a.dig") == F.col("b.dig")), "left").select("a.doc", "a.text", "b.spans")
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string() if digests else pa.binary())])

    def rows(batches):
        for b in batches:
            lists = common.column(b, "spans")
            lo, hi = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            offsets, valid = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            for k, (doc, t) in enumerate(zip(common.column(b, "doc").to_pylist(), common.texts(b), strict=True)):
                kept, n_removed, n_spans = t, 0, 0
                if valid[k]:
                    mark = np.zeros(len(t) + 1, np.int32)
                    np.add.at(mark, lo[offsets[k] : offsets[k + 1]], 1)
                    np.add.at(mark, hi[offsets[k] : offsets[k + 1]] + n, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    n_removed = int(gone.sum())
                    n_spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                    kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                yield [doc, len(t), n_removed, n_spans, hashlib.sha256(kept).hexdigest() if digests else kept]

    return both.mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema, 1024)), f"doc long, n_bytes long, n_removed long, n_spans long, kept {'string' if digests else 'binary'}").withColumnsRenamed({"doc": id_col} | ({"kept": "kept_sha256"} if digests else {}))


def clean_documents(docs: DataFrame, n: int = 200, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", most: int = BUCKET_ROWS) -> DataFrame:
    """docs, all columns whatever their names, with repeated bytes cut from the text and count_col set to its characters.

    A character cut in part goes whole. Documents of which no word is left are
    dropped; those that had none (null and empty texts too) stay. Rows repeated in
    the table repeat each other, so they lose all windows. An empty table stays so.
    """
    common.tuned(docs.sparkSession, 4 << 20, 500)  # a batch is held several times over
    spans = repeated_spans(common.keyed(docs, id_col, text_col), n, most)
    a = common.carried(docs, id_col, text_col).alias("a")
    mine = F.coalesce(F.col("a.doc"), F.lit(NULL_ID))
    both = a.join(spans.alias("b"), (mine == F.col("b.doc")) & (F.col("a.dig") == F.col("b.dig")), "left").select("a.row", "b.spans")
    names = docs.columns

    def run(batches):
        for b in batches:
            lists = common.column(b, "spans")
            lo, hi = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            offsets, cut = lists.offsets.to_numpy(), np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist()
            cols = common.column(b, "row").flatten()
            at = names.index(text_col)
            keep = np.ones(len(b), bool)
            if cut:
                texts = cols[at].to_pylist()
                for i in cut:
                    raw = np.frombuffer(texts[i].encode(), np.uint8)
                    mark = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(mark, lo[offsets[i] : offsets[i + 1]], 1)
                    np.add.at(mark, hi[offsets[i] : offsets[i + 1]] + n, -1)
                    texts[i] = raw[np.cumsum(mark[:-1]) == 0].tobytes().decode("utf-8", "ignore")
                    keep[i] = bool(texts[i].split())
                cols[at] = pa.array(texts, cols[at].type)
                if count_col in names:
                    k = names.index(count_col)
                    values = cols[k].to_pylist()
                    for i in cut:
                        values[i] = len(texts[i])
                    cols[k] = pa.array(values, cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

    return both.mapInArrow(common.freeing(run), docs.schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"), digests=True)

"""Fill-in-middle, importance resampling and mixing against brute force, on texts with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from fluxloom.llm import bpe, fill_in_middle, importance, mixing, suffix_dedup, token_files, window_dedup
from fluxloom.llm import files as llm_files
from tests.llm.test_operators import SCHEMA, corpus, counted, plain_words, space_words


@pytest.fixture(scope="module")
def rows():
    return corpus() + [(200, "a <P> b"), (201, "ends <"), (202, "<S"), (203, "P>x<S"), (204, "😀é" * 50), (205, " "), (206, "word " * 40000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if i is None else f"s{i % 4}" if i % 7 else None, "x", 1, 2, "y") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 ----------------------------------------------------------------------------------------


def middle(doc, text, pattern):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    at = [m.start() for m in re.finditer(pattern, text)] + [len(text)]
    n = len(at) - 1
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[: at[a]], text[at[a] : at[b]], text[at[b] :]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("unit", "pattern"), [("point", r"(?s:.)"), ("word", r"(?:\s*\S+)|\s+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_fill_in_middle(docs, rows, unit, pattern):
    made = fill_in_middle.transform(docs, unit=unit).cache()
    want = [(i, *middle(i, t, pattern)) for i, t in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert counted(map(tuple, made.collect())) == counted(want)
    back = fill_in_middle.restore(made)
    assert counted((r.doc_id, r.text) for r in back.collect()) == counted((i, t or "") for i, t in rows)
    made.unpersist()


def test_fill_in_middle_of_nothing(empty, docs):
    assert fill_in_middle.restore(fill_in_middle.transform(empty)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.transform(docs, unit="page")


def test_ropes_split_anywhere():
    rng = random.Random(3)
    text = "".join(rng.choice("ab é\n😀") for _ in range(700))
    for unit, leaf in (("point", 7), ("word", 5), ("line", 3)):
        r = fill_in_middle.rope(text, unit, leaf)
        assert fill_in_middle.flat(r) == text and r.points == len(text) and r.depth <= 9
        starts = range(700) if unit == "point" else [m.start() for m in fill_in_middle.UNITS[unit].finditer(text)]
        assert r.units == len(starts)
        for k, at in enumerate(starts):
            a, b = fill_in_middle.split(r, k)
            assert (fill_in_middle.flat(a), a.units, a.points) == (text[:at], k, at) and fill_in_middle.flat(fill_in_middle.joined(a, b)) == text
        for at in range(701):
            a, b = fill_in_middle.split(r, at, "points")
            assert (fill_in_middle.flat(a), b.points, a.units + b.units) == (text[:at], 700 - at, r.units)


# 12 ----------------------------------------------------------------------------------------


def grams(t, n):
    w = plain_words(t)
    return len(w), [" ".join(w[k : k + size]) for size in range(1, n + 1) for k in range(len(w) - size + 1)]


def resampled(rows, target, n=2, buckets=10_000, percent=25, least=20):
    of = lambda g: zlib.crc32(g.encode()) % buckets
    found = [(i, *grams(t, n)) for i, t in rows]
    s = collections.Counter(of(g) for _, _, gs in found for g in gs)
    t = collections.Counter(of(g) for x in target for g in grams(x, n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, words, gs in found:
        weight = sum(gain(of(g)) for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, order[: len(order) * percent // 100]


@pytest.mark.parametrize(("n", "buckets", "piece", "block"), [(2, 10_000, 8 << 20, 1 << 19), (3, 70_000, 50, 40), (1, 7, 1, 1)])
def test_importance_resampling(spark, docs, rows, monkeypatch, n, buckets, piece, block):
    small = [(i, t) for i, t in rows if i != 206] if piece == 1 else rows
    table = docs.where("doc_id is null or doc_id <> 206") if piece == 1 else docs
    f = importance.pieces  # tasks get the module anew, so the sizes go in by defaults
    monkeypatch.setattr(f, "__defaults__", (piece,))
    monkeypatch.setattr(importance, "BLOCK_WORDS", block)
    target = [rows[6][1][:900], "the one", None, ""]
    got = importance.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=buckets).collect()
    want, drawn = resampled(small, target, n, buckets)
    assert counted((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == counted(want)
    ranks = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranks] == list(range(1, len(drawn) + 1)) and [(r.doc_id, r.score) for r in ranks] == [(x[0], x[4]) for x in drawn]


def test_pieces_of_a_text_are_one_text(monkeypatch):
    text = ("Ab,c é1 " * 50 + "x" * 40).encode()
    whole = [w for p in importance.pieces(text) for w in p]
    assert whole == [w.encode() for w in plain_words(text.decode())]
    for size in (1, 3, 30, 1000):
        assert [w for p in importance.pieces(text, size) for w in p] == whole
    rows = [(0, [b"a", b"b"], 0), (0, [b"b", b"c", b"d"], 1), (1, [b"a"], 0)]
    got = collections.defaultdict(list)
    for row, b in importance.block_counts(rows, 2, 10_000):
        got[row] += b.tolist()
    of = lambda *g: sorted(zlib.crc32(x) % 10_000 for x in g)
    assert {k: sorted(v) for k, v in got.items()} == {0: of(b"a", b"b", b"c", b"d", b"a b", b"b c", b"c d"), 1: of(b"a")}


def test_resampling_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).count() == 0
    assert importance.resample(docs, none).where("rank is not null").count() > 0
    with pytest.raises(ValueError):
        importance.resample(docs, none, buckets=0)


# 13 ----------------------------------------------------------------------------------------


def filled(sizes, weights, most):
    """Targets by source: clamp, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, clamped = {}, set()
    while True:
        left, open_ = sum(sizes.values()) - sum(most * sizes[s] for s in clamped), [s for s in order if s not in clamped]
        target = {s: float(most * sizes[s]) for s in clamped} | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        clamped |= over


def mixed_as_asked(got, rows, weights=(5, 2, 1), most=3):
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(space_words(t))
    target, taken = filled(sizes, weights, most), collections.Counter()
    assert counted((r.doc_id, r.source, r.size) for r in got) == counted((i, s, len(space_words(t))) for i, t, s in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert 0 <= r.taken <= most * r.size
        whole = math.floor(math.floor(r.target + 0.5) / r.source_size) if r.source_size else 0
        assert whole * r.size <= r.taken <= (whole + 1) * r.size
        taken[r.source] += r.taken
    return target, taken


@pytest.mark.parametrize("broadcast", [100_000, -1])
@pytest.mark.parametrize("open_rows", [200, 0])
def test_water_filled_mix(docs, monkeypatch, broadcast, open_rows):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    monkeypatch.setattr(mixing, "OPEN_ROWS", open_rows)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    first = mixing.mix(docs).collect()
    target, taken = mixed_as_asked(first, rows)
    assert all(abs(taken[s] - math.floor(target[s] + 0.5)) <= 2 for s in target)  # equal rows share the last part
    assert counted(map(tuple, mixing.mix(docs.repartition(5)).collect())) == counted(map(tuple, first))


def test_many_sources_and_equal_rows(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randint(0, 90), f"s{int(rng.random() ** 4 * 40):02}") for k in range(900)] + [(7, "same words here", "hot")] * 400 + [(None, f"t{k} x", "hot") for k in range(300)] + [(5000, " ", "no words")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 9, 30)).collect()
    target, taken = mixed_as_asked(got, rows, (1, 9, 30))
    assert len({target[s] for s in target}) > 10 and all(abs(taken[s] - math.floor(target[s] + 0.5)) <= (400 if s == "hot" else 0) for s in target)
    assert len({r.taken for r in got if r.doc_id == 7 and r.source == "hot"}) == 1


def test_the_mixture_has_the_words_taken(docs, empty):
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += r.taken
    out = mixing.mixture(docs)
    assert out.schema.names == docs.schema.names and {r.doc for r in out.collect()} == {"x"}
    got, texts = collections.Counter(), {(r.doc_id, r.text) for r in docs.collect()}
    for r in out.collect():
        got[r.doc_id, r.source] += len(space_words(r.text))
        assert any(i == r.doc_id and (t or "").startswith(r.text or "") for i, t in texts)
    assert +got == +want
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, max_epochs=0)


# very long texts ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def long_texts():
    """A text of 60,000 words that says two passages twice, one of a single long word, and a short one that shares a passage."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(60_000)]
    words[50_000:50_080], words[30_000:30_070] = words[100:180], words[20_000:20_070]
    return [(1, " ".join(words)), (2, "q" * 150_000), (3, "before " + " ".join(words[40_000:40_090]) + " after")]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    return spark.createDataFrame(long_texts, "doc_id long, text string")


def test_suffix_dedup_of_long_texts(long_docs, long_texts):
    seen = collections.Counter(t[k : k + 200] for _, t in long_texts for k in range(len(t) - 199) if t[0] != "q")
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.dedup(long_docs).collect()}
    for i, t in long_texts:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 199):
            if t[0] == "q" or seen[t[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200 if k + 200 <= len(t) else len(t)] -= 1
        assert got[i] == "".join(c for c, g in zip(t, np.cumsum(gone), strict=False) if not g)
    assert got[2] == "" and 0 < len(got[1]) < len(long_texts[0][1])


@pytest.mark.parametrize("bounds", [{}, {"broadcast_bytes": 0}])
def test_window_dedup_of_long_texts(long_docs, long_texts, bounds):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in window_dedup.dedup(long_docs, **bounds).collect()}
    words = dict((i, t.split()) for i, t in long_texts)
    assert got[1] == (60_000, 0, long_texts[0][1]) and got[2] == (1, 0, long_texts[1][1])  # a document's own repeats stay
    assert got[3] == (92, 90, "before after") and len(words[3]) == 92


def test_token_files_of_long_texts(spark, long_docs, long_texts):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation()
    lib.no_padding()
    folder = llm_files.new_folder(spark, "long-ids")
    manifest = token_files.write_token_files(long_docs, folder, shards=2, roll=50_000)
    start = 0
    for (i, t), r in zip(long_texts, token_files.read_token_files(spark, folder, manifest).orderBy("doc").collect(), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids + [2]
        assert (r.doc, r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(want), np.array(want, "<u4").tobytes())
        start += len(want)

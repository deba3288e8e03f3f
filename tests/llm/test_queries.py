"""The queries themselves, over the whole smallest tables: their columns, and their rows against SQL or brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from fluxloom.llm import bpe, common, decontamination, license_scan, queries
from tests.llm.test_operators import counted, plain_words, removed
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"

COLUMNS = {
    1: "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    2: "doc_id bigint, n_shingles bigint, component_id bigint",
    3: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    4: "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    5: "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    6: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    7: "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    8: "doc_id bigint, held_out boolean, score double, predicted int",
    9: "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    10: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    11: "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    12: "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    13: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


def name_of(n):
    return next(k for k in queries.QUERIES if k.startswith(f"op{n}_"))


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def of(n):
        if n not in made:
            made[n] = queries.QUERIES[name_of(n)](spark, SF).cache()
        return made[n]

    yield of
    for df in made.values():
        df.unpersist()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("n", range(1, 14))
def test_columns_and_rows(spark, results, n):
    kinds = dict(results(n).dtypes)
    assert {k: kinds.get(k) for k in (c.split()[0] for c in COLUMNS[n].split(", "))} == dict(c.split() for c in COLUMNS[n].split(", "))
    key, table = ("page_id", "pages") if n == 4 else ("doc_id", "documents")
    want = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    assert counted(r[0] for r in results(n).select(key).collect()) == counted(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(results, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = c.execute(queries.ORACLE_SQL[name]).df(), results(int(name[2:].split("_")[0])).toPandas()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols and plain(got, cols) == plain(want, cols)


def test_base_of_the_license_scan(results, texts):
    phrases = {tuple(k.split()): v for k, v in license_scan.PHRASES.items()}
    for r in results(1).collect():
        w = plain_words(texts[r.doc_id])
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p)
        own = {label for _, label in at}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(own)))
        assert own <= set(filter(None, r.labels.split(","))) and r.labels == ",".join(sorted(set(r.labels.split(",")))) and (r.score == 1) >= bool(at)


def test_ids_are_the_library_s(results, texts):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation()
    lib.no_padding()
    ids = {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in results(6).collect():
        x = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(x), sha(np.array(x, "<u4").tobytes()), sha(lib.decode(x, skip_special_tokens=False).encode()))
    start = 0
    for r in sorted(results(10).collect(), key=lambda r: r.doc_id):
        x = ids[r.doc_id] + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)


def test_suffix_dedup_of_the_table(results, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    count = collections.Counter(t[k : k + 200] for t in raw.values() for k in range(len(t) - 199))
    for r in results(7).collect():
        t = raw[r.doc_id]
        g = removed(len(t), [k for k in range(len(t) - 199) if count[t[k : k + 200]] > 1], 200)
        spans = int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), int(g.sum()), spans)
        assert r.kept_sha256 == hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()


def test_scores_and_predictions(results):
    for r in results(8).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_decontamination_without_broadcasts(spark, results, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    got = queries.QUERIES[name_of(5)](spark, SF)
    assert counted(map(tuple, got.collect())) == counted(map(tuple, results(5).collect()))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())

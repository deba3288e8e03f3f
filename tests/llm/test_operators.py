"""The corpus operators against brute force, on texts with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import bpe, decontamination, jaccard_join, license_scan, quality_classifier, quality_rules, suffix_dedup, token_files, warc, window_dedup
from fluxloom.llm import files as llm_files

SCHEMA = "doc_id long, text string, source string, doc string, dig long, at int, n_words string"


def corpus(seed=11, n=60):
    """Texts with nulls, empty and long ones, copies, near copies, shared passages, repeated rows, odd characters."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéöñ") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["The", "OF", "it's", "12", "License", "###", "|", "İß"]
    prose = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", ".\n"]) for _ in range(k))
    passage, long = prose(70), prose(3000)
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one"), (5, "three short words"), (6, long), (7, long + " tail"), (8, "aaaa" * 300), (9, "x\x00y\x1cz\x85 <|endoftext|> Σας")]
    for i in range(10, n):
        text = prose(rng.randint(3, 260))
        if i % 5 == 0:
            text = out[-1][1] or text
        elif i % 5 == 1 and out[-1][1]:
            words = out[-1][1].split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        elif i % 5 == 2:
            text = text + "\n" + passage + "\n" + prose(20)
        out.append((i, text))
    return out + [out[20], (None, out[21][1]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 2}", "x", 1, 2, "y") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return collections.Counter(rows)


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 1 -----------------------------------------------------------------------------------------


def test_license_base(spark, docs, rows, empty):
    more = [(100, "Released under the MIT License. mit license MIT\nLICENSE", "s"), (101, "CC-BY: cc by cc by; Apache  License", "s"), (102, "the mitlicense and smit license", "s")]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    phrases = {tuple(k.split()): v for k, v in license_scan.PHRASES.items()}
    want = []
    for i, t in rows + [m[:2] for m in more]:
        w = plain_words(t)
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p)
        want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = license_scan.scan(table).collect()
    assert counted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == counted(want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_scan.scan(empty).count() == 0


def test_license_fuzzy_spans():
    search = license_scan.NoticeSearch()
    text = b" lorem ipsum licensd under the apache licence version 2 0 dolor all rights resreved sit amet "
    hits = {h.label: h for h in search.find(text)}
    assert set(hits) == {"apache"}
    assert text[hits["apache"].start : hits["apache"].end].strip().startswith(b"licensd under") and 1 <= hits["apache"].edits <= 4
    rng = random.Random(2)
    notice = license_scan.NOTICES[1][0]
    for _ in range(60):  # any three edits of a long notice are found
        t = list(notice)
        for _ in range(3):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["q"], [t[k], "q"]])
        assert "mit" in {h.label for h in search.find(f" aa {''.join(t)} bb ".encode())}


def test_license_takes_a_full_tenth_of_edits():
    def least(text, words):  # by the table of all prefixes; the notice may start anywhere
        row = list(range(len(text) + 1))
        out = row[-1]
        for c in words:
            left = [0]
            for i, x in enumerate(text):
                left.append(min(row[i] + (x != c), row[i + 1] + 1, left[i] + 1))
            row = left
            out = min(out, row[-1])
        return out

    rng = random.Random(5)
    for notice, label in license_scan.NOTICES:
        search, k = license_scan.NoticeSearch([(notice, label)]), len(notice) // 10
        for edits in (*range(k + 1), k + 2):
            t = list(notice)
            for at in sorted(rng.sample(range(len(t)), edits), reverse=True):
                t[at : at + 1] = rng.choice([[], ["q"], [t[at], "q"]])
            words = f" zz {''.join(t)} zz {notice} zz ".encode()
            hits, want = search.find(words), least(notice.encode(), words[: -len(notice) - 5])
            assert [h.edits for h in hits] == [want] * (want <= k) + [0]
            for h in hits:
                assert h.label == label and least(notice.encode(), words[h.start : h.end]) == h.edits


def test_license_notices_are_told_apart():
    search = license_scan.NoticeSearch()
    labels = lambda t: {h.label for h in search.find(f" zz {t} zz ".encode())}
    for notice, label in license_scan.NOTICES:
        within = {other for text, other in license_scan.NOTICES if f" {text} " in f" {notice} "}
        assert label in within and labels(notice) == within, notice
    assert labels("licensed under the isc license") == {"isc"} and labels("released under the mlt license") == {"mit"}
    assert labels("licensed under the xsc license") == {"isc"} and labels("licensed under the old license") == set() == labels("licensed under the license")
    for t, want in (("permission to use copy modify and or distribute this software", "isc"), ("licensed under the unlicense", "unlicense"), ("creative commons zero", "cc0"), ("mozilla public license 2 0", "mpl"), ("available under the gpl v3", "gpl")):
        assert labels(t) == {want}
    assert labels("licensed under the apache licence") == {"apache"} and labels("the mozila public license 2 0") == {"mpl"}
    words = [b"mit", b"mits", b"mt", b"imt", b"bit", b"mit", b"xx", b"mitra", b"t", b""]
    slow = lambda a, b: a != b and any(b == a[:k] + m + a[k + d :] for k in range(len(a) + 1) for d in (0, 1) for m in (b"", *(bytes([c]) for c in range(97, 123))))
    assert all(license_scan.one_edit(a, b) == slow(a, b) for a in words for b in words)
    assert labels("licensd under the mit licence") == {"mit"} and labels("licensed under the bsd licens") == {"bsd"}
    assert labels("licensed under cc by 4 0") == {"cc-by"} and labels("licensd under cc by sa") == {"cc-by", "cc-by-sa"}  # "cc by" stands there too
    assert "gpl" not in labels(license_scan.NOTICES[4][0].replace("gnu general", "gnu lesser general"))
    assert labels("unlicensed under the bsd license") == {"bsd"}
    assert labels("reunlicensed under the bsd license") == set()  # four letters too many
    far = b" " + b"word " * 50_000 + b"licensd under the mit license " * 3
    assert [h.edits for h in search.find(far)] == [1, 1, 1]


def test_license_spans(spark):
    text = "Some words, then: Licensed under\n the MIT-License! " * 3
    (r,) = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.label, s.first_word, s.n_words, s.edits) for s in r.spans] == [("mit", 3 + 8 * k, 5, 0) for k in range(3)]
    assert (r.n_base, r.first_word, r.last_word, r.labels, r.score) == (3, 6, 22, "mit", 1.0)


# 2 -----------------------------------------------------------------------------------------


def brute_components(rows, n=4, pct=85):
    sets = []
    for _, t in rows:
        w = tuple(x.encode().lower() for x in space_words(t))
        sets.append({w[k : k + n] for k in range(len(w) - n + 1)} if len(w) >= n else {w} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= pct * (len(sets[a]) + len(sets[b]) - i):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(sets[k]), (least.get(top(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows)]


def test_jaccard_join(docs, rows, empty):
    got = jaccard_join.join_components(docs).collect()
    assert counted(map(tuple, got)) == counted(brute_components(rows))
    assert jaccard_join.join_components(empty).count() == 0


@pytest.mark.parametrize("n,pct", [(5, 80), (4, 85), (3, 60)])
def test_jaccard_keeps_one_of_each(docs, rows, n, pct):
    kept = jaccard_join.one_of_each(docs, n, pct)
    assert kept.columns == docs.columns
    want = sorted({i for i, size, c in brute_components(rows, n, pct) if i is not None and (i == c or size == 0)})
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want


def test_jaccard_join_of_one_large_group(spark):
    """Near copies of one text, most of them linked through it alone, with a passage that many other texts share: components against brute force at several thresholds."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 8])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([word() for _ in range(rng.choice([4, 8, 30]))] + passage + [word() for _ in range(rng.choice([0, 3, 9]))])) for i in range(120)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, pct in ((4, 85), (5, 80), (4, 60)):
        want = brute_components(rows, n, pct)
        assert 1 < len({c for _, _, c in want}) < len(rows)
        assert counted(map(tuple, jaccard_join.join_components(df, n, pct).collect())) == counted(want)


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_jaccard_keeps_by_row(spark, broadcast_rows):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (2, b), (2, a + " tail"), (3, c), (3, d), (None, c + " tail"), (None, "null one two three four"), (None, "null one two three four"), (4, b), (4, b), (None, ""), (None, ""), (5, None), (3, d)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), broadcast_rows=broadcast_rows)
    want = [(1, a), (2, b), (3, c), (3, d), (None, "null one two three four"), (None, ""), (None, ""), (5, None)]
    assert counted(map(tuple, kept.collect())) == counted(want)


# 3 -----------------------------------------------------------------------------------------


def brute_rules(t):
    w = space_words(t)
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    where = collections.defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k : k + 8])].append(k)
    hit = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def brute_lines(rows, max_docs):
    """(host, line) in more than max_docs different texts. rows: (text, host)."""
    norm = lambda x: b" ".join(x.encode().translate(quality_rules.DIGITS).split())
    texts = collections.defaultdict(set)
    for t, host in rows:
        for x in (t or "").split("\n"):
            if space_words(x):
                texts[host, norm(x)].add(t)
    often = {k for k, v in texts.items() if len(v) > max_docs}

    def removed(t, host):
        return sum(len(space_words(x)) for x in (t or "").split("\n") if (host, norm(x)) in often)

    def kept(t, host, least):
        left = "\n".join(x for x in (t or "").split("\n") if (host, norm(x)) not in often)
        return not brute_rules(t)[-1] and not brute_rules(left)[-1] and len(space_words(left)) >= least * len(space_words(t))

    return often, removed, kept


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_quality_rules(docs, rows, empty, broadcast_rows):
    got = quality_rules.apply_rules(docs, max_docs=4, min_left=0.9, broadcast_rows=broadcast_rows, with_text=True).collect()
    assert counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == counted((i, *brute_rules(t)) for i, t in rows)
    often, removed_words, kept = brute_lines([(t, (i or 0) % 2) for i, t in rows], 4)
    assert often
    want = counted((i, removed_words(t, (i or 0) % 2)) for i, t in rows)
    assert counted((r.doc_id, r.n_removed_words) for r in got) == want
    assert counted((r.doc_id, r.kept) for r in got) == counted((i, kept(t, (i or 0) % 2, 0.9)) for i, t in rows)
    assert any(not r.kept and not r.base_failed for r in got)
    assert all(len(space_words(r.cleaned_text)) == r.n_words - r.n_removed_words for r in got)
    assert quality_rules.apply_rules(empty).count() == 0


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_lines_of_different_texts_are_counted(spark, broadcast_rows):
    """60 texts hold the one line and 50 the other, whatever copies and repeated ids there are; hosts, null among them, are apart."""
    letters = str.maketrans("0123456789", "abcdefghij")  # digits count as equal
    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(8)).translate(letters)
    line = "a line of many words that stands below other words in very many texts of one host and so is removed"
    rows = [(k, f"{line}\n{prose(k)}", "s") for k in range(60)] + [(k % 7, f"under the limit\n{prose(100 + k)}", "s") for k in range(50)]
    rows += [(1000 + k, rows[k][1], "t") for k in range(50)] + [(2000 + k, rows[k][1], None) for k in range(51)]
    rows += [(k, rows[60][1], "s") for k in range(300)] + [(3000, "", "s"), (3001, None, None)]
    got = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), min_left=0.5, broadcast_rows=broadcast_rows).collect()
    n, gone = 29, 21
    assert counted((r.doc_id, r.n_words, r.n_removed_words, r.base_failed, r.kept) for r in got) == counted(
        [(i, len(space_words(t)), gone if line in (t or "") and s != "t" else 0, len(space_words(t)) < 20, len(space_words(t)) == n and s == "t") for i, t, s in rows]
    )


def test_line_query_of_the_tables(spark):
    """The query with its own limits against brute force."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    often, removed_words, kept = brute_lines([(t, s) for _, t, s in rows], 50)
    got = {r.doc_id: r for r in quality_rules.op3_line_frequency_rules(spark, sf).collect()}
    assert often and len(got) == len(rows)
    for i, t, s in rows:
        assert got[i].n_removed_words == removed_words(t, s) and got[i].kept == kept(t, s, 0.75)
    rejected = sum(not r.kept and not r.base_failed for r in got.values())
    assert 0 < rejected < 0.05 * len(rows)  # the method decides, and takes few


# 4 -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, empty):
    big, other = "é" * 600, "b" * 1500
    pages = [(1, "http://a/x y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (None, "u", other), (7, "u", big), (7, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for zipped in (True, False):
        folder = llm_files.new_folder(spark, "warc")
        manifest = warc.write_archives(warc.with_revisits(df), folder, zipped)
        got = warc.read_archives(llm_files.read_files(spark, manifest, folder)).collect()
        assert {r.kind for r in got} == {"record"}
        sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
        refers = {1: 7, 2: 7, None: 6}
        want = counted((p, len((t or "").encode()), sha(t), "revisit" if p in refers else "response", refers.get(p)) for p, _, t in pages)
        assert counted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    none = warc.write_archives(warc.with_revisits(df.limit(0)), llm_files.new_folder(spark, "warc"))
    assert none.count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_warc_salvage(zipped):
    records = [warc.record_bytes(i, "u", p, hashlib.sha1(p).hexdigest(), len(p)) for i, p in enumerate([b"a" * 50, b"WARC/1.1\r\nfake" * 9, bytes(range(256)) * 20, b"d" * 2000, b"e"])]
    parts = [warc.member(r) if zipped else r for r in records]
    whole = b"".join(parts)
    starts = np.cumsum([0] + [len(p) for p in parts])
    assert [r.number("X-Page-Id") for r in warc.Salvage(whole)] == [0, 1, 2, 3, 4]
    rng = random.Random(4)
    for victim in range(5):
        for _ in range(12):
            data = bytearray(whole)
            at = rng.randrange(starts[victim], starts[victim + 1])
            data[at] ^= 1 << rng.randrange(8)
            reader = warc.Salvage(bytes(data))
            seen = [r.number("X-Page-Id") for r in reader]
            assert set(seen) >= set(range(5)) - {victim}, (victim, at - starts[victim])
            if victim not in seen and (zipped or len(seen) < 5):  # plain headers have no checksum: a changed number is read as it stands
                assert sum(g.length for g in reader.gaps) == len(parts[victim]) and reader.gaps[0].offset == starts[victim]
    junk = warc.Salvage(b"junk" + parts[0] + b"\x1f\x8b\x08more" + parts[1] + parts[2][:30])
    assert [r.number("X-Page-Id") for r in junk] == [0, 1]
    assert [(g.offset, g.length) for g in junk.gaps] == [(0, 4), (4 + len(parts[0]), 7), (11 + len(parts[0]) + len(parts[1]), 30)]
    assert list(warc.Salvage(b"")) == []


def test_warc_members_of_many_records_and_many_damaged_members():
    import gzip
    import time

    parts = [warc.record_bytes(k, "u", p, hashlib.sha1(p).hexdigest(), len(p)) for k, p in enumerate([b"a" * 50, bytes(range(256)) * 40, b"c" * 900, b"d" * 70])]
    ids = lambda data: [r.number("X-Page-Id") for r in warc.Salvage(data)]
    for level in (0, 6):
        zipped = gzip.compress(b"".join(parts), level)
        for k in range(1, 9):  # a wrong trailer
            assert ids(zipped[:-k] + bytes([zipped[-k] ^ 1]) + zipped[len(zipped) - k + 1 :]) == [0, 1, 2, 3]
        assert ids(zipped[:-3]) == ids(zipped[:-8]) == [0, 1, 2, 3]  # cut off
    stored = bytearray(gzip.compress(b"".join(parts), 0))
    stored[20 + len(parts[0]) + len(parts[1]) // 2] ^= 4  # in the second of four
    reader = warc.Salvage(bytes(stored))
    assert [r.number("X-Page-Id") for r in reader] == [0, 2, 3] and [(g.offset, g.length) for g in reader.gaps] == [(0, len(stored))]
    one = bytearray(gzip.compress(parts[0]))
    one[-5] ^= 1
    reader = warc.Salvage(bytes(one) + gzip.compress(parts[3]))
    assert [r.number("X-Page-Id") for r in reader] == [0, 3] and [(g.offset, g.length) for g in reader.gaps] == [(0, len(one))]
    # deflate bytes that break: what came before them stays
    rng = random.Random(5)
    noisy = [warc.record_bytes(k, "u", p := bytes(rng.randbytes(20_000)), hashlib.sha1(p).hexdigest(), len(p)) for k in range(4)]
    broken = bytearray(gzip.compress(b"".join(noisy)))
    broken[len(broken) // 2 : len(broken) // 2 + 64] = b"\xff" * 64
    assert ids(bytes(broken) + gzip.compress(parts[3]))[:1] == [0] and ids(bytes(broken) + gzip.compress(parts[3]))[-1] == 3
    # thousands of damaged members in a row, in time that grows with their number alone
    bad = bytearray(gzip.compress(parts[2]))
    bad[len(bad) // 2] ^= 255

    def took(n):
        began = time.process_time()
        reader = warc.Salvage(bytes(bad) * n + gzip.compress(parts[0]))
        assert [r.number("X-Page-Id") for r in reader][-1] == 0 and sum(g.length for g in reader.gaps) == n * len(bad)
        return time.process_time() - began

    took(100)
    assert took(4000) < 12 * max(took(1000), 0.02)
    wrong = bytes(one) * 2000
    assert ids(wrong) == [0] * 2000


def test_warc_records_of_other_writers():
    import base64
    import gzip

    def record(kind, block, **headers):
        lines = [f"WARC-Type: {kind}", f"Content-Length: {len(block)}", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items())]
        return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    web = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    http = {"Content_Type": "application/http; msgtype=response"}
    sha = hashlib.sha1(b"body")
    parts = [
        record("response", web, WARC_Payload_Digest="sha256:" + hashlib.sha256(b"body").hexdigest(), X_Page_Id=0, **http),
        record("response", web, WARC_Payload_Digest="sha1:" + sha.hexdigest().upper(), X_Page_Id=1, **http),
        record("response", web, WARC_Payload_Digest="blake3:xyz", X_Page_Id=2, **http),
        record("response", web, Note="one\r\n\ttwo\r\n  three", X_Page_Id=3, **http),
        record("response", b"20240101\nname 1 IN A 1.2.3.4\r\n\r\nmore", Content_Type="text/dns", X_Page_Id=4),
        record("response", web, WARC_Payload_Digest="sha1:" + base64.b32encode(sha.digest()).decode(), X_Page_Id=5, **http),
        record("response", web, WARC_Block_Digest="sha256:" + hashlib.sha256(web).hexdigest(), X_Page_Id=6, **http),
    ]
    for whole in (b"".join(parts), b"".join(map(gzip.compress, parts)), gzip.compress(b"".join(parts)), gzip.compress(b"".join(parts[:2])) + b"".join(parts[2:5]) + gzip.compress(b"".join(parts[5:]))):
        reader = warc.Salvage(whole)
        found = list(reader)
        assert [r.number("X-Page-Id") for r in found] == list(range(7)) and not reader.gaps
        assert found[3].headers["Note"] == "one two three"
        assert found[4].payload == found[4].block and all(r.payload == b"body" for k, r in enumerate(found) if k != 4)
    # damage inside a member of many records: what its digests vouch for is kept, and what follows the damage by its own checks
    for bad in (record("response", web, WARC_Block_Digest="sha1:" + hashlib.sha1(b"other").hexdigest(), X_Page_Id=9, **http), b"WARC/1.0\r\nno colon\r\n\r\n"):
        reader = warc.Salvage(gzip.compress(parts[0] + bad + parts[5]) + parts[6])
        assert [r.number("X-Page-Id") for r in reader] == [0, 5, 6]
        assert [(g.offset, g.length) for g in reader.gaps] == [(0, len(bad))]
    one = warc.record_bytes(7, "u", bytes(random.Random(1).randbytes(60_000)), hashlib.sha1(b"").hexdigest(), 0, revisit=False)
    zipped = gzip.compress(parts[6] + one + parts[6])
    reader = warc.Salvage(zipped[: len(zipped) // 2] + gzip.compress(parts[1]))
    assert [r.number("X-Page-Id") for r in reader] == [6, 1]
    assert [(g.offset, g.length) for g in reader.gaps] == [(0, len(zipped) // 2)]
    assert warc.hex_digest("sha1:" + "a" * 39) is None and warc.hex_digest(None) is None


def test_warc_long_urls_and_lost_records(spark, tmp_path):
    url = "http://a/" + "\x01" * 400_000  # 1.2 MB of header once encoded
    spark.createDataFrame([(1, url, "x"), (2, "u", "y")], "page_id long, url string, html string").coalesce(1).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = {r.page_id: r.url for r in warc.op4_warc_salvage(spark, f"file://{tmp_path}").collect()}
    assert got == {1: url.replace("\x01", "%01"), 2: "u"}
    record = warc.record_bytes(1, "u", b"x", hashlib.sha1(b"x").hexdigest(), 1)
    for n, fits in ((1, True), (2, False)):
        back = warc.read_archives(spark.createDataFrame([("f", bytearray(record), n)], "name string, content binary, n_records long"))
        if fits:
            assert back.count() == 1
        else:
            with pytest.raises(Exception, match="1 records of 2"):
                back.collect()


# 5 -----------------------------------------------------------------------------------------


def test_decontamination(spark, docs, rows, empty):
    text = {i: t for i, t in rows if t}
    w12 = " ".join(plain_words(text[12])[5:40])
    items = [(1, w12), (22, w12.upper() + " more words here"), (3, "one"), (4, None), (5, ". !"), (None, text[13]), (6, " ".join(plain_words(text[6])[100:109])), (7, "words never seen at all in any of these texts zzz qqq")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(i)
    want = []
    for i, t in rows:
        w, hit, found = plain_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        want.append((i, len(w), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit)))
    got = decontamination.decontaminate(docs, bench).collect()
    assert counted((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == counted(want)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    kept = decontamination.uncontaminated(docs, bench)
    assert kept.columns == docs.columns and counted(r.doc_id for r in kept.collect()) == counted(x[0] for x in want if not x[5])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x y c"), (2, "c b a"), (3, "a z z z z z b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    terms = decontamination.window_terms(bench, 10, "item_id", "text")
    index = decontamination.postings(docs, terms.select("term").distinct(), "doc_id", "text")
    win = terms.select("w1", "w2", "size", "k", F.xxhash64("term").alias("tid")).distinct()
    assert {r.doc for r in decontamination.proximity_matches(index, win, 4).collect()} == {1, 2}
    assert {r.doc for r in decontamination.phrase_matches(index, win).collect()} == set()


# 6 and 10 -----------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(1)
    odd = ["", "  ", "İstanbul ΑΣΣ ς Σ", "a<|endoftext|>b <|startoftext|>x", "don't I'LL we've", "日本語 テスト", "\x00\x1c\x1d a\x85b c", "é ́x ﬁ", "</w> a</w> </w>b", "aaaa" * 3000, "1234 ٣٤", "😀😀👩‍👩‍👧", "x y　z", "<|endoftext"]
    return odd + ["".join(rng.choice("abc  '</w>|İΣß́é1²½ⅷ中\x1f\x0b\x85­​%$ABthe ") for _ in range(rng.randint(1, 30))) for _ in range(800)]


@pytest.fixture(scope="module")
def lib():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("kind", [bpe.SpeculativeBpe, bpe.LibraryBpe])
def test_ids_are_the_library_s(lib, rows, kind):
    texts = odd_texts() + [t or "" for _, t in rows]
    own = kind(bpe.vocabulary_path(), cache_bytes=30_000)
    got = [i.tolist() for i in own.encode_batch([t.encode() for t in texts])]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_speculation_is_verified():
    own = bpe.SpeculativeBpe(bpe.vocabulary_path())
    list(own.encode_batch([t.encode() for t in odd_texts()] + [b"retitioning nterti thorreou onenerth erresinger Attireheerstsh thebut nowis"]))
    assert 0 < own.exact_words < own.proposed_words


def test_bpe_table(docs, rows, lib, empty):
    got = bpe.encode(docs).collect()
    want = [(i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert counted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == counted((i, len(x), np.array(x, "<u4").tobytes(), lib.decode(x, skip_special_tokens=False)) for i, x in want)
    assert bpe.encode(empty).count() == 0


def test_simple8b_round_trip():
    from fluxloom.llm import simple8b

    rng = np.random.default_rng(0)
    cases = [[], [0], [1] * 60, [1] * 61, [2**60 - 1, 0, 2**64 - 1, 2**60, 5], rng.integers(0, 50000, 10000), np.uint64(1) << rng.integers(0, 63, 5000).astype(np.uint64), np.full(130, 2**64 - 1, np.uint64)]
    for c in cases:
        v = np.array(c, np.uint64)
        assert (simple8b.decode(simple8b.encode(v), len(v)) == v).all()
    assert len(simple8b.encode(np.ones(6000, np.uint64))) == 100


def test_token_files(spark, docs, rows, lib, empty, monkeypatch):
    folder = llm_files.new_folder(spark, "ids")
    manifest = token_files.write_token_files(docs, folder, shards=2, roll=3000)
    assert manifest.count() > 5 and manifest.agg(F.max("seq")).head()[0] > 1
    got = token_files.read_token_files(spark, folder, manifest).orderBy("start").collect()
    ids = sorted(((i is not None, i or 0), lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert [r.doc for r in got] == [k[1] if k[0] else None for k, _ in ids]
    assert sum(r.n_tokens for r in got) == sum(len(x) for _, x in ids)
    assert counted((r.doc, bytes(r.ids)) for r in got) == counted((k[1] if k[0] else None, np.array(x, "<u4").tobytes()) for k, x in ids)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    crc = token_files.read_token_files(spark, folder, manifest, digests=True).collect()
    assert counted((r.doc, r.ids_crc32) for r in crc) == counted((r.doc, zlib.crc32(bytes(r.ids))) for r in got)
    m = token_files.write_token_files(empty, folder)
    assert token_files.read_token_files(spark, folder, m).count() == 0


def test_token_file_random_access():
    class Out(list):
        write = list.append

        def close(self):
            pass

    out = Out()
    w = token_files.ShardWriter(out)
    ids = [np.random.default_rng(k).integers(0, 49000, n).astype("<u4") for k, n in enumerate([5, 0, 200_000, 1, 70_000])]
    for k, x in enumerate(ids):
        w.add(k, x)
    w.close()
    r = token_files.ShardReader(b"".join(out))
    flat = np.concatenate(ids)
    for a, n in ((0, 3), (4, 100), (65_530, 20), (130_000, 70_000), (270_000, 6)):
        assert (r.ids(a, n) == flat[a : a + n]).all()
    with pytest.raises(ValueError):
        token_files.ShardReader(b"".join(out)[:-9])


# 7 and 9 -----------------------------------------------------------------------------------


def removed(size, starts, n):
    g = np.zeros(size, bool)
    for k in starts:
        g[k : k + n] = True
    return g


@pytest.mark.parametrize("n", [200, 40])
def test_suffix_dedup(docs, rows, empty, n):
    texts = [(t or "").encode() for _, t in rows]
    count = collections.Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1))
    want = []
    for (i, _), t in zip(rows, texts, strict=True):
        g = removed(len(t), [k for k in range(len(t) - n + 1) if count[t[k : k + n]] > 1], n)
        runs = int((g & ~np.concatenate([[False], g[:-1]])).sum()) if len(g) else 0
        want.append((i, len(t), int(g.sum()), runs, bytes(b for b, x in zip(t, g, strict=True) if not x)))
    got = suffix_dedup.dedup(docs, n).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == counted(want)
    assert suffix_dedup.dedup(empty, n).count() == 0


def test_suffix_dedup_of_parted_tokens(spark):
    """Many rows that share a token, a suffix or a prefix, in more partitions than they fill, sorted a few at a time."""
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, short, ends = word(230), word(150), [word(90) for _ in range(4)]
    texts = [word(rng.randint(0, 150)) + rng.choice([passage, short, short + rng.choice(ends)]) + rng.choice(ends + [word(120)]) for _ in range(300)] + [passage] * 40
    raw = [t.encode() for t in texts]
    count = collections.Counter(t[k : k + 200] for t in raw for k in range(len(t) - 199))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(df, most=9).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, t in enumerate(raw):
        g = removed(len(t), [k for k in range(len(t) - 199) if count[t[k : k + 200]] > 1], 200)
        assert got[i] == bytes(b for b, x in zip(t, g, strict=True) if not x), i


def test_suffix_dedup_of_documents(spark):
    common = "shared passage " * 20
    df = spark.createDataFrame([(1, "aé " + common + "end", 5, "x"), (2, "other " + common, 6, "y"), (3, common + "zz", None, "z"), (4, "clean", 5, None), (5, None, 0, "n")], "doc_id long, text string, n_chars long, lang string")
    out = {r.doc_id: r for r in suffix_dedup.clean_documents(df).collect()}
    assert set(out) == {1, 2, 3, 4, 5} and out[4].text == "clean" and out[5].text is None
    assert out[1].text == "aéend" and out[1].n_chars == 5  # the blank before the passage repeats too


def test_multikey_sort():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    order, lcp = suffix_dedup.multikey_sort(suffix_dedup.symbols(strings, 40))
    padded = [s.ljust(40, b"\0") for s in strings]
    assert [padded[i] for i in order] == sorted(padded)
    for k in range(1, 500):
        a, b = padded[order[k - 1]], padded[order[k]]
        assert lcp[k] == next((i for i in range(40) if a[i] != b[i]), 40)


@pytest.mark.parametrize("n,small", [(50, True), (50, False), (8, True), (8, False)])
def test_window_dedup(docs, rows, empty, n, small):
    least = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        w = space_words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, least(i)), least(i))
    want = []
    for i, t in rows:
        w = space_words(t)
        g = removed(len(w), [k for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < least(i)], n)
        want.append((i, len(w), int(g.sum()), " ".join(x for x, y in zip(w, g, strict=True) if not y)))
    bounds = {} if small else {"broadcast_bytes": 0, "broadcast_rows": 0}
    got = window_dedup.dedup(docs, n, **bounds).collect()
    assert counted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == counted(want)
    assert window_dedup.dedup(empty, n, **bounds).count() == 0


def test_sketch_grows_with_the_input(spark, monkeypatch):
    """Texts without a repeat: the share of windows that the sketch lets through stays small at any size."""
    made = []
    own = window_dedup.build_full
    monkeypatch.setattr(window_dedup, "build_full", lambda table, hashes, shape: made.append((own(table, hashes, shape), shape)) or made[-1][0])
    rng = np.random.default_rng(5)
    for size in (60, 600):
        texts = [" ".join(map(str, rng.integers(0, 1 << 60, 3000))) for _ in range(size)]
        window_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).count()
        bits, shape = made[-1]
        word = __import__("fluxloom.llm.common", fromlist=["x"]).WordHashes()
        g = np.concatenate([window_dedup.grams(word.of(t.encode().split()), 50)[0] for t in texts[:60]])
        assert shape.full(bits, g).mean() < 0.1
    assert made[0][1].log2_width < made[1][1].log2_width


# 8 -----------------------------------------------------------------------------------------


def test_quality_classifier(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ranker = quality_classifier.fit(d, labels)
    j = quality_classifier.score(d, ranker).join(labels, "doc_id").where(quality_classifier.held_out(F.col("doc_id")))
    right = j.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).head()[0]
    assert right >= 0.95
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(docs, ranker).collect())
    assert quality_classifier.score(docs, ranker).count() == docs.count() and quality_classifier.score(empty, ranker).count() == 0
    assert quality_classifier.accepted(docs, ranker).columns == docs.columns
    blank = quality_classifier.fit(docs, labels.limit(0))
    assert all(abs(r.score - 0.3) < 1e-9 for r in quality_classifier.score(docs, blank).collect())


def test_pairwise_fit_against_plain_descent():
    """The weights minimise the mean logistic loss of all drawn differences: plain descent on the differences themselves ends there too."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 120)
    x = (rng.normal(size=(120, 6)) + y[:, None] * [1, 0.5, 0, -0.5, 0, 0]).astype(np.float32)
    got = np.array(quality_classifier.fit_pairs(x, y, n_pairs=3000, l2=0.01).weights)
    draw = np.random.default_rng(7)
    i, j = draw.choice(np.flatnonzero(y == 1), 3000), draw.choice(np.flatnonzero(y == 0), 3000)
    d, w = (x[i] - x[j]).astype(float), np.zeros(6)
    for _ in range(6000):
        w += 0.3 * ((d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) - 0.01 * w)
    assert np.allclose(got, w, atol=1e-4)
    ranker = quality_classifier.fit_pairs(x, y, n_pairs=3000)
    assert (ranker.scores(x) >= 0.3).sum() == (y == 1).sum()  # the quantile at the share of label 0


def test_grams_are_hashed_words_and_trigrams():
    one = quality_classifier.grams(b"abc abd ABC")
    assert np.isclose((one**2).reshape(2, -1).sum(axis=1), 1).all()
    assert (quality_classifier.grams(b"abc\tabd\n\nabc")[: quality_classifier.BUCKETS] == one[: quality_classifier.BUCKETS]).all()
    long = b"word one two three " * 20_000
    assert np.allclose(quality_classifier.grams(long), quality_classifier.grams(b"word one two three " * 2000), atol=2e-3)
    assert not quality_classifier.grams(b"").any() and quality_classifier.matrix([]).shape == (0, quality_classifier.WIDTH)


def test_buckets_are_those_that_tell_labels_apart():
    n = np.array([10, 30])
    counts = np.array([[10, 30], [9, 0], [0, 0], [1, 29], [5, 15], [0, 3]])  # shares of label 0 and 1: equal, apart, none, apart, equal, a little apart
    assert quality_classifier.telling(counts, n, 2).tolist() == [1, 3]
    assert quality_classifier.telling(counts, n, 3).tolist() == [1, 3, 5]
    assert quality_classifier.telling(counts, n, 9).tolist() == [0, 1, 3, 4, 5]  # buckets without a text get no weight


def test_chosen_buckets_are_those_of_all():
    t = b"Some words, some of THEM twice.\nsome words again " * 3
    at = np.array([0, 5, 40, quality_classifier.BUCKETS - 1, quality_classifier.BUCKETS, 2 * quality_classifier.BUCKETS - 1])
    at = np.unique(np.concatenate([at, np.flatnonzero(quality_classifier.grams(t))[::3]]))
    assert np.array_equal(quality_classifier.grams(t, at), quality_classifier.grams(t)[at])
    assert quality_classifier.matrix([t, b""], at).shape == (2, len(quality_classifier.SURFACE) + len(at))
    long = np.array(quality_classifier.surface(t * 3000))
    assert (long >= 0).all() and (long <= 1).all() and np.allclose(long[2:9], np.array(quality_classifier.surface(t))[2:9], atol=0.02)
    assert all(np.isfinite(quality_classifier.surface(x)).all() for x in (b"", b" ", b"\n\n", b"\xff" * 9, b"a"))


def test_held_out_by_crc(spark):
    df = spark.range(50).select(F.col("id").alias("i"), quality_classifier.held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.i).encode()) % 5 == 0) for r in df.collect())

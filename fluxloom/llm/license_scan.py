"""License scans: exact phrases, and a fuzzy search for short notices.

A notice found with at most k edits holds at least two of its k + 2 pieces unchanged
(pigeonhole). One Aho-Corasick automaton finds all pieces of all notices in one pass;
each hit says where the notice would stand, give or take k. Where two different
pieces agree, the least number of edits is counted for every end (bit-parallel, exact);
at an end with k or fewer, the regex library's matching, bounded by that least number
and the few characters it can reach, verifies the notice and reports its span.

Edits may fall anywhere but in the words that tell notices apart (`KEY_WORDS`): the
span must hold those of the notice and no others. A key word of three letters or more may
have one edit, where no other one is as near ("mlt" is mit). What the span leaves of the words
at its ends is k characters at most. Both searches read the words of the whole text,
lower-cased and joined by one space, so line breaks and punctuation in a notice do not
count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common, files

#: Phrases that the contract names, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices searched with edits, and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("spdx license identifier", "spdx"),
    ("all rights reserved", "all-rights-reserved"),
    ("licensed under the mit license", "mit"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under the apache license", "apache"),
    ("licensed under cc by nd", "cc-by-nd"),
    ("licensed under cc by nc sa", "cc-by-nc-sa"),
    ("licensed under cc by nc nd", "cc-by-nc-nd"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("creative commons zero", "cc0"),
    ("cc0 1 0 universal", "cc0"),
    ("licensed under cc0", "cc0"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("licensed under the isc license", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under the unlicense", "unlicense"),
    ("mozilla public license 2 0", "mpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("available under the gpl v2", "gpl"),
    ("available under the gpl v3", "gpl"),
    ("licensed under the gpl", "gpl"),
    ("licensed under the lgpl", "lgpl"),
    ("licensed under the agpl", "agpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("eclipse public license", "epl"),
    ("european union public licence", "eupl"),
    ("artistic license 2 0", "artistic"),
    ("boost software license", "bsl"),
    ("business source license", "busl"),
    ("licensed under the zlib license", "zlib"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("common development and distribution license", "cddl"),
    ("microsoft public license", "ms-pl"),
    ("sil open font license", "ofl"),
    ("academic free license", "afl"),
    ("open software license", "osl"),
    ("ncsa open source license", "ncsa"),
    ("licensed under the postgresql license", "postgresql"),
    ("python software foundation license", "psf"),
    ("open database license", "odbl"),
    ("server side public license", "sspl"),
    ("elastic license 2 0", "elastic"),
    ("universal permissive license", "upl"),
    ("redistributions of source code must retain the above copyright notice", "bsd"),
    ("this project is dual licensed under", "dual"),
]
#: Words that name a licence.
KEY_WORDS = frozenset(b"mit apache gnu lesser affero cc by nc sa nd bsd mozilla creative commons isc mpl spdx cc0 zero sharealike noncommercial noderivatives unlicense gpl lgpl agpl v2 v3 eclipse artistic boost business zlib microsoft sil academic ncsa postgresql python database elastic".split())


@dataclass(frozen=True)
class Hit:
    label: str
    start: int  # characters of the words' text (bytes of its UTF-8)
    end: int
    edits: int
    notice_len: int


class NoticeSearch:
    """max_error: edits allowed for each character of a notice (rounded down, so the shortest take none). key_words stand as they are in the notice; notices of one's own have none unless they are given."""

    def __init__(self, notices=None, max_error: float = 0.1, key_words: frozenset[bytes] | None = None):
        import ahocorasick

        self.key_words = key_words if key_words is not None else frozenset() if notices else KEY_WORDS
        notices = notices or NOTICES
        self.known = {w for text, _ in notices for w in text.encode().split()} | self.key_words

        self.notices, seeds = [], {}
        for n, (text, label) in enumerate(notices):
            text = text.encode()
            k = int(len(text) * max_error)
            self.notices.append((text, label, k, {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in set(text)}))
            pieces = k + 2 if k else 1
            cuts = [len(text) * i // pieces for i in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[a:b].decode("latin-1"), []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def _agreed(self, found: list[tuple[int, int]], size: int, k: int, end: int) -> Iterator[tuple[int, int]]:
        """Where the notice may stand: stretches around starts at which enough different pieces agree (two edits' paths differ by 2k at most)."""
        spans = []
        for i, (at, piece) in enumerate(found):
            if k:
                j = i + 1
                while j < len(found) and found[j][0] - at <= 2 * k and found[j][1] == piece:
                    j += 1
                if j == len(found) or found[j][0] - at > 2 * k:
                    continue
                spans.append((max(0, at - 2 * k), min(end, at + size + 3 * k)))
            else:
                spans.append((max(0, at), min(end, at + size)))
        return _joined(spans)

    def find(self, words: bytes) -> list[Hit]:
        """All matches that do not overlap one of the same notice; words are joined by one space, with one at each end."""
        seeds: dict[int, list[tuple[int, int]]] = {}
        for end, (size, owners) in self.automaton.iter(words.decode("latin-1")):
            for n, offset in owners:
                seeds.setdefault(n, []).append((end + 1 - size - offset, offset))
        hits = []
        for n, found in seeds.items():
            text, label, k, masks = self.notices[n]
            for a, b in self._agreed(sorted(found), len(text), k, len(words)):
                if not k:
                    at = words.find(text, a, b)
                    while at >= 0:
                        hits.append((Hit(label, at, at + len(text), 0, len(text)), n))
                        at = words.find(text, at + len(text), b)
                else:
                    while found_at := nearest_end(words, a, b, masks, len(text), k):
                        end, edits = found_at
                        m = within(text, edits).search(words, max(a, end - len(text) - edits), end)
                        hits.append((Hit(label, m.start(), m.end(), edits, len(text)), n))
                        a = m.end()
        return sorted((h for h, n in hits if self._is_notice(words, h, n)), key=lambda h: (h.start, h.end, h.label))

    def _is_notice(self, words: bytes, h: Hit, n: int) -> bool:
        """Whether what the span leaves of the words at both ends is no more than the notice's edits, and its key words stand there."""
        text, _, k, _ = self.notices[n]
        before = 0 if words[h.start : h.start + 1] == b" " else h.start - 1 - words.rfind(b" ", 0, h.start)
        end = words.find(b" ", h.end)
        after = 0 if words[h.end - 1 : h.end] == b" " else (end if end >= 0 else len(words)) - h.end
        if before + after > k:
            return False
        there = words[h.start - before : h.end + after].split()
        whole = range(bool(before), len(there) - bool(after))  # words of which the span leaves nothing
        named = [w if w in self.key_words else self.near_key(w) if i in whole else None for i, w in enumerate(there)]
        return sorted(w for w in named if w) == sorted(w for w in text.split() if w in self.key_words)

    def near_key(self, word: bytes) -> bytes | None:
        """The only key word of three letters or more that is one edit from a word that no notice has."""
        if word in self.known or len(word) < 2:
            return None
        near = [w for w in self.key_words if len(w) > 2 and one_edit(w, word)]
        return near[0] if len(near) == 1 else None


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one letter put in, left out or changed makes b of a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def nearest_end(words: bytes, a: int, b: int, masks: dict[int, int], size: int, k: int) -> tuple[int, int] | None:
    """Where the first match with k edits at most ends in words[a:b], and its edits: of the ends within 2k of the first one, that with the fewest (Myers' bit vectors)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, edits, best, last = full, 0, size, None, b
    for at in range(a, b):
        if at > last:
            break
        equal = masks.get(words[at], 0)
        x = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(x | up)), up & x
        edits += bool(plus & top) - bool(minus & top)
        plus, minus, equal = plus << 1 & full, minus << 1 & full, equal | down
        up, down = minus | (full & ~(equal | plus)), plus & equal
        if edits <= k and (best is None or edits < best[1]):
            last = at + 2 * k if best is None else last
            best = at + 1, edits
    return best


@cache
def within(text: bytes, edits: int) -> regex.Pattern:
    return regex.compile(rb"(?:%s){e<=%d}" % (regex.escape(text), edits))


def _joined(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    held = None
    for a, b in spans:
        if held and a <= held[1]:
            held = held[0], max(b, held[1])
        else:
            if held:
                yield held
            held = a, b
    if held:
        yield held


def phrase_places(words: bytes, phrases=PHRASES) -> list[tuple[int, str]]:
    """(byte offset, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = words.find(needle)
        while at >= 0:
            out.append((at + 1, label))
            at = words.find(needle, at + 1)
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_error: float = 0.1, notices=None) -> DataFrame:
    """Per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    spans: array of (label, first_word, n_words, edits) of the fuzzy search. score is
    1 with an exact phrase, else the best notice's share of unedited characters,
    else 0. A null or empty text has no words, no places, empty labels and score 0;
    null ids, repeated rows and empty tables need no rule; other columns are left
    behind; a text of any length is searched whole. Map only: no shuffle.
    """
    common.tuned(docs.sparkSession)
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64())]))
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)])

    def rows(batches):
        search = NoticeSearch(notices, max_error)
        for b in batches:
            for doc, text in zip(common.column(b, "doc").to_pylist(), common.texts(b), strict=True):
                split = text.translate(common.PLAIN).split()
                words = b" " + b" ".join(split) + b" "
                base = phrase_places(words)
                hits = search.find(words)
                blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) if base or hits else None
                word_at = lambda at: int(np.searchsorted(blanks, at, "right")) - 1  # noqa: B023, E731
                ends = [word_at(base[0][0]), word_at(base[-1][0])] if base else [None, None]
                own = {label for _, label in base}
                score = 1.0 if base else max((1 - h.edits / h.notice_len for h in hits), default=0.0)
                yield [doc, len(split), len(base), *ends, ",".join(sorted(own)), ",".join(sorted(own | {h.label for h in hits})), score, [{"label": h.label, "first_word": max(0, word_at(h.start)), "n_words": len(words[h.start : h.end].split()), "edits": h.edits} for h in hits]]

    return (
        common.keyed(docs, id_col, text_col)
        .select("doc", "text")
        .mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema)), "doc long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,edits:long>>")
        .withColumnRenamed("doc", id_col)
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))

"""BPE encoding and decoding: speculate and verify.

For each new word a greedy longest match proposes tokens. A sequence of tokens is
what the merges make of a word exactly if each token comes out of its own
characters alone and each adjacent pair comes out of its joined characters; so the
proposals of a batch are tested pair by pair, all at once, against a table of pairs
that have been tried. Only words with a failing pair go to the exact merges. All three
steps run over whole batches of words: the match walks a trie, and the merges take
one step in every word at a time. Words of over LONG bytes are merged one by one.

Texts are handled in pieces between ASCII white space, which neither the
normaliser nor the pre-tokeniser looks across; a cache bounded in bytes keeps the ids
of pieces and words seen lately.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, files

#: Of each line: Latin letters, then ASCII signs (no apostrophe, no "<|"), which the normaliser lowers letter by letter and the pre-tokeniser cuts in at most two; or else the whole line.
PIECES = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-;=-@\[-`{-~]*)|(.+))$", re.MULTILINE).findall
LONG = 64
END = 256  # the end of a word, after its bytes
NEVER = np.int32(np.iinfo(np.int32).max)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Table:
    """A map from non-negative 64-bit keys to 32-bit numbers, looked up and added to by arrays (open addressing)."""

    def __init__(self, keys=(), values=(), missing: int = -1):
        self.missing, self.n = missing, 0
        self._empty(4)
        self.add(np.asarray(keys, np.int64), np.asarray(values, np.int32))

    def _empty(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.missing, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * common.MIX >> np.uint64(64 - self.bits)).view(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys are distinct and new."""
        self.n += len(keys)
        if 3 * self.n > self.mask:
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self._empty((4 * self.n).bit_length())
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at, first = np.unique(slot[todo], return_index=True)
            first = first[self.keys[at] < 0]
            own = todo[first]
            self.keys[slot[own]], self.values[slot[own]] = keys[own], values[own]
            todo = np.delete(todo, first)
            slot[todo] = (slot[todo] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        hit = found == keys
        out = np.where(hit, self.values[slot], np.int32(self.missing))
        more = np.flatnonzero(~hit & (found >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            found = self.keys[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out


def spread(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for; `new` gathers them."""

    def __init__(self):
        self.new = []

    def __missing__(self, key: bytes) -> int:
        k = self[key] = len(self)
        self.new.append(key)
        return k

    def of(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class Lists:
    """Runs of ids, one after another in an array that grows by halves."""

    def __init__(self):
        self.flat, self.size, self.start, self.n, self.end = np.empty(1 << 12, np.int32), np.empty(1 << 10, np.int32), np.empty(1 << 10, np.int64), 0, 0

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        n, end = self.n + len(size), self.end + len(flat)
        if n > len(self.size):
            self.size, self.start = np.resize(self.size, n * 3 // 2), np.resize(self.start, n * 3 // 2)
        if end > len(self.flat):
            self.flat = np.resize(self.flat, end * 3 // 2)
        self.flat[self.end : end], self.size[self.n : n] = flat, size
        self.start[self.n : n] = self.end + np.cumsum(size) - size
        self.n, self.end = n, end

    def of(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs k, one after another, and their sizes."""
        size = self.size[k].astype(np.int64)
        return self.flat[np.repeat(self.start[k], size) + spread(size)], size


class PieceEncoder:
    """Texts to ids by way of pieces and words, remembered up to a bound in bytes. encode_words() is the subclass's.

    Special tokens in a text are themselves, as in the library.
    """

    #: Bytes of text that are handled together.
    group = 4 << 20

    def __init__(self, path: str, cache_bytes: int = 16 << 20):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        self.norm, self.split, self.tokenize = lib.normalizer, lib.pre_tokenizer, lib.model.tokenize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        self.chars = byte_characters()
        self.bytes = {c: b for b, c in self.chars.items()}
        self.most = cache_bytes
        self.forget()
        self.prepare(spec)

    def prepare(self, spec: dict) -> None:
        pass

    def forget(self) -> None:
        """Only special tokens and the empty word are known."""
        self.words, self.ids, self.held = Numbered(), Lists(), 0
        self.pieces, self.piece_ids = Numbered(), Lists()
        known = sorted(self.special.values())
        self.words.of([b"", *((i,) for i in known)])
        self.words.new = []
        self.ids.add(np.array(known, np.int32), np.array([0] + [1] * len(known)))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words (UTF-8 of the normalised word, whose end is a word's end), one after another, and how many each has."""
        raise NotImplementedError

    # -- pieces and texts --------------------------------------------------------------
    def _learn(self, pieces: list[bytes]) -> None:
        letters, signs, odd = zip(*PIECES(b"\n".join(pieces).decode()), strict=True)
        # letters are lowered one by one: none of them looks at its neighbours
        letters, signs = ("\n".join(x).lower().encode().split(b"\n") for x in (letters, signs))
        words = self.words
        two = np.stack([words.of(letters), words.of(signs)], axis=1)
        count = np.full(len(pieces), 2)
        plans = {k: words.of(self._segments(pieces[k])) for k, whole in enumerate(odd) if whole}
        for k, plan in plans.items():
            count[k] = len(plan)
        segment, first = np.empty(int(count.sum()), np.int64), np.cumsum(count) - count
        plain = np.delete(np.arange(len(pieces)), list(plans))
        segment[first[plain]], segment[first[plain] + 1] = two[plain, 0], two[plain, 1]
        for k, plan in plans.items():
            segment[first[k] : first[k] + len(plan)] = plan
        if new := words.new:
            words.new = []
            self.ids.add(*self.encode_words(new))
            self.held += sum(map(len, new)) + 180 * len(new)
        flat, size = self.ids.of(segment)
        total = np.concatenate([[0], np.cumsum(size)])
        self.piece_ids.add(flat, total[first + count] - total[first])
        self.held += sum(map(len, pieces)) + 4 * len(flat) + 180 * len(pieces)

    def _segments(self, piece: bytes) -> list[bytes | tuple[int]]:
        """Words, and special tokens' ids."""
        of = self.bytes
        return [w for part in self._between_specials(piece) for w in ([(part,)] if isinstance(part, int) else [bytes(map(of.__getitem__, w)) for w, _ in self.split.pre_tokenize_str(self.norm.normalize_str(part))])]

    def _between_specials(self, piece: bytes) -> Iterator[str | int]:
        if b"<|" not in piece:
            yield piece.decode()
            return
        at = 0
        while at < len(piece):
            found = min(((k, -len(s), s) for s in self.special if (k := piece.find(s, at)) >= 0), default=None)
            if not found:
                break
            if found[0] > at:
                yield piece[at : found[0]].decode()
            yield self.special[found[2]]
            at = found[0] + len(found[2])
        if at < len(piece):
            yield piece[at:].decode()

    def encode_batch(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """ids of each text."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < self.group):
                size += len(texts[j])
                j += 1
            if self.held > self.most:
                self.forget()
            of = [self.pieces.of(t.split()) for t in texts[i:j]]
            if new := self.pieces.new:
                self.pieces.new = []
                self._learn(new)
            flat, sizes = self.piece_ids.of(np.concatenate(of))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0] + [len(x) for x in of])].tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                yield flat[a:b]
            i = j


class LibraryBpe(PieceEncoder):
    """Words go to the library's own model."""

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, chars = self.tokenize, self.chars
        ids = [[t.id for t in tokenize(w.decode("latin-1").translate(chars))] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for own in ids for i in own), np.int64, int(sizes.sum())), sizes


class SpeculativeBpe(PieceEncoder):
    """Encodes and decodes as the tokenizers library does with the same file (BPE with an end-of-word suffix, byte-level alphabet)."""

    group = 1 << 20

    def prepare(self, spec: dict) -> None:
        del self.tokenize  # the library's model is not needed
        model = spec["model"]
        suffix, of = model["end_of_word_suffix"] or "", self.bytes
        vocab = model["vocab"]
        self.strings = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        own = {i: (t[: -len(suffix)], True) if suffix and t.endswith(suffix) else (t, False) for t, i in vocab.items()}
        #: id -> (bytes, whether a word ends with it); only tokens of the alphabet can come out of merges
        self.tokens = {i: (bytes(map(of.__getitem__, t)), e) for i, (t, e) in own.items() if t and all(c in of for c in t)}
        self.size = max(self.strings) + 1
        self.first, self.last = np.full(256, self.size, np.int32), np.full(256, self.size, np.int32)
        for i, (t, e) in self.tokens.items():
            if len(t) == 1:
                (self.last if e else self.first)[t[0]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        joined = [(vocab[a], vocab[b], vocab[a[: len(a) - (len(suffix) if suffix and a.endswith(suffix) else 0)] + b]) for a, b in pairs]
        a, b, self.made = (np.array(x, np.int64) for x in zip(*joined, strict=True))
        code, rank = np.unique(a * (self.size + 1) + b, return_index=True)  # the first of equals counts
        self.ranks = Table(code, rank, int(NEVER))
        ids = sorted(self.tokens)
        flat, sizes = self.merged([self.tokens[i][0] for i in ids], np.array([self.tokens[i][1] for i in ids], bool))
        alone = (sizes == 1) & (flat[np.cumsum(sizes) - sizes] == np.array(ids))
        self._trie([i for i, x in zip(ids, alone.tolist(), strict=True) if x])
        self.tried = Table()  # pairs a * (size + 1) + b -> whether they stay apart
        self.exact_words = self.proposed_words = 0

    def _trie(self, ids: list[int]) -> None:
        step: dict[int, int] = {}
        accept, n = {}, 1
        for i in ids:
            t, e = self.tokens[i]
            at = 0
            for c in (*t, END) if e else t:
                key = at * 257 + c
                if key not in step:
                    step[key], n = n, n + 1
                at = step[key]
            accept[at] = i
        self.step = Table(list(step), list(step.values()))
        self.accept = np.full(n, -1, np.int32)
        self.accept[list(accept)] = list(accept.values())

    # -- exact merging ---------------------------------------------------------------
    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ranks.get(a.astype(np.int64) * (self.size + 1) + b)

    def merged(self, words: list[bytes], ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges in order of rank, leftmost first: ids of all words, one after another, and how many each has. The last byte of an ended word has the end to it."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        flat = np.append(self.first[data], np.int32(self.size))  # the last one pads
        at = (start + length - 1)[ended]
        flat[at] = self.last[data[at]]
        rows, ids, sizes = [], [], []
        low = 0
        for width in (1, 4, 6, 8, 10, 13, 17, 24, 40, LONG):
            own = np.flatnonzero((length > low) & (length <= width))
            low = width
            for k in range(0, len(own), 1 << 15):
                part = own[k : k + (1 << 15)]
                cols = np.arange(width)
                m = flat[np.where(cols < length[part, None], start[part, None] + cols, len(flat) - 1)]
                for r, i, z in self._merge_rows(m, length[part]):
                    rows.append(part[r])
                    ids.append(i)
                    sizes.append(z)
        for k in np.flatnonzero(length > LONG).tolist():
            own = self._merged_long(flat[start[k] : start[k] + length[k]].tolist())
            rows.append(np.array([k]))
            ids.append(np.array(own, np.int32))
            sizes.append(np.array([len(own)]))
        size = np.zeros(n, np.int64)
        if not n:
            return np.empty(0, np.int32), size
        rows, sizes = np.concatenate(rows), np.concatenate(sizes)
        size[rows] = sizes
        out = np.empty(int(size.sum()), np.int32)
        out[np.repeat((np.cumsum(size) - size)[rows], sizes) + spread(sizes)] = np.concatenate(ids)
        return out, size

    def _merge_rows(self, m: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their ids one after another, how many) as rows run out of merges; one merge of each row at a time."""
        row = np.arange(len(m))
        r = self.rank(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        while len(row):
            if m.shape[1] > 1:
                p = r.argmin(axis=1)
                best = r[np.arange(len(p)), p]
                live = best < NEVER
            else:
                live = np.zeros(len(row), bool)
            if not live.all():
                done = m[~live]
                yield row[~live], done[np.arange(m.shape[1]) < size[~live, None]], size[~live]
                if not live.any():
                    return
                row, m, r, size, p, best = row[live], m[live], r[live], size[live], p[live], best[live]
            k, cols = np.arange(len(p)), np.arange(m.shape[1] - 1)
            after = cols > p[:, None]
            m = np.where(after, m[:, 1:], m[:, :-1])
            m[k, p] = new = self.made[best]
            r = np.where(after[:, :-1] | (cols[:-1] == p[:, None]), r[:, 1:], r[:, :-1])
            size = size - 1
            if (left := np.flatnonzero(p > 0)).size:
                r[left, p[left] - 1] = self.rank(m[left, p[left] - 1], new[left])
            if (right := np.flatnonzero(p < m.shape[1] - 1)).size:
                r[right, p[right]] = self.rank(new[right], m[right, p[right] + 1])
            widest = int(size.max())
            if widest < m.shape[1]:
                m, r = m[:, :widest], r[:, : max(widest - 1, 0)]

    def _merged_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = np.array(ids, np.int64)
        ranks = {}  # of pairs met so far

        def rank(a: int, b: int) -> int:
            if (a, b) not in ranks:
                ranks[a, b] = int(self.rank(np.array([a]), np.array([b]))[0])
            return ranks[a, b]

        heap = [(r, i, a, b) for i, (r, a, b) in enumerate(zip(self.rank(pairs[:-1], pairs[1:]).tolist(), ids, ids[1:], strict=False)) if r < NEVER]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            new = int(self.made[r])
            ids[i], gone[j], nxt[i] = new, True, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if (p := prv[i]) >= 0 and (r := rank(ids[p], new)) < NEVER:
                heapq.heappush(heap, (r, p, ids[p], new))
            if (k := nxt[i]) < n and (r := rank(new, ids[k])) < NEVER:
                heapq.heappush(heap, (r, i, new, ids[k]))
        return [x for x, g in zip(ids, gone, strict=True) if not g]

    # -- speculation -----------------------------------------------------------------
    def proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over tokens that come out of their own characters: ids of all words, one after another, and how many each has (0: it got stuck)."""
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.cumsum(n) - n
        text = np.full(int(n.sum()) + 1, END, np.int64)
        text[np.delete(np.arange(len(text) - 1), start + n - 1)] = np.frombuffer(b"".join(words), np.uint8)
        word = np.flatnonzero(n <= LONG + 1)
        j = np.zeros(len(word), np.int64)  # the place looked at; after it the end of the best token so far
        state, best, end = j.copy(), np.full(len(word), -1, np.int32), j.copy()
        owners, found = [], []
        stuck = n > LONG + 1
        while len(word):
            size = n[word]
            go = self.step.get(state * 257 + text[np.minimum(start[word] + j, len(text) - 1)])
            on = (go >= 0) & (j < size)
            state = np.where(on, go, 0).astype(np.int64)
            j = j + on
            own = self.accept[state]
            good = on & (own >= 0) & (j != size - 1)  # the end is never left on its own
            best, end = np.where(good, own, best), np.where(good, j, end)
            halt = ~on
            if halt.any():
                lost = halt & (best < 0)
                stuck[word[lost]] = True
                out = halt & ~lost
                owners.append(word[out])
                found.append(best[out])
                j = np.where(out, end, j)
                best = np.where(out, np.int32(-1), best)
                stay = ~(lost | (out & (j == size)))
                word, j, state, best, end = word[stay], j[stay], state[stay], best[stay], end[stay]
        if not owners:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        owners, found = np.concatenate(owners), np.concatenate(found)
        fine = ~stuck[owners]
        owners, found = owners[fine], found[fine]
        return found[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For adjacent tokens a[k], b[k]: whether the merges of their joined characters give just these two."""
        code, back = np.unique(a.astype(np.int64) * (self.size + 1) + b, return_inverse=True)
        fits = self.tried.get(code)
        if (new := np.flatnonzero(fits < 0)).size:
            left, right = code[new] // (self.size + 1), code[new] % (self.size + 1)
            texts = [self.tokens[x][0] + self.tokens[y][0] for x, y in zip(left.tolist(), right.tolist(), strict=True)]
            flat, sizes = self.merged(texts, np.fromiter((self.tokens[y][1] for y in right.tolist()), bool, len(right)))
            at, two = np.cumsum(sizes) - sizes, sizes == 2
            ok = np.zeros(len(new), np.int32)
            ok[two] = (flat[at[two]] == left[two]) & (flat[at[two] + 1] == right[two])
            if self.tried.n > 300_000:
                self.tried = Table()
            self.tried.add(code[new], ok)
            fits[new] = ok
        return fits[back] > 0

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, size = self.proposed(words)
        owner = np.repeat(np.arange(len(words)), size)
        bad = size == 0
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            bad[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        self.proposed_words += len(words)
        self.exact_words += int(bad.sum())
        if not bad.any():
            return flat, size
        failing = np.flatnonzero(bad)
        exact, sizes = self.merged([words[k] for k in failing.tolist()], np.ones(len(failing), bool))
        keep = ~bad[owner]
        kept, size[failing] = flat[keep], sizes
        out, start = np.empty(int(size.sum()), np.int32), np.cumsum(size) - size
        good = np.flatnonzero(~bad)
        out[np.repeat(start[good], size[good]) + spread(size[good])] = kept
        out[np.repeat(start[failing], sizes) + spread(sizes)] = exact
        return out, size

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by one space: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


_loaded: dict[tuple[type, str], PieceEncoder] = {}


def loaded(path: str, kind: type[PieceEncoder] = SpeculativeBpe, **options) -> PieceEncoder:
    """A worker's encoder for the file, kept between tasks; its caches are bounded in bytes."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path, **options)
    return _loaded[kind, path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = True, digests: bool = False) -> DataFrame:
    """One row per row of docs: the id, ids (binary, little-endian uint32), n_tokens and the decoded text.

    A null text is empty: no ids, an empty decoded text. Rows are independent, so
    null ids, repeated rows and empty tables need no rule; columns other than id_col
    and text_col are left behind. With digests, SHA-256 of ids and decoded text
    stand in their place (for tables of results). Map only: no shuffle.
    """
    common.tuned(docs.sparkSession, 4 << 20, 500)  # ids and decoded texts take several times the text
    path = path or vocabulary_path()
    cols = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string" if with_decoded else "ids binary"

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"][: 2 + with_decoded]
    schema = pa.schema([("doc", pa.int64()), *zip(names, [pa.int64(), pa.string() if digests else pa.binary(), pa.string()], strict=False)])

    def rows(batches):
        bpe = loaded(path)
        for b in batches:
            for doc, ids in zip(common.column(b, "doc").to_pylist(), bpe.encode_batch(common.texts(b)), strict=True):
                raw = ids.astype("<u4").tobytes()
                if digests:
                    yield [doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()]
                else:
                    yield [doc, len(ids), raw, bpe.decode(ids)] if with_decoded else [doc, len(ids), raw]
        bpe.forget()

    slim = common.keyed(docs, id_col, text_col).select("doc", "text")
    return slim.mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema, 1024)), f"doc long, n_tokens long, {cols}").withColumnRenamed("doc", id_col)


def op6_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), digests=True)

"""Tile-compressed FITS images (FITS Standard 4.0, section 10): RICE_1, GZIP_1 and GZIP_2 tiles of whole rows."""

from __future__ import annotations

import math
import re
import zlib
from functools import cache

import numpy as np

#: Fixed values of the standard: bytes of a table's column types, and of a Rice block's selector and its largest value by pixel size.
_BYTES = {"L": 1, "B": 1, "I": 2, "J": 4, "K": 8, "E": 4, "D": 8, "P": 8, "Q": 16}
_RICE = {1: (3, 6), 2: (4, 14), 4: (5, 25)}
_CELLS = {"B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


def is_compressed(head: dict) -> bool:
    return head.get("ZIMAGE") is True and head.get("ZNAXIS") == 2


def columns(head: dict) -> dict[str, tuple[int, str]]:
    """Offset in a table row and type letter of each column."""
    out, at = {}, 0
    for k in range(1, head["TFIELDS"] + 1):
        n, letter = re.match(r"(\d*)([A-Z])", head[f"TFORM{k}"]).groups()
        out[head.get(f"TTYPE{k}", f"{k}")] = (at, letter)
        at += _BYTES[letter] * int(n or 1)
    return out


@cache
def dither() -> np.ndarray:
    """Fixed values of the standard: 10,000 numbers of the generator x -> 16807 x mod (2^31 - 1) from 1 on."""
    out, x = np.empty(10_000), 1
    for k in range(10_000):
        x = x * 16807 % 2147483647
        out[k] = x / 2147483647
    return out


def unrice(data: bytes, n: int, size: int, block: int = 32) -> np.ndarray:
    """n integers of `size` bytes from a Rice-coded tile: the first as it is, then differences in blocks."""
    select, most = _RICE[size]
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    total = len(bits)
    ones = np.flatnonzero(bits)
    after = np.full(total + 1, total, np.int64)  # the first set bit from each place on
    after[ones] = ones
    after = np.minimum.accumulate(after[::-1])[::-1].tolist()
    weights = [(1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else np.zeros(0, np.int64) for k in range(65)]
    number = lambda at, k: int(bits[at : at + k].astype(np.int64) @ weights[k])
    first, at = number(0, 8 * size), 8 * size
    out = np.empty(n, np.int64)
    for begin in range(0, n, block):
        m = min(block, n - begin)
        low = number(at, select) - 1
        at += select
        if low < 0:
            out[begin : begin + m] = 0
        elif low == most:
            out[begin : begin + m] = bits[at : at + 8 * size * m].reshape(m, -1).astype(np.int64) @ weights[8 * size]
            at += 8 * size * m
        else:
            high, places = [0] * m, [0] * m
            for k in range(m):
                one = after[at]
                high[k], places[k] = one - at, one + 1
                at = one + 1 + low
            tail = bits[np.array(places)[:, None] + np.arange(low)].astype(np.int64) @ weights[low] if low else 0
            out[begin : begin + m] = (np.array(high, np.int64) << low) + tail
    half = out >> 1
    steps = np.where(out & 1, ~half, half)
    kind = np.dtype(f"i{size}" if size > 1 else "u1")
    return (np.cumsum(steps) + first).astype(np.int64).astype(kind)  # sums run over as the numbers do


def gunzip(data: bytes, n: int, kind: np.dtype, shuffled: bool) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data, 31), np.uint8)
    if shuffled:  # all first bytes, then all second ones
        raw = raw.reshape(kind.itemsize, n).T.reshape(-1)
    return np.frombuffer(raw.tobytes(), kind, n)


def rows(f, head: dict, at: int, y0: int, y1: int) -> np.ndarray:
    """Rows y0 to y1 of a compressed unit whose table begins at `at`: only their tiles are read."""
    w, h = head["ZNAXIS1"], head["ZNAXIS2"]
    if head.get("ZTILE1", w) != w:
        raise ValueError("tiles of parts of rows are not read")
    deep, cols, wide, method = head.get("ZTILE2", 1), columns(head), head["NAXIS1"], head["ZCMPTYPE"].strip()
    if method not in ("RICE_1", "RICE_ONE", "GZIP_1", "GZIP_2"):
        raise ValueError(f"tiles of {method} are not read")
    names = {head[k]: head[f"ZVAL{k[5:]}"] for k in head if k.startswith("ZNAME")}
    bitpix = head["ZBITPIX"]
    real, stored = bitpix < 0, np.dtype({8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bitpix])
    heap = at + head.get("THEAP", wide * head["NAXIS2"])
    t0, t1 = y0 // deep, math.ceil(y1 / deep)
    f.seek(at + t0 * wide)
    table = f.read((t1 - t0) * wide)

    def cell(name: str, t: int):
        if name not in cols:
            return head.get(name)
        place, letter = cols[name]
        return np.frombuffer(table, _CELLS[letter], 1, (t - t0) * wide + place)[0]

    def packed(name: str, t: int) -> bytes:
        if name not in cols:
            return b""
        place, letter = cols[name]
        n, offset = (int(v) for v in np.frombuffer(table, ">i4" if letter == "P" else ">i8", 2, (t - t0) * wide + place))
        f.seek(heap + offset)
        return f.read(n) if n else b""

    out = []
    for t in range(t0, t1):
        n = w * (min(h, (t + 1) * deep) - t * deep)
        data = packed("COMPRESSED_DATA", t)
        scale, zero = cell("ZSCALE", t), cell("ZZERO", t)
        if data and real and scale is not None:
            whole = unrice(data, n, names.get("BYTEPIX", 4), names.get("BLOCKSIZE", 32)) if method.startswith("RICE") else gunzip(data, n, np.dtype(">i4"), method == "GZIP_2")
            blank = cell("ZBLANK", t)
            how, shift = head.get("ZQUANTIZ", "NO_DITHER").strip(), 0.0
            if how.startswith("SUBTRACTIVE_DITHER"):
                r = dither()
                start = int(r[(t + head.get("ZDITHER0", 1) - 1) % 10_000] * 500)
                row = (t + head.get("ZDITHER0", 1) - 1) % 10_000
                take, places, left = [], start, n
                while left:  # the list is read from `start` on; at its end the next row's start follows
                    piece = r[places : places + left]
                    take.append(piece)
                    left -= len(piece)
                    if left:
                        row = (row + 1) % 10_000
                        places = int(r[row] * 500)
                shift = np.concatenate(take) - 0.5
            v = (whole - shift) * float(scale) + float(zero)
            if how == "SUBTRACTIVE_DITHER_2":
                v[whole == -2147483646] = 0.0  # a fixed value: exact zeros
            if blank is not None:
                v[whole == int(blank)] = np.nan
        elif data:
            whole = unrice(data, n, names.get("BYTEPIX", 4), names.get("BLOCKSIZE", 32)) if method.startswith("RICE") else gunzip(data, n, stored, method == "GZIP_2")
            v = linear(head, whole, cell("ZBLANK", t))
        elif raw := packed("GZIP_COMPRESSED_DATA", t):
            v = linear(head, gunzip(raw, n, stored, False), None)
        else:
            place, letter = cols["UNCOMPRESSED_DATA"]
            count, offset = (int(x) for x in np.frombuffer(table, ">i4" if letter == "P" else ">i8", 2, (t - t0) * wide + place))
            f.seek(heap + offset)
            v = linear(head, np.frombuffer(f.read(count * stored.itemsize), stored), None)
        out.append(v.reshape(-1, w))
    return np.concatenate(out)[y0 - t0 * deep : y1 - t0 * deep]


def linear(head: dict, data: np.ndarray, blank) -> np.ndarray:
    out = data.astype(float) * head.get("BSCALE", 1) + head.get("BZERO", 0)
    blank = head.get("BLANK", blank) if blank is None else blank
    return np.where(data == blank, np.nan, out) if blank is not None and data.dtype.kind != "f" else out

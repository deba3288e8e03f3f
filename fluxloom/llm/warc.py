"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Records are gzip members of their own (or plain, without compression); the reader also
takes members that hold several records, up to a whole file. It checks each record: the
member's CRC, the version line, the headers, the declared length, and the digests whose
algorithm and form it knows (SHA-1, SHA-2 and MD5 in base 32 or hex; others are not
checked). After a failed check it searches for the next place where a member or a
version line begins that passes the checks, goes on from there, and logs the bytes
between as a quarantined gap. Of a damaged member, the records before the damage are
kept if their block digests vouch for them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files

VERSION = b"WARC/1.1"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
ROLL_BYTES = 32 << 20  # a file is closed at this size, as readers hold one whole


# -- records -------------------------------------------------------------------------


def base32_sha1(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, n_payload: int, refers_to: int | None = None, revisit: bool = False, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record. A revisit holds HTTP headers alone and names the record that has the payload."""
    block = _HTTP % n_payload + (b"" if revisit else payload)
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest} {revisit}')}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {base32_sha1(digest)}",
        f"WARC-Block-Digest: {base32_sha1(hashlib.sha1(block).hexdigest())}",
        f"X-Payload-Length: {n_payload}",
    ]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
            head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to} {digest} False')}>")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with no time or name, so equal records give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


@dataclass
class Record:
    offset: int
    type: str
    headers: dict[str, str]
    block: bytes
    verified: bool | None = None  # by its block digest

    @property
    def payload(self) -> bytes:
        """The block, without its HTTP headers if it has any."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("Content-Type", "").lower().startswith("application/http") else self.block

    def number(self, name: str) -> int | None:
        v = self.headers.get(name)
        return int(v) if v is not None else None


@dataclass(frozen=True)
class Gap:
    offset: int
    length: int
    reason: str


class Damaged(Exception):
    pass


_VERSION, _BEGIN = re.compile(rb"WARC/[01]\.\d+\r\n"), re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d+\r\n")
_FOLD = re.compile(rb"\r\n[ \t]+")


def hex_digest(given: str | None) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of a digest header; None if its algorithm or form is not known."""
    name, _, value = (given or "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("sha1", "sha256", "sha384", "sha512", "md5"):
        return None
    size = hashlib.new(name).digest_size
    if len(value) == 2 * size and re.fullmatch("[0-9a-fA-F]+", value):
        return name, value.lower()
    try:
        raw = base64.b32decode(value.upper().rstrip("=") + "=" * (-len(value.rstrip("=")) % 8))
    except ValueError:
        return None
    return (name, raw.hex()) if len(raw) == size else None


def agrees(given: str | None, data: bytes) -> bool | None:
    """Whether the digest is that of the data; None if it can't be told."""
    known = hex_digest(given)
    return None if known is None else hashlib.new(known[0], data).hexdigest() == known[1]


def parse(data: bytes, at: int = 0, vouched: bool = False) -> tuple[Record, int]:
    """The plain record at `at` and where it ends; Damaged if a check fails. vouched: a checksum around it was right."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)  # a URL in the headers may be of any length
    if end < 0:
        raise Damaged("headers have no end")
    headers = {}
    for line in _FOLD.sub(b" ", data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("a header line has no colon")
        headers[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    try:
        n = int(headers["Content-Length"])
        kind = headers["WARC-Type"]
    except (KeyError, ValueError):
        raise Damaged("no type or no valid length") from None
    block = data[end + 4 : end + 4 + n]
    if n < 0 or len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    r = Record(at, kind, headers, block)
    r.verified = agrees(headers.get("WARC-Block-Digest"), block)
    if r.verified is False:
        raise Damaged("block digest differs")
    # what a payload is depends on its coding, so a digest of the block, or a checksum around it, comes first
    if kind == "response" and not r.verified and not vouched and agrees(headers.get("WARC-Payload-Digest"), r.payload) is False:
        raise Damaged("payload digest differs")
    for name in ("X-Page-Id", "X-Payload-Length", "X-Refers-To-Page-Id"):
        if name in headers and not re.fullmatch(r"-?\d+", headers[name]):
            raise Damaged(f"{name} is no number")
    return r, end + 8 + n


def deflate_start(data: bytes, at: int) -> int | None:
    """Where the compressed bytes of the gzip member at `at` begin; None if its header is none."""
    flags, place = (data[at + 3], at + 10) if at + 10 <= len(data) and data[at + 2] == 8 else (0xFF, at)
    if flags & 0xE0:
        return None
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for bit in (8, 16):  # a name, a comment
        if flags & bit:
            end = data.find(b"\0", place)
            if end < 0:
                return None
            place = end + 1
    place += 2 * bool(flags & 2)
    return place if place <= len(data) else None


def inflated(data: bytes, at: int, step: int, most: int) -> tuple[list[bytes], int, bool, str | None]:
    """What the compressed bytes from `at` on give, in parts; where they end; whether an end was seen; what is wrong."""
    z, out = zlib.decompressobj(-15), []
    try:
        while not z.eof:
            part = data[at : at + step]
            if not part:
                return out, at, False, "the member is cut off"
            at += len(part)
            out.append(z.decompress(part))
            step = min(step * 2, most)
    except zlib.error as e:
        return out, at - len(part), False, f"gzip: {e}"
    return out, at - len(z.unused_data), True, None


def unzipped(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the member at `at` gives, from where to go on, and what is wrong with it. All that comes before a fault is given; the trailer is checked apart, so a wrong one costs nothing."""
    start = deflate_start(data, at)
    if start is None:
        return b"", at + 1, "gzip: no header"
    out, end, whole, wrong = inflated(data, start, 1 << 16, 1 << 22)
    if not whole:
        if wrong.startswith("gzip"):  # a call that fails gives nothing: again, byte by byte at the fault
            near, place, _, _ = inflated(data, start, 1 << 10, 1 << 10)
            z = zlib.decompressobj(-15)
            out = [z.decompress(data[start:place])]
            try:
                for k in range(place, min(len(data), place + (1 << 10))):
                    out.append(z.decompress(data[k : k + 1]))
            except zlib.error:
                pass
        return b"".join(out), at + 1, wrong
    plain, trailer = b"".join(out), data[end : end + 8]
    if len(trailer) < 8:
        return plain, end, "the member is cut off"
    if trailer != (zlib.crc32(plain).to_bytes(4, "little") + (len(plain) & 0xFFFFFFFF).to_bytes(4, "little")):
        return plain, end, "gzip: the trailer differs"
    return plain, end + 8, None


@dataclass
class Salvage:
    """Records of a file's bytes; gaps fills as they are read. vouched: the bytes are a member's whose checksum was right; inner: they are a member's, so no member begins in them."""

    data: bytes
    gaps: list[Gap] = field(default_factory=list)
    vouched: bool = False
    inner: bool = False

    def next_begin(self, at: int) -> int:
        """The next place from `at` on where a member or a version line begins, or the end."""
        found = (_VERSION if self.inner else _BEGIN).search(self.data, at)
        return found.start() if found else len(self.data)

    def _at(self, at: int) -> tuple[list[Record], list[Gap], int]:
        """Records and inner gaps of the member or the plain record at `at`, and where to go on."""
        if self.inner or self.data[at : at + 2] != b"\x1f\x8b":
            record, end = parse(self.data, at, self.vouched)
            return [record], [], end
        plain, end, wrong = unzipped(self.data, at)
        inner = Salvage(plain, vouched=wrong is None, inner=True)
        records = [r for r in inner if wrong is None or r.verified]  # digests vouch where the checksum does not
        if not records:
            raise Damaged(wrong or inner.gaps[0].reason if wrong or inner.gaps else "the member is empty")
        for r in records:
            r.offset = at
        if wrong is None:
            return records, [Gap(at, g.length, f"inside a member: {g.reason}") for g in inner.gaps], end
        end = self.next_begin(end)
        return records, [Gap(at, end - at, wrong)], end

    def __iter__(self) -> Iterator[Record]:
        at, n = 0, len(self.data)
        while at < n:
            start, reason = at, None
            while at < n:
                try:
                    records, gaps, end = self._at(at)
                    break
                except Damaged as e:
                    reason = reason or str(e)
                at = self.next_begin(at + 1)
            if at > start:
                self.gaps.append(Gap(start, at - start, reason))
            if at < n:
                yield from records
                self.gaps += gaps
                at = end


# -- tables ---------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page, url, payload, digest, n_payload, refers_to, revisit of each row.

    Of equal payloads of at least min_bytes, the rows with the largest id respond
    and the others revisit it; rows with a null id revisit any id there is, and all
    respond if there is none. Rows that repeat the largest id all respond. A null html
    is an empty payload, one of any length is taken whole; other columns are left behind.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("n_payload"))
    first = p.where(F.col("n_payload") >= min_bytes).groupBy("digest").agg(F.max("page").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("largest").isNotNull() & ~common.same(F.col("page"), F.col("largest"))
    return p.join(first, "digest", "left").select("page", "url", "payload", "digest", "n_payload", F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, compressed: bool = True, roll: int = ROLL_BYTES) -> DataFrame:
    """Write the rows of with_revisits() as WARC files; return the manifest (file, n_records, n_bytes), written once.

    A file is closed when it has `roll` bytes; a task without rows writes none, so an
    empty table has no files and an empty manifest. Other columns are left behind. A row
    of 2 GB or more is none that Spark can hold, so no record has it.
    """
    schema = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def rows(batches):
        from pyspark import TaskContext

        out, n, part = None, 0, TaskContext.get().partitionId()
        for b in batches:
            for page, url, payload, digest, size, refers, revisit in zip(*(common.column(b, c).to_pylist() for c in ("page", "url", "payload", "digest", "n_payload", "refers_to", "revisit")), strict=True):
                if out is None:
                    out, n = files.FileOut(folder, f"pages-{part:06d}", ".warc.gz" if compressed else ".warc"), 0
                record = record_bytes(page, url, payload, digest, size, refers, revisit)
                out.write(member(record) if compressed else record)
                n += 1
                if out.size >= roll:
                    out.close()
                    yield [out.name, n, out.size]
                    out = None
        if out is not None:
            out.close()
            yield [out.name, n, out.size]

    common.tuned(pages.sparkSession)
    return common.written(pages.mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema)), "file string, n_records long, n_bytes long"), "manifest")


def read_archives(contents: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of files given as rows (name, content), as spark.read.format("binaryFile") makes them.

    file, byte_offset, kind ("record" or "gap"), n_bytes and reason (gaps),
    record_type, page_id, url, payload_bytes, payload_digest (hex), refers_to and
    payload (null for revisits). With a column n_records in contents, a file that
    gives fewer records is an error. Other columns are left behind. A file is held
    whole, and so is what one of its members unzips to; a file of 2 GB or more, which Spark
    does not read as one row, is an error. Of a member whose checksum or bytes are wrong the
    records before the fault, and those after it that can be read, stay if their own block
    digest is right.
    """
    cols = [("file", pa.string(), "string"), ("byte_offset", pa.int64(), "long"), ("kind", pa.string(), "string"), ("n_bytes", pa.int64(), "long"), ("reason", pa.string(), "string"), ("record_type", pa.string(), "string"), ("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"), ("refers_to", pa.int64(), "long")]
    cols += [("payload", pa.binary(), "binary")] * with_payload
    schema = pa.schema([(n, t) for n, t, _ in cols])

    def rows(batches):
        for b in batches:
            for name, content, least in zip(*(common.column(b, c).to_pylist() for c in ("name", "content", "n_records")), strict=True):
                reader, n = Salvage(content), 0
                for n, r in enumerate(reader, 1):
                    full = r.payload if r.type == "response" else None
                    if full is not None:
                        size, digest = len(full), hashlib.sha1(full).hexdigest()
                    else:
                        size = r.number("X-Payload-Length")
                        digest = (hex_digest(r.headers.get("WARC-Payload-Digest")) or (None, None))[1]
                    yield [name, r.offset, "record", None, None, r.type, r.number("X-Page-Id"), r.headers.get("WARC-Target-URI"), size, digest, r.number("X-Refers-To-Page-Id"), *[full] * with_payload]
                if least is not None and n < least:
                    raise ValueError(f"{name}: {n} records of {least} were read; gaps: {reader.gaps[:3]}")
                for g in reader.gaps:
                    yield [name, g.offset, "gap", g.length, g.reason, *[None] * (len(cols) - 5)]

    common.tuned(contents.sparkSession)
    least = F.col("n_records").cast("long") if "n_records" in contents.columns else F.lit(None).cast("long")
    return contents.select("name", "content", least.alias("n_records")).mapInArrow(common.freeing(lambda it: files.batches_of(rows(it), schema, 256)), ", ".join(f"{n} {k}" for n, _, k in cols))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = files.new_folder(spark, "warc")
    manifest = write_archives(with_revisits(common.table(spark, sf_dir, "pages")), folder)
    contents = files.read_files(spark, manifest, folder).join(manifest.select(F.col("file").alias("name"), "n_records"), "name")
    back = read_archives(contents, with_payload=False)
    return back.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

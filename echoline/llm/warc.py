"""Web archives packed in ZIP files: writer, ZIP and ZIP64 directory parser, range reader, Spark operators.

An archive holds ``archive/data.warc.gz`` (one gzip member per record), ``indexes/index.cdxj`` (one line per record
with the record's offset and length) and ``datapackage.json``, all *stored*, so a record is one range of the file.

Defined results: null html is an empty payload; null ids get no winner over a non-null id and are referred to as null;
of repeated rows of the winning id exactly one is the response; payloads of any length up to Arrow's 2 GiB a cell are
taken whole; an empty table gives no archive; other columns are ignored, whatever their names.

Packages of other writers are read too: WARC members and indexes are found in the directory, an index may be gzipped, there
may be several of both, a WARC member without an index is walked from its start, and members that are compressed in the
package are unpacked once.  A package, member or record that cannot be read gives a row with null fields and the reason in
``status``; the others are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, mark_again, materialize, repeated_rows, unused

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Bytes of record data after which a new archive is begun.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD_PREFIX = "urn:page:"

# Fixed values of the ZIP format: signatures and record sizes.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


# --- ZIP -----------------------------------------------------------------------------------------------------------


def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file with stored members; ``zip64`` writes the 64-bit fields even where 32 bits would do."""
    out, entries = bytearray(), []
    for name, data in members:
        raw, at, crc, n = name.encode(), len(out), zlib.crc32(data), len(data)
        wide = zip64 or n >= FULL32 or at >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        short = FULL32 if wide else n
        out += struct.pack("<IHHHHHIIIHH", LOCAL, 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra))
        out += raw + extra + data
        more = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        entries.append(
            struct.pack(
                "<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short,
                len(raw), len(more), 0, 0, 0, 0, FULL32 if wide else at,
            ) + raw + more
        )
    start, central = len(out), b"".join(entries)
    out += central
    wide = zip64 or len(members) >= FULL16 or start >= FULL32 or len(central) >= FULL32
    if wide:
        at = len(out)
        out += struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, len(members), len(members), len(central), start)
        out += struct.pack("<IIQI", LOCATOR64, 0, at, 1)
    short = (FULL16, FULL32, FULL32) if wide else (len(members), len(central), start)
    out += struct.pack("<IHHHHIIH", END, 0, 0, short[0], *short, 0)
    return bytes(out)


class ZipDirectory:
    """The central directory of a ZIP file that is only reachable through ``read_at(offset, length)``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size = read_at, size
        tail_at = max(0, size - 22 - 65535)
        tail = bytes(read_at(tail_at, size - tail_at))
        at = tail.rfind(struct.pack("<I", END))
        if at < 0 or len(tail) - at < 22:
            raise ValueError("no end of central directory")
        _, _, _, _, count, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
        if FULL16 == count or FULL32 in (length, start):
            locator = bytes(read_at(tail_at + at - 20, 20))
            signature, _, at64, _ = struct.unpack("<IIQI", locator)
            if signature != LOCATOR64:
                raise ValueError("ZIP64 locator missing")
            end = struct.unpack("<IQHHIIQQQQ", bytes(read_at(at64, 56)))
            if end[0] != END64:
                raise ValueError("ZIP64 end of central directory missing")
            count, length, start = end[7], end[8], end[9]
        self.members: dict[str, tuple[int, int, int, int]] = {}
        self._parse(bytes(read_at(start, length)), count)

    def _parse(self, central: bytes, count: int) -> None:
        at = 0
        for _ in range(count):
            head = struct.unpack_from("<IHHHHHHIIIHHHHHII", central, at)
            if head[0] != CENTRAL:
                raise ValueError("central directory damaged")
            method, packed, plain, offset = head[4], head[8], head[9], head[16]
            name_at = at + 46
            extra_at = name_at + head[10]
            name = central[name_at:extra_at].decode()
            end = extra_at + head[11]
            while extra_at + 4 <= end:
                kind, n = struct.unpack_from("<HH", central, extra_at)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", central, extra_at + 4))
                    plain = next(wide) if plain == FULL32 else plain
                    packed = next(wide) if packed == FULL32 else packed
                    offset = next(wide) if offset == FULL32 else offset
                extra_at += 4 + n
            self.members[name] = (method, packed, plain, offset)
            at = end + head[12]

    def stored_range(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data."""
        method, packed, _, offset = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; its records cannot be read by range")
        return self._data_at(offset), packed

    def _data_at(self, offset: int) -> int:
        head = struct.unpack("<IHHHHHIIIHH", bytes(self.read_at(offset, 30)))
        if head[0] != LOCAL:
            raise ValueError("local header damaged")
        return offset + 30 + head[9] + head[10]

    def reader(self, name: str) -> tuple[Callable[[int, int], bytes], int]:
        """(read_at, length) of a member's plain bytes: ranges of the file where it is stored, else of the unpacked bytes."""
        method, packed, plain, offset = self.members[name]
        at = self._data_at(offset)
        if method == 0:
            return lambda start, n: self.read_at(at + start, max(0, min(n, packed - start))), packed
        if method != 8:
            raise ValueError(f"{name} is compressed by method {method}")
        whole = zlib.decompressobj(-15).decompress(bytes(self.read_at(at, packed)), plain + 1)
        if len(whole) != plain:
            raise ValueError(f"{name} is damaged")
        return lambda start, n: whole[start : start + n], plain


# --- WARC ----------------------------------------------------------------------------------------------------------


def sha1_base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, response: bool, winner, length: int) -> bytes:
    """One WARC record; a revisit carries the HTTP head, which tells the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if response else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_PREFIX}{page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not response:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{RECORD_PREFIX}{winner}>",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int | None]:
    """Headers (lower-case names), HTTP payload, and the payload length that the HTTP head declares."""
    at = raw.index(b"\r\n\r\n")
    lines = raw[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = raw[at + 4 : at + 4 + int(headers["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    declared = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    return headers, payload, declared


def gunzip_member(data: bytes) -> bytes:
    return zlib.decompressobj(31).decompress(data)


class ArchiveBuilder:
    def __init__(self):
        self.data, self.lines = bytearray(), []

    def add(self, page_id, url, payload, digest, response, winner, length) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(record(page_id, url, payload, digest, response, winner, length)) + packer.flush()
        entry = {"url": url, "digest": f"sha1:{digest}", "offset": len(self.data), "length": len(packed), "filename": "data.warc.gz"}
        self.lines.append(f"{RECORD_PREFIX}{page_id} {json.dumps(entry)}")
        self.data += packed

    def close(self, zip64: bool) -> bytes:
        index = "\n".join(self.lines).encode() + b"\n"
        package = {"profile": "data-package", "resources": [
            {"path": n, "bytes": len(d), "hash": "sha256:" + hashlib.sha256(d).hexdigest()} for n, d in ((DATA, self.data), (INDEX, index))
        ]}
        return write_zip([(DATA, bytes(self.data)), (INDEX, index), (PACKAGE, json.dumps(package).encode())], zip64)


#: What damaged bytes raise while they are parsed.
DAMAGE = (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error)
Read = tuple[dict[str, str], bytes, int | None]


def why(error: Exception) -> str:
    return str(error) if type(error) is ValueError else f"damaged ({type(error).__name__}: {error})"


def walk_records(read_at: Callable[[int, int], bytes], length: int) -> Iterator[Read | str]:
    """The records of a WARC file from its start, each gzipped by itself or all plain."""
    data, at = bytes(read_at(0, length)), 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            raw = unpack.decompress(data[at:])
            if not unpack.eof:
                raise ValueError("a record is cut off")
            at = len(data) - len(unpack.unused_data)
        else:
            head_end = data.index(b"\r\n\r\n", at)
            n = next((int(x.split(b":")[1]) for x in data[at:head_end].split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            if n is None:
                raise ValueError("a record has no length")
            raw, at = data[at : head_end + 4 + n], head_end + 4 + n
            while data[at : at + 2] == b"\r\n":
                at += 2
        yield parse_record(raw)


def read_records(read_at: Callable[[int, int], bytes], size: int) -> Iterator[Read | str]:
    """Every record of a package: by one range read each where an index lists it; a text says what could not be read."""
    zipped = ZipDirectory(read_at, size)
    files = {n: n.rpartition("/")[2] for n in zipped.members if n.endswith((".warc", ".warc.gz"))}
    by_name = files | {base: base for base in files.values()}
    readers: dict[str, Callable[[int, int], bytes]] = {}
    listed = set()
    for index in sorted(n for n in zipped.members if n.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))):
        try:
            part, length = zipped.reader(index)
            raw = bytes(part(0, length))
            lines = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode().splitlines()
        except (*DAMAGE, OSError, EOFError) as error:
            yield f"{index}: {why(error)}"
            continue
        for line in lines:
            try:
                if " {" not in line:
                    continue  # a heading, or an index of other fields: its files are walked
                entry = json.loads(line[line.index(" {") + 1 :])
                base = str(entry["filename"]).rpartition("/")[2]
                if base not in by_name:
                    raise ValueError(f"the package has no {base}")
                if base not in readers:
                    readers[base] = zipped.reader(next(n for n, b in files.items() if b == base))[0]
                listed.add(base)
                raw = bytes(readers[base](int(entry["offset"]), int(entry["length"])))
                yield parse_record(gunzip_member(raw) if raw[:2] == b"\x1f\x8b" else raw)
            except DAMAGE as error:
                yield f"{index}: {why(error)}"
    for name, base in sorted(files.items()):
        if base not in listed:
            try:
                yield from walk_records(*zipped.reader(name))
            except DAMAGE as error:
                yield f"{name}: {why(error)}"


# --- Spark ---------------------------------------------------------------------------------------------------------


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add payload (binary), payload_bytes, sha1, winner and is_response to pages (page_id, url, html).

    Only digests and ids are grouped, and only those of payloads that occur twice are joined back, so payloads stay
    where they are read as long as these are few enough for a broadcast; a common payload's group is never gathered.
    """
    scratch, (again,) = Scratch(pages.sparkSession), unused(pages, "again")
    whole = pages.withColumn("html", F.coalesce("html", F.lit("")))
    whole = mark_again(whole, repeated_rows(whole, "page_id", "html", scratch), again, "page_id", "html", scratch)
    base = whole.select("page_id", "url", F.col(again).alias("again"), F.encode("html", "UTF-8").alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1")
    )
    slim = base.select("page_id", F.unhex("sha1").alias("digest"))
    best = slim.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    best = scratch.keep(best.withColumn("several", F.lit(True)))
    small, several = F.col("payload_bytes") < min_bytes, F.coalesce("several", F.lit(False))
    own = F.col("page_id").eqNullSafe(F.col("winner")) & ~F.col("again")
    return base.join(bounded(best), F.unhex("sha1") == F.col("digest"), "left").select(
        "page_id", "url", "payload", "payload_bytes", "sha1",
        F.when(several, F.col("winner")).otherwise(F.col("page_id")).alias("winner"), (small | ~several | own).alias("is_response"),
    )


def write_archives(pages: DataFrame, *, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = True) -> DataFrame:
    """Archives (archive binary) of about ``archive_bytes`` of record data each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = ArchiveBuilder()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, length, sha1, winner, response = row
                builder.add(page_id, url, payload or b"", sha1_base32(sha1), response, winner, length)
                if len(builder.data) >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([builder.close(zip64)], pa.binary())], ["archive"])
                    builder = ArchiveBuilder()
        if builder.lines:
            yield pa.RecordBatch.from_arrays([pa.array([builder.close(zip64)], pa.binary())], ["archive"])

    chosen = decide(pages, min_bytes).select(
        "page_id", "url", F.when(F.col("is_response"), F.col("payload")).alias("payload"),
        "payload_bytes", "sha1", "winner", "is_response",
    )
    return chosen.mapInArrow(build, "archive binary")


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """Rows (record_id, url, record_type, refers_to_id, payload_digest, payload_bytes, payload, status) of ZIP archives.

    ``archives`` may be what ``write_archives`` gives or a ``binaryFile`` scan (``column='content'``).
    A response's digest is computed from the payload as read; where its header has another, ``status`` says so.
    """

    def fields(item: Read | str) -> tuple:
        if isinstance(item, str):
            return (None,) * 7 + (item,)
        headers, payload, declared = item
        kind, given = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        response = kind == "response"
        digest = sha1_base32(hashlib.sha1(payload).hexdigest()) if response else given
        status = "payload differs from its digest" if response and given is not None and len(given) == 32 and given != digest else "read"
        refers = headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None
        return (
            headers.get("warc-record-id", "").strip("<>") or None, headers.get("warc-target-uri"), kind, refers, digest,
            len(payload) if response else declared, payload if response else None, status,
        )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "url", "record_type", "refers_to_id", "payload_digest", "payload_bytes", "payload", "status"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for item in batch.column(0):
                rows: list[tuple] = []
                buffer = item.as_buffer()
                view = memoryview(buffer) if buffer is not None else memoryview(b"")
                found = read_records(lambda at, n, v=view: v[max(at, 0) : max(at, 0) + max(n, 0)], len(view))
                while True:
                    try:
                        rows.append(fields(next(found)))
                    except StopIteration:
                        break
                    except DAMAGE as error:  # the package's directory
                        rows.append(fields("no file" if buffer is None else why(error)))
                        break
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select(column).mapInArrow(
        parse,
        "record_id string, url string, record_type string, refers_to_id string, payload_digest string, payload_bytes long, payload binary, status string",
    )


def page_number(record_id) -> F.Column:
    """The id in a record's name, null for 'None'."""
    return F.expr(f"try_cast(substring({record_id}, {len(RECORD_PREFIX) + 1}) AS bigint)")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archives as a table in the shared folder, then read them back."""
    return read_archives(materialize(write_archives(pages, **options)))

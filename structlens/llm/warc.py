"""WARC records in ZIP packages: a writer with stored members, and a reader that range-reads single records.

A package holds two stored members: archive/data.warc.gz, in which every record is a gzip member of its own, and
indexes/index.cdxj, a line for each record with its offset and length in the archive. The reader parses the end
record, its ZIP64 form and the central directory, reads the index, and then only the ranges that the index names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Stored, new_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Shorter payloads are always written in full.
LEAST_REVISIT = 100
#: Bytes of compressed records after which a package is closed, and most bytes of one range read.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 8 << 20
DATE = "1970-01-01T00:00:00Z"
U16, U32 = 0xFFFF, 0xFFFFFFFF


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of stored members; with ZIP64 fields where sizes ask for it or zip64 is set."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, n, at = name.encode(), zlib.crc32(data), len(data), len(out)
        wide = zip64 or n >= U32 or at >= U32
        size = U32 if wide else n
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra))
        out += raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central += struct.pack(
            "<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0,
            U32 if wide else at,
        )
        central += raw + extra
    start, n = len(out), len(members)
    out += central
    if zip64 or start >= U32 or n >= U16:
        at = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(central), start)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, at, 1)
        return bytes(out + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, U16, U16, U32, U32, 0))
    return bytes(out + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, len(central), start, 0))


class ZipPackage:
    """Stored members of a ZIP archive behind any object with size() and read_at(n, offset)."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail_at = max(0, size - (22 + U16))
        tail = source.read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end record: not a ZIP archive")
        _, _, _, _, n, length, start, _ = struct.unpack_from("<4sHHHHIIH", tail, end)
        if n == U16 or length == U32 or start == U32:
            sig, _, at, _ = struct.unpack("<4sIQI", source.read_at(20, tail_at + end - 20))
            if sig != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            sig, *_, n, length, start = struct.unpack("<4sQHHIIQQQQ", source.read_at(56, at))
            if sig != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
        self.members = dict(self._central(source.read_at(length, start), n))

    @staticmethod
    def _central(data: bytes, n: int) -> Iterator[tuple[str, tuple[int, int]]]:
        at = 0
        for _ in range(n):
            sig, _, _, _, how, _, _, _, packed, size, ln, lx, lc, _, _, _, where = struct.unpack_from(
                "<4sHHHHHHIIIHHHHHII", data, at
            )
            if sig != b"PK\1\2":
                raise ValueError("broken central directory")
            name = data[at + 46 : at + 46 + ln].decode()
            extra, x = data[at + 46 + ln : at + 46 + ln + lx], 0
            while x + 4 <= len(extra):
                kind, m = struct.unpack_from("<HH", extra, x)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, x + 4))
                    size = next(wide) if size == U32 else size
                    packed = next(wide) if packed == U32 else packed
                    where = next(wide) if where == U32 else where
                x += 4 + m
            if how == 0:
                yield name, (where, size)
            at += 46 + ln + lx + lc

    def start(self, name: str) -> int:
        """Where the bytes of a member begin: its local header has lengths of its own."""
        where, _ = self.members[name]
        sig, ln, lx = struct.unpack("<4s22xHH", self.source.read_at(30, where))
        if sig != b"PK\3\4":
            raise ValueError(f"broken local header of {name}")
        return where + 30 + ln + lx

    def read(self, name: str) -> bytes:
        return self.source.read_at(self.members[name][1], self.start(name))

    def ranges(self, name: str, wanted: list[tuple[int, int]]) -> Iterator[bytes]:
        """The bytes of (offset, length) ranges of a member, neighbours read together up to RANGE_BYTES."""
        start, i = self.start(name), 0
        while i < len(wanted):
            j, end = i + 1, wanted[i][0] + wanted[i][1]
            while j < len(wanted) and wanted[j][0] == end and end + wanted[j][1] - wanted[i][0] <= RANGE_BYTES:
                end += wanted[j][1]
                j += 1
            data = self.source.read_at(end - wanted[i][0], start + wanted[i][0])
            for at, n in wanted[i:j]:
                yield data[at - wanted[i][0] : at - wanted[i][0] + n]
            i = j


class _File:
    """An Arrow file as ZipPackage reads it."""

    def __init__(self, f):
        self.f = f

    def size(self) -> int:
        return self.f.size()

    def read_at(self, n: int, at: int) -> bytes:
        return self.f.read_at(n, at)


class Bytes:
    """The same of bytes in memory."""

    def __init__(self, data: bytes):
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member; a revisit has no block."""
    name = "" if page_id is None else page_id
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or f"urn:page:{name}")
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, lower-cased, and block of one record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def write(pages: DataFrame, folder: str, zip64: bool = False, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages of (page_id, url, payload, digest, refers_to, revisit) rows below folder; (package, records).

    A package has a name of its own in every attempt of a task; those of lost attempts are in no returned row.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        archive, index = bytearray(), []

        def close():
            name = f"{base}/package-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(name, compression=None) as f:
                f.write(zip_bytes([(ARCHIVE, bytes(archive)), (INDEX, "\n".join(index).encode())], zip64))
            done = pa.RecordBatch.from_pydict({"package": [name], "records": pa.array([len(index)], pa.int64())})
            archive.clear()
            index.clear()
            return done

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to", "revisit")]
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in columns]
                data = record(*row)
                about = {"offset": len(archive), "length": len(data), "digest": row[3], "filename": "data.warc.gz"}
                index.append(f"page:{'' if row[0] is None else row[0]} 19700101000000 {json.dumps(about)}")
                archive.extend(data)
                if len(archive) >= package_bytes:
                    yield close()
        if index:
            yield close()

    return pages.mapInArrow(run, "package string, records long")


def read(packages: DataFrame, folder: str) -> DataFrame:
    """The records of packages: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    Payloads of responses are held against their digest; those of revisits are null.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        number = lambda s: int(s[len("<urn:page:") : -1]) if s and s != "<urn:page:>" else None
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        for batch in batches:
            for name in batch.column("package").to_pylist():
                with store.open_input_file(name) as f:
                    package = ZipPackage(_File(f))
                    about = [json.loads(x.split(" ", 2)[2]) for x in package.read(INDEX).decode().split("\n")]
                    for raw in package.ranges(ARCHIVE, [(x["offset"], x["length"]) for x in about]):
                        h, block = parse(raw)
                        digest, response = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"] == "response"
                        if response and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"{name}: payload and digest of {h['warc-record-id']} differ")
                        rows.append((number(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], number(h.get("warc-refers-to")), int(h["x-payload-length"]), digest, block if response else None))
                        held += len(block)
                        if len(rows) >= 2000 or held > RANGE_BYTES:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    kinds = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return packages.mapInArrow(run, kinds)


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT, salts: int = 8) -> DataFrame:
    """Writes a record for each (page_id, url, html) row and reads the packages back.

    Of rows with equal payloads of `least` bytes or more, those with the smallest page_id are responses and the others
    revisit it. Null html is an empty payload. A row without page_id is never referred to: it revisits the smallest id
    of its group, and is a response in a group without ids. Repeated rows each get a record; an empty table gives none.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    groups = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select(F.col("digest").alias("__digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__at"))
    )
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)))
    known = salted.join(groups, (F.col("digest") == F.col("__digest")) & (F.col("__salt") == F.col("__at")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = known.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    packages = Stored(write(ready, folder), "packages").df
    return read(packages.repartition(max(1, min(packages.count(), 10_000))), folder)

"""WARC archives as seekable Zstandard bundles.

A task writes its records into bundles. Records are grouped into frames that are compressed each for itself; a skippable
frame with the record index follows, and a footer in the Zstandard seekable format: the compressed and plain size of each
frame. The index maps a record's number to (frame, offset within the plain frame, length), so one record costs one read of
the footer, one of the index and one of a single frame. Ordinary tools read the whole as a .warc.zst file.

Bundles are written through pyarrow's file systems into the shared folder, under names that no other attempt has. The names
of the bundles of committed tasks form the manifest, a table; files of lost attempts stand in no manifest and are never
read. Reading goes over the manifest, a bundle at a time and a frame at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import ROW, hot_keys, keyed, unique_join
from barspark.session import scratch_path, stored

REVISIT_BYTES = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25
LEVEL = 3
MOST_READERS = 8192
#: Beyond so many revisits (16 bytes each) they are joined by a shuffle of the pages.
BROADCAST_ROWS = 1_000_000
# fixed values of the formats
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A5C, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ENTRY = struct.Struct("<qIII")


def _url(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", s)


def record(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record. A revisit has the HTTP head, with the length of the full payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page-row:{row}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_url(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:x-page:{refers_to}>")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields of the record and, with the prefix http-, of its HTTP head; payload)."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {f"http-{k}": v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}, payload


def _skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


@dataclass
class Bundle:
    """A bundle being written."""

    out: object
    path: str
    frame_bytes: int
    frame: bytearray = field(default_factory=bytearray)
    sizes: list[tuple[int, int]] = field(default_factory=list)
    index: bytearray = field(default_factory=bytearray)
    written: int = 0

    def add(self, row: int, raw: bytes) -> None:
        if self.frame and len(self.frame) + len(raw) > self.frame_bytes:
            self.flush()
        self.index += ENTRY.pack(row, len(self.sizes), len(self.frame), len(raw))
        self.frame += raw

    def flush(self) -> None:
        if self.frame:
            self._put(zstandard.ZstdCompressor(level=LEVEL).compress(bytes(self.frame)), len(self.frame))
            self.frame.clear()

    def _put(self, data: bytes, plain: int) -> None:
        self.out.write(data)
        self.sizes.append((len(data), plain))
        self.written += len(data)

    def close(self) -> tuple[str, int, int]:
        self.flush()
        self._put(_skippable(INDEX_MAGIC, bytes(self.index)), 0)
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER_MAGIC)
        self.out.write(_skippable(SEEK_MAGIC, table))
        self.out.close()
        return self.path, len(self.index) // ENTRY.size, self.written + len(table) + 8


class Reader:
    """Random access to a bundle: ``index`` has (row, frame, offset, length) of each record."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(name)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != FOOTER_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * count, end - 9 - 8 * count)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.index = list(ENTRY.iter_unpack(self.file.read_at(self.sizes[-1][0] - 8, self.starts[-2] + 8)))

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(self.sizes[k][0], self.starts[k]), max_output_size=self.sizes[k][1])

    def fetch(self, row: int) -> bytes:
        """The record with this number; only its frame is read."""
        for r, k, at, n in self.index:
            if r == row:
                return self.frame(k)[at:at + n]
        raise KeyError(row)

    def records(self) -> Iterator[bytes]:
        last, plain = -1, b""
        for _, k, at, n in self.index:
            if k != last:
                last, plain = k, self.frame(k)
            yield plain[at:at + n]


def revisits(rows: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(``__row``, refers_to) of the rows whose payload a later one has, of at least ``least`` bytes."""
    seen = stored(rows.select(ROW, "page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes")).where(F.col("bytes") >= least))
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("z"), F.col("page_id").alias("id"), F.col(ROW).alias("r")))
    groups = stored(seen.groupBy("digest", "bytes").agg(first.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    both = unique_join(seen, groups, ["digest", "bytes"], hot_keys(groups, ["digest", "bytes"], F.col("n")))
    return stored(both.where(F.col(ROW) != F.col("best.r")).select(ROW, F.col("best.id").alias("refers_to"), F.lit(True).alias("revisit")))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", row: str | None = None,
          frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record for each row and returns the manifest: bundle, records, bytes.

    Of rows with equal payloads of at least 1000 bytes the one with the largest page_id (of repeated rows the last) is a
    response, the others revisit it. A null html is an empty payload, a null url or page_id an absent field. No rows give
    no bundles. Other columns are not read.
    """
    rows = keyed(pages, page_id, row).select(
        ROW, F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    again = revisits(rows)
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = rows.join(again, ROW, "left").select(ROW, "page_id", "url", "payload", F.sha1("payload").alias("digest"), "refers_to", "revisit")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        bundle, done = None, []
        for batch in batches:
            columns = batch.to_pydict()
            for values in zip(*columns.values()):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(where.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", frame_bytes)
                k, pid, link, payload, digest, to, dup = values
                bundle.add(k, record(k, pid, link, payload, digest, to, bool(dup)))
                if bundle.written >= bundle_bytes:
                    done.append(bundle.close())
                    bundle = None
        if bundle is not None:
            done.append(bundle.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["bundle", "records", "bytes"])

    return stored(rows.mapInArrow(bundles, "bundle string, records long, bytes long"))


def read(manifest: DataFrame) -> DataFrame:
    """What the archives say of each record: page_id, url, payload (null for a revisit), payload_bytes, payload_digest
    (hex, taken anew from a response's payload), record_type, refers_to."""
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, size = [], 0
                for raw in Reader(path).records():
                    f, payload = parse(raw)
                    dup = f["WARC-Type"] == "revisit"
                    digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex() if dup else hashlib.sha1(payload).hexdigest()
                    to = f.get("WARC-Refers-To")
                    out.append((int(f["WARC-Page-ID"]) if "WARC-Page-ID" in f else None, f.get("WARC-Target-URI"), None if dup else payload,
                                int(f["http-Content-Length"]) if dup else len(payload), digest, f["WARC-Type"], int(to[len("<urn:x-page:"):-1]) if to else None))
                    size += len(payload)
                    if size > FRAME_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kind)], schema=kind)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kind)], schema=kind)

    n = max(1, min(MOST_READERS, manifest.count()))
    return manifest.select("bundle").repartition(n).mapInArrow(
        rows, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Writes the pages to a fresh folder of archives in the shared place and reads them back."""
    return read(write(pages, scratch_path(pages.sparkSession)))

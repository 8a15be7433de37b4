"""WARC records in seekable Zstandard bundles.

Each task groups its records into independent frames of about ``FRAME_BYTES``,
closes a bundle at ``BUNDLE_BYTES`` and appends the seek table in a skippable
frame, as the seekable format lays it out.  The index, written by Spark, maps each
record identifier to bundle, frame and the offset inside the frame.  A reader goes
through the seek table to the frame and decompresses that frame only.

Bundles get names of their own for every attempt of a task, and only the rows of
attempts that succeeded are in the index, so a task that runs again does no harm.

Defined cases: a null payload is empty, a null URL is left out of the record;
payloads of at least ``REVISIT_BYTES`` that are equal have one response, the one
with the largest id (rows that repeat that id are all responses; a null id never is
if there is another); a group whose ids are all null has responses only; control
characters of a URL are percent-encoded; an empty table makes no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

REVISIT_BYTES, FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1000, 256 << 10, 256 << 20, 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format and of the archive format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None, place: tuple = ()) -> str:
    """Of a page whose id no other row has; of others with the record's place, which no other record has."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(':'.join(map(str, ('page', page_id, *place))).encode()).digest())}>"


def safe(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def record(own: str, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, sure: bool) -> bytes:
    """sure: only one row has the id that is referred to, so its record has the id that follows from it."""
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {safe(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To: {record_id(refers_to)}"] if sure else []), f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and the payload after the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Bundle:
    """One bundle that is being written."""

    def __init__(self, folder: str):
        import zstandard

        files, path = opened(folder)
        files.create_dir(path)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.size, self.count, self.held = 0, 0, bytearray()

    def place(self) -> tuple[str, int]:
        """No two records have the same: the bundle, and how many records it has."""
        self.count += 1
        return self.name, self.count

    def add(self, raw: bytes) -> tuple[str, int, int, int]:
        """Where the record lies: bundle, frame, offset inside the frame, length."""
        if self.held and len(self.held) + len(raw) > FRAME_BYTES:
            self.flush()
        where = (self.name, len(self.frames), len(self.held), len(raw))
        self.held += raw
        return where

    def flush(self) -> None:
        if self.held:
            frame = self.pack.compress(bytes(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), len(self.held)))
            self.size += len(frame)
            self.held = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """One bundle that is being read; keeps the last frame."""

    def __init__(self, folder: str, name: str):
        files, path = opened(folder)
        self.file = files.open_input_file(f"{path}/{name}")
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = self.file.read_at(count * width, size - 9 - count * width)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, plain))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, offset: int, length: int) -> bytes:
        import zstandard

        if self.last[0] != frame:
            at, packed, plain = self.frames[frame]
            self.last = (frame, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain))
        return self.last[1][offset : offset + length]

    def close(self) -> None:
        self.file.close()


INDEX = "page_id long, record_id string, bundle string, frame long, offset long, length long"


def with_roles(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """``pages`` with ``_revisit``, ``_refers_to``, ``_again`` (other rows have the same id, or it's null) and ``_sure``
    (one row has the id that is referred to).  A hot payload is counted before the shuffle; the join that
    brings the roles back has plain exchanges on both sides, so that it can be split."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    keyed = pages.withColumn("_sha", F.when(F.octet_length(body) >= REVISIT_BYTES, F.sha2(body, 256)))
    first = keyed.where("_sha IS NOT NULL").groupBy("_sha").agg(F.max(page_id).alias("_first"), F.count("*").alias("_copies")).where("_copies > 1 AND _first IS NOT NULL")
    again = materialize(pages.where(F.col(page_id).isNotNull()).groupBy(F.col(page_id).alias("_id")).count().where("count > 1").select("_id"), "repeated-ids")
    first = first.join(again.select(F.col("_id").alias("_first"), F.lit(True).alias("_several")), "_first", "left")
    out = keyed.join(materialize(first.select("_sha", "_first", F.col("_several").isNull().alias("_sure")), "payloads"), "_sha", "left")
    out = out.join(again.withColumn("_again", F.lit(True)), F.col(page_id) == F.col("_id"), "left")
    revisit = F.col("_first").isNotNull() & (F.col(page_id).isNull() | (F.col(page_id) != F.col("_first")))
    out = out.withColumns({"_revisit": revisit, "_refers_to": F.when(revisit, F.col("_first")), "_again": F.coalesce("_again", F.col(page_id).isNull()), "_sure": F.coalesce("_sure", F.lit(False))})
    return out.drop("_sha", "_first", "_id")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages to bundles in ``folder``; gives the index."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for page, link, body, refers, revisit, again, sure in zip(*(batch.column(i) for i in range(7)), strict=True):
                bundle = bundle or Bundle(folder)
                raw = body.as_buffer() if body.is_valid else None
                place = bundle.place()
                own = record_id(page.as_py(), place if again.as_py() else ())
                rows.append((page.as_py(), own, *bundle.add(record(own, link.as_py(), raw.to_pybytes() if raw is not None else b"", refers.as_py(), revisit.as_py(), sure.as_py()))))
                if bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if bundle:
            bundle.close()

    roles = with_roles(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html")))
    return materialize(roles.select("page_id", "url", "html", "_refers_to", "_revisit", "_again", "_sure").mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Read each record of the index: identifiers, type, digest and length of the full payload (and the stored payload)."""
    names = ["page_id", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            rows = []
            for page, rid, bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    if reader:
                        reader.close()
                    reader, name = Reader(folder, bundle), bundle
                fields, body = parsed(reader.record(frame, offset, length))
                kind = fields["warc-type"]
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                size = int(fields["x-payload-length"])
                if fields["warc-record-id"] != rid or kind == "response" and (hashlib.sha1(body).digest(), len(body)) != (digest, size):
                    raise ValueError(f"{bundle}, frame {frame}: the record isn't the one that was written")
                refers = fields.get("x-refers-to-page")
                rows.append((page, rid, size, digest.hex(), kind, int(refers) if refers else None, *([body] if payloads else [])))
            columns = list(zip(*rows, strict=True)) or [()] * (6 + payloads)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if payloads else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names + ["payload"] * payloads)
        if reader:
            reader.close()

    kinds = "page_id long, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index.mapInArrow(run, kinds + ", payload binary" * payloads)


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")

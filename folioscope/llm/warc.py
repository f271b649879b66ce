"""WARC archives in seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each of the records of about ``FRAME`` bytes; a skippable frame with
the record index (record identifier, its frame, its offset in the frame's plain bytes, its length); and a skippable frame
with the seek table of the public seekable format (compressed and plain size of each data frame, footer with the count and
the magic number). Any zstd tool unpacks a bundle to a plain WARC file; a reader that knows a record's identifier unpacks
one frame only.

Of records with equal payloads of at least ``REVISIT`` bytes, the one with the largest page_id is a response, all others
are revisits that refer to it and carry no payload. Payloads are told apart by SHA-1 and length. The small rows of the
payloads' digests are grouped; the texts themselves move once, by a unique key, however many of them are equal.

Defined results: a null html is an empty payload; a null url leaves out the target URI; control characters of a url are
percent-encoded; a null page_id ranks below all others; of rows with one page_id and payload (ties) the one read last is
the response; a very long payload makes a frame of its own, held by one task in whole; without pages there is no bundle and
no row. Columns other than page_id, url and html, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.binsink import read_files, write_files
from folioscope.llm.store import place, removed, table

FRAME, BUNDLE, REVISIT, LEVEL = 1 << 18, 8 << 20, 1000, 3
INDEX_MAGIC, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E
FOOTER = struct.pack("<I", 0x8F92EAB1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id: int | None, rid: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{rid}"


def page_of(identifier: str) -> int | None:
    number = identifier.split(":")[2]
    return int(number) if number else None


def record(page_id, rid: int, url: str | None, payload: bytes, refers: str | None, digest: bytes, size: int) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{record_id(page_id, rid)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode())
    body = HTTP % size
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers}>", f"Payload-Length: {size}"]
    else:
        body += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


class Bundle:
    """A bundle in the making."""

    def __init__(self, frame: int = FRAME, level: int = LEVEL):
        self.frame, self.press = frame, zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.frames, self.sizes, self.index, self.open, self.held, self.bytes = [], [], [], [], 0, 0

    def add(self, identifier: str, data: bytes) -> None:
        self.index.append((identifier, len(self.sizes), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)
        if self.held >= self.frame:
            self.flush()

    def flush(self) -> None:
        if self.open:
            packed = self.press.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.held))
            self.bytes += len(packed)
            self.open, self.held = [], 0

    def close(self) -> bytes:
        self.flush()
        index = zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IB", len(self.sizes), 0) + FOOTER
        return b"".join([*self.frames, struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", SEEK_MAGIC, len(table)), table])


def seek_table(data: bytes | memoryview) -> list[tuple[int, int, int]]:
    """(position, compressed size, plain size) of each data frame, from the end of the bundle."""
    if bytes(data[-4:]) != FOOTER:
        raise ValueError("no seek table")
    count, flags = struct.unpack("<IB", data[-9:-4])
    if flags:
        raise ValueError("unknown seek table")
    sizes, out, at = list(struct.iter_unpack("<II", data[len(data) - 9 - 8 * count : len(data) - 9])), [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def record_index(data: bytes | memoryview) -> list[list]:
    """[record identifier, frame, offset in the frame's plain bytes, length] of all records."""
    frames = seek_table(data)
    at = frames[-1][0] + frames[-1][1] if frames else 0
    magic, size = struct.unpack("<II", data[at : at + 8])
    if magic != INDEX_MAGIC:
        raise ValueError("no record index")
    return json.loads(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size]))


def fetch(data: bytes | memoryview, identifier: str) -> bytes:
    """One record, from its frame alone."""
    frames = seek_table(data)
    for name, k, offset, length in record_index(data):
        if name == identifier:
            at, packed, plain = frames[k]
            return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=plain)[offset : offset + length]
    raise KeyError(identifier)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return fields, block


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle = None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([bundle.close()], pa.binary())], ["bundle"])
    for batch in batches:
        for rid, page_id, url, payload, digest, refers in zip(*(c for c in batch.columns), strict=True):
            bundle = bundle or Bundle()
            data = payload.as_buffer().to_pybytes() if payload.is_valid else b""
            rid, page_id = rid.as_py(), page_id.as_py()
            bundle.add(record_id(page_id, rid), record(page_id, rid, url.as_py(), data, refers.as_py(), bytes.fromhex(digest.as_py()), len(data)))
            if bundle.bytes >= BUNDLE:
                yield out()
                bundle = None
    if bundle:
        yield out()


def write_archives(pages: DataFrame, path: str, revisit: int = REVISIT) -> None:
    """Bundles of a record for each row of pages (page_id, url, html) in the folder path."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    numbered = place(pages.sparkSession, "pages")  # the numbers must be the same wherever they are read
    rows.write.option("compression", "zstd").parquet(numbered)
    rows = pages.sparkSession.read.schema(rows.schema).parquet(numbered)
    small = rows.select("rid", "page_id", "digest", "size").where(F.col("size") >= revisit)
    key = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("order"), "rid", "page_id")
    firsts = small.groupBy("digest", "size").agg(F.max(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = small.join(firsts, ["digest", "size"]).where("rid != first.rid")
    again = again.select("rid", F.concat(F.lit("urn:page:"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.lit(":"), F.col("first.rid").cast("string")).alias("refers"))
    ready = rows.join(again, "rid", "left").select("rid", "page_id", "url", "payload", "digest", "refers")
    write_files(ready.mapInArrow(_bundled, "bundle binary"), "bundle", path, FOOTER)
    removed(pages.sparkSession, numbered)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "file", "frame", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            data, rows = memoryview(content.as_buffer()), []
            frames, plain, name = seek_table(data), None, path.as_py()
            at = -1
            for identifier, k, offset, length in record_index(data):
                if k != at:
                    p, packed, size = frames[k]
                    plain, at = unpack.decompress(data[p : p + packed], max_output_size=size), k
                fields, block = parse(plain[offset : offset + length])
                if fields["WARC-Record-ID"] != f"<{identifier}>":
                    raise ValueError("the record index is wrong")
                digest = base64.b32decode(fields["WARC-Payload-Digest"][5:])
                refers = fields.get("WARC-Refers-To")
                if refers:
                    size = int(fields["Payload-Length"])
                else:
                    payload = block.partition(b"\r\n\r\n")[2]
                    size = len(payload)
                    if hashlib.sha1(payload).digest() != digest:
                        raise ValueError("a payload differs from its digest")
                rows.append((page_of(identifier), size, digest.hex(), fields["WARC-Type"], page_of(refers[1:-1]) if refers else None, identifier, fields.get("WARC-Target-URI"), name, k, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the bundles, its payload read and checked against its digest."""
    return read_files(spark, path).mapInArrow(
        _read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, file string, frame long, offset long",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all pages, written and read back."""
    path = place(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC records in Zstandard archives: one frame per record, the dictionary in the leading skippable frame.

Writing: each page becomes a response record, or a revisit of the page with the largest id among those with an
equal payload. Archives are rows of (archive, content), as Spark's binaryFile source gives them, so that the
same reader serves stored tables and files. Reading: the dictionary is taken from the skippable frame that
an archive begins with, every further frame must be one whole record, and its headers, lengths and digests are
checked.

Defined results: null html is an empty payload. A null id sorts below all others and is read back as null; if
all equal payloads have null ids, all are responses. Rows that repeat the largest id of their payload are all responses.
Line breaks in a url become blanks, a null url an empty one. Other columns are ignored, an empty table gives
no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the format: the magic number of the dictionary's frame and that of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest", "WARC-Block-Digest")
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES, DICTIONARY_RECORDS = 16 << 10, 256
_CHUNK = 16 << 10


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ValueError(f"unknown record id {name!r}")
    return int(name[10:-1]) if name[10:-1] else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record; a revisit (refers_to is given) leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((url or "").splitlines())),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of these records. Its dictionary is trained on its own first records."""
    samples = records[:DICTIONARY_RECORDS]
    try:
        words = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few records to train on: their first bytes serve as they are
        words = b"".join(samples)[:DICTIONARY_BYTES]
    packed = zstandard.ZstdCompressor(level=19).compress(words)
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(press.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The content of each frame after the dictionary."""
    view = memoryview(archive)
    if len(view) < 8:
        raise ValueError("an archive begins with a skippable frame")
    magic, size = struct.unpack("<II", view[:8])
    if magic != SKIPPABLE or 8 + size > len(view):
        raise ValueError("an archive begins with a whole skippable frame that holds its dictionary")
    words = bytes(view[8 : 8 + size])
    if words[:4] == FRAME:
        words = zstandard.ZstdDecompressor().decompress(words)
    open_with = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    at = 8 + size
    while at < len(view):
        frame, out = open_with.decompressobj(), io.BytesIO()
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the last frame is cut off")
            chunk = view[at : at + _CHUNK]
            out.write(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
        yield out.getvalue()


def parse(data: bytes) -> dict:
    """One record with all checks; raises ValueError if it is not whole."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("no record header")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[key.decode()] = value.strip().decode("utf-8", "surrogatepass")
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"headers are missing: {missing}")
    kind, length = fields["WARC-Type"], int(fields["Content-Length"])
    if kind not in ("response", "revisit") or (kind == "revisit") != ("WARC-Refers-To" in fields):
        raise ValueError(f"bad record type {kind!r}")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {length} bytes is announced, {len(rest) - 4} are there")
    block = rest[:length]
    if fields["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
        raise ValueError("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not gap or len(sizes) != 1:
        raise ValueError("no HTTP header with one length")
    size, digest = int(sizes[0]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("the payload's length or digest differs")
    if kind == "revisit" and payload:
        raise ValueError("a revisit holds no payload")
    return {
        "page_id": _id(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _id(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): whole archives of the pages, of about archive_bytes of records each.

    Only payload digests that occur more than once are joined to the pages.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    repeated = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("newest"))
        .where("n > 1")
        .select("sha1", "newest")
    )
    refers = F.when(F.col("page_id").eqNullSafe(F.col("newest")), F.lit(None)).otherwise(F.col("newest"))
    placed = rows.join(repeated, "sha1", "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{part:06d}-{done:06d}.warc.zst"], "content": [pack(held)]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(*row, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    done, held, size = done + 1, [], 0
        if held:
            yield close()

    return placed.mapInArrow(archives, "archive string, content binary")


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of archives with a `content` column; a broken record ends the job with its reason."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = [parse(data) for data in unpack(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return archives.select("content").mapInArrow(records, schema + ", payload binary" * payloads)

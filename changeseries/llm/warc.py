"""Zstandard-compressed WARC archives: writing them and reading them back.

An archive is a series of Zstandard frames. The first is a skippable frame with the
dictionary of the archive, then comes one frame per record. An archive ends with the
record that brings it to ``archive_bytes``; a task writes as many as its rows need.
Spark's own text writer puts them down: an archive is a line and a file of its own, and
the line separator is an empty skippable frame, which readers pass over. So archives go
through Spark's commit protocol to any file system it can write to, and a lost
task leaves nothing behind. They are read with Spark's binary file source, one row each.

Records are ``response`` or, for a payload that a smaller id already has, ``revisit``
records, which refer to that response and hold no payload. Which is which is
found by an aggregation over payload hashes, stored before the rows are joined with what
it found about payloads of several rows: so that join can be split where one payload has
a large share of the pages.

The reader walks the frames by their headers, decodes one at a time, and checks: the
frame's magic number, that a frame holds one record, the version line, required headers, the declared
against the real length, the closing blank lines, and the payload's digest.

Results for odd rows: null html is an empty payload; null urls are left out of the
header. Rows without an id are responses only if no row with that payload has an id, else
revisits. Repeated rows with the smallest id of a payload are all responses. A very long
payload is written and read whole; an archive exceeds its bound by its last record. Very long urls are
kept whole. An empty table gives a folder without records. Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeseries.storage import checkpoint_folder

SKIPPABLE = 0x184D2A50
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
EMPTY_FRAME = SKIPPABLE.to_bytes(4, "little") + bytes(4)

DICTIONARY_BYTES = 16_384
SAMPLE_RECORDS = 64
# A sample ends early at this many bytes, as it is held in memory.
SAMPLE_BYTES = 8_000_000
ARCHIVE_BYTES = 32_000_000
LEVEL = 3

VERSION = b"WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDENTITY = "<urn:page:{}>"

RECORD_SCHEMA = (
    "archive string, position long, record_type string, record_id string, target_uri string, date string, "
    "payload_digest string, refers_to string, payload binary"
)


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    """SHA-1 in base 32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, identity: str, uri: str | None, payload: bytes, payload_digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record with its closing blank lines."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "response":
        block += payload
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", identity),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri and uri.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Refers-To", refers_to),
        ("WARC-Profile", PROFILE if kind == "revisit" else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = [VERSION] + [f"{name}: {value}".encode() for name, value in headers if value is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]):
    """A dictionary trained on the first records of an archive, or None if they are too few."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def skippable_frame(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def archives(records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Archives of at least ``archive_bytes``, the last one of what is left.

    Each has a dictionary trained on its own first records, or that of the archive before if they are too few.
    """
    import zstandard

    trained = None
    while True:
        first, sampled = [], 0
        for item in records:
            first.append(item)
            sampled += len(item)
            if len(first) == SAMPLE_RECORDS or sampled >= SAMPLE_BYTES:
                break
        if not first:
            return
        trained = _dictionary(first) or trained
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
        frames = [] if trained is None else [skippable_frame(DICTIONARY_FRAME, trained.as_bytes())]
        frames += [compressor.compress(item) for item in first]
        first.clear()
        size = sum(map(len, frames))
        while size < archive_bytes and (item := next(records, None)) is not None:
            frames.append(compressor.compress(item))
            size += len(frames[-1])
        yield b"".join(frames)


def _writing(date: str, archive_bytes: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for values in zip(*batch.columns):
                    identity, uri, payload, first = (value.as_py() for value in values)
                    revisit = first is not None and first != identity
                    yield record(
                        "revisit" if revisit else "response",
                        IDENTITY.format("" if identity is None else identity),
                        uri,
                        payload,
                        digest(payload),
                        IDENTITY.format(first) if revisit else None,
                        date,
                    )

        for archive in archives(records(), archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["value"])

    return whole


def write_archives(
    pages: DataFrame,
    path: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Write archives of about ``archive_bytes`` and less into the folder ``path``."""
    checkpoint_folder(pages.sparkSession)
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), payload.alias("payload")
    ).withColumn("key", F.unhex(F.sha2("payload", 256)))
    shared = (
        rows.groupBy("key")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1 AND first IS NOT NULL")
        .select(F.col("key").alias("_key"), "first")
        .checkpoint()  # a join with it can be split where a payload is frequent; sharing its exchange it could not
    )
    whole = (
        rows.join(shared, F.col("key") == F.col("_key"), "left")
        .select("id", "url", "payload", "first")
        .mapInArrow(_writing(date, archive_bytes), "value binary")
        .select(F.col("value").cast("string").alias("value"))
    )
    whole.write.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", 1).text(path)


def frames_of(archive: bytes) -> Iterator[tuple[int, int, int]]:
    """``magic number, start, end`` of each frame, from the frame and block headers alone."""
    at, view = 0, memoryview(archive)
    number = lambda a, n: int.from_bytes(view[a : a + n], "little")
    while at < len(view):
        start, magic = at, number(at, 4)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + number(at + 4, 4)
        elif magic == FRAME:
            flags = view[at + 4] if at + 4 < len(view) else 0
            single, checksum = flags >> 5 & 1, flags >> 2 & 1
            size_bytes = (1 if single else 0, 2, 4, 8)[flags >> 6]
            at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size_bytes
            last = False
            while not last:
                if at + 3 > len(view):
                    raise WarcError(f"the frame at {start} is cut off")
                block = number(at, 3)
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                at += 3 + (1 if kind == 1 else size)
            at += 4 * checksum
        else:
            raise WarcError(f"no frame begins at {start}")
        if at > len(view):
            raise WarcError(f"the frame at {start} is cut off")
        yield magic, start, at


def parse_record(content: bytes, position: int) -> dict:
    """Fields of one validated record."""

    def check(holds: bool, what: str) -> None:
        if not holds:
            raise WarcError(f"record at {position}: {what}")

    head, blank, rest = content.partition(b"\r\n\r\n")
    check(bool(blank), "its header does not end")
    version, *lines = head.split(b"\r\n")
    check(version == VERSION, "unknown version")
    headers = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "strict").partition(":")
        check(bool(colon), f"no header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in REQUIRED:
        check(name in headers, f"no {name}")
    kind = headers["warc-type"]
    check(headers["content-length"].isdigit(), "its length is no number")
    length = int(headers["content-length"])
    check(len(rest) == length + 4, f"{len(rest) - 4} bytes where {length} are declared")
    check(rest[length:] == b"\r\n\r\n", "no blank lines at its end")
    payload = None
    if kind == "response":
        _, blank, payload = rest[:length].partition(b"\r\n\r\n")
        check(bool(blank), "its HTTP header does not end")
    declared = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if payload is not None and declared is not None:
        check(digest(payload) == declared, "its payload has another digest")
    if kind == "revisit":
        check("warc-refers-to" in headers, "it refers to nothing")
    return {
        "position": position,
        "record_type": kind,
        "record_id": headers["warc-record-id"],
        "target_uri": headers.get("warc-target-uri"),
        "date": headers["warc-date"],
        "payload_digest": declared,
        "refers_to": headers.get("warc-refers-to"),
        "payload": payload,
    }


def records_of(archive: bytes) -> Iterator[dict]:
    """Decode and validate the records of one archive, frame by frame."""
    import zstandard

    dictionary, seen = None, False
    decompressor = zstandard.ZstdDecompressor()
    view = memoryview(archive)
    for magic, start, end in frames_of(archive):
        if magic == DICTIONARY_FRAME and not seen:
            content = bytes(view[start + 8 : end])
            if int.from_bytes(content[:4], "little") == FRAME:
                content = zstandard.ZstdDecompressor().decompress(content)
            if int.from_bytes(content[:4], "little") != DICTIONARY:
                raise WarcError("the leading frame holds no dictionary")
            dictionary = zstandard.ZstdCompressionDict(content)
            decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
        elif magic == FRAME:
            yield parse_record(decompressor.decompressobj().decompress(view[start:end]), start)
        seen = True


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in RECORD_SCHEMA.split(", ")]
    kinds = [pa.binary() if n == "payload" else pa.int64() if n == "position" else pa.string() for n in names]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            held, size = [], 0
            for found in records_of(content.as_buffer().to_pybytes() if content.is_valid else b""):
                held.append(found | {"archive": path.as_py()})
                size += len(found["payload"] or b"")
                if size > 4_000_000 or len(held) >= 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds)], names)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder; a broken archive fails with :class:`WarcError`."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_reading, RECORD_SCHEMA)


def page_number(record_id: Column) -> Column:
    """The id that ``write_archives`` put into a record's identity."""
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

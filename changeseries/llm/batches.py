"""Batches of documents that ask buckets of keys.

Looking up a key of every word or window by a join would shuffle a row for each. Here
documents are grouped into batches by a hash of their id; a batch sends each of its
different keys once, sorted and packed, to the bucket that owns that part of the
key space, and a bucket answers every batch with an array in the batch's own order. A
key that all documents share costs one entry per batch. Batches and buckets have a least
size, beyond which both grow with the root of the input: there are at most as many messages as the input has
``MESSAGE_TEXT`` bytes. At 100 TB a batch holds 320 MB of text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 4_000_000
BUCKET_BYTES = 16_000_000
MESSAGE_TEXT = 1_024

MESSAGE = "bucket long, batch long, kind int, payload binary"


def batch_bytes(size: int, least: int) -> int:
    """Bytes of text in a batch or bucket, given those of all texts."""
    return max(least, math.isqrt(size * MESSAGE_TEXT))


def batched(
    rows: DataFrame, id_column: str, text_column: str, bucket_bytes: int | None = None, least_batch: int | None = None
) -> tuple[DataFrame, int]:
    """Columns ``batch, id, text`` (binary, null as empty), and the bits that number the buckets.

    A row's batch depends on its id and its text, so rows without an id or with equal ids are spread, too.
    """
    size = rows.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    count = max(1, -(-size // batch_bytes(size, least_batch or BATCH_BYTES)))
    bits = max(0, (-(-size // batch_bytes(size, bucket_bytes or BUCKET_BYTES)) - 1).bit_length()) if size else 0
    identity = F.col(id_column).cast("long")
    texts = rows.select(
        F.pmod(F.xxhash64(identity, F.col(text_column)), F.lit(count)).alias("batch"),
        identity.alias("id"),
        F.coalesce(F.col(text_column).cast("binary"), F.lit("").cast("binary")).alias("text"),
    )
    return texts, bits


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, stored byte plane by byte plane so that equal high bytes vanish."""
    planes = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(content: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(content), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their differences."""
    return packed(np.diff(values, prepend=values[:1] * 0))


def unpacked_sorted(content: bytes) -> np.ndarray:
    return np.cumsum(unpacked(content), dtype=np.uint64)


def packed_bits(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(len(values).to_bytes(8, "little") + np.packbits(values).tobytes())


def unpacked_bits(content: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(content)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


def joined(*parts: bytes) -> bytes:
    """Several byte strings as one."""
    return len(parts).to_bytes(4, "little") + b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(content: bytes) -> list[bytes]:
    out, at = [], 4
    for _ in range(int.from_bytes(content[:4], "little")):
        size = int.from_bytes(content[at : at + 8], "little")
        out.append(content[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def bucket_slices(sorted_hashes: np.ndarray, bits: int):
    """``bucket, from, to`` of every bucket that owns some of the sorted hashes; the top bits name it."""
    if not len(sorted_hashes):
        return
    buckets = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sorted_hashes), np.int64)
    firsts = np.flatnonzero(np.diff(buckets, prepend=-1))
    for first, end in zip(firsts, np.append(firsts[1:], len(buckets))):
        yield int(buckets[first]), int(first), int(end)


def groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and the number of each value's run."""
    new = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.flatnonzero(new), np.cumsum(new) - 1


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    bucket, batch, kind, payload = zip(*rows) if rows else ((), (), (), ())
    return pa.table(
        {
            "bucket": pa.array(bucket, pa.int64()),
            "batch": pa.array(batch, pa.int64()),
            "kind": pa.array(kind, pa.int32()),
            "payload": pa.array(payload, pa.binary()),
        }
    )

"""Dropping lines that many documents share, by a sharded minimal perfect hash.

A line's key is the line without white space at both ends and with A-Z lower-cased, known
by ``KEY_BITS`` bits of its hash. The key space is cut into shards by the leading bits. For each
shard an index is built over all its different keys: a minimal perfect hash gives every key a place
of its own, and under that place stand its fingerprint and the number of documents
that hold it. There is no table of lines and no join with one: a batch of documents asks
each shard for its different keys, the shard probes its arrays and answers with one bit a key (see ``batches``).

The index is a table in the shared folder, one row a shard, and can be probed with other
documents than those it was built from. A key of the index is answered exactly, as long as no two different
lines share all hash bits: among 10^12 different lines the chance that any two do is one in 160,000.
A line that the index has never seen is refused by its fingerprint but for one in 2^32.

Tasks count their documents' keys before anything is shuffled, so a line that all documents
hold costs one entry per chunk of documents. Counts are kept in as many bytes as the largest of a shard needs.

Results for odd rows: null and empty texts are one empty line, which has no key and stays; they
take no part in the exchange. Every row is a document of its own, also with the id of another or none.
A line that a document repeats counts once for it and is dropped everywhere. Texts are taken whole, lines
may be as long as a text. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeseries.llm.batches import (
    BATCH_BYTES,
    MESSAGE,
    batched,
    bucket_slices,
    joined,
    messages,
    packed,
    packed_bits,
    packed_sorted,
    parted,
    unpacked,
    unpacked_bits,
    unpacked_sorted,
)
from changeseries.llm.storage import written
from changeseries.llm.wordhash import SEED_1, SEED_2, mixed

KEY_BITS = 96
SHARD_BYTES = 48_000_000
INDEX = "shard long, n_keys long, levels binary, fingerprints binary, counts binary"
ASKED, ANSWERED = 0, 1
KEPT = "id long, n_lines long, n_dropped long, kept binary"


# --- the perfect hash ---------------------------------------------------------------


class PerfectHash:
    """Places 0 to n - 1 of n different keys, each a pair of 64-bit numbers.

    Keys fall on the bits of a level of twice their number. A bit that one key alone fell on is
    set and is that key's; the other keys go on to the next level. A key's place is the number of
    set bits before its own.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for level in levels:
            rank = np.cumsum(level, dtype=np.int64) - level + before
            before += int(level.sum())
            self.ranks.append(rank)

    @staticmethod
    def _bit(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        first, second = (np.uint64(level * int(seed) % (1 << 64)) for seed in (SEED_2, SEED_1))
        spread = mixed(high + first) ^ mixed(low + second, SEED_2)
        return ((mixed(spread) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        while len(high):
            size = max(64, 2 * len(high))
            bit = cls._bit(high, low, len(levels), size)
            fell = np.bincount(bit, minlength=size)
            levels.append(fell == 1)
            left = fell[bit] > 1
            high, low = high[left], low[left]
        return cls(levels)

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for some of the keys the hash was not built for, any place for others."""
        out = np.full(len(high), -1, np.int64)
        open_ = np.arange(len(high))
        for number, (level, rank) in enumerate(zip(self.levels, self.ranks)):
            bit = self._bit(high[open_], low[open_], number, len(level))
            found = level[bit]
            out[open_[found]] = rank[bit[found]]
            open_ = open_[~found]
        return out

    def to_bytes(self) -> bytes:
        return joined(*[packed_bits(level) for level in self.levels])

    @classmethod
    def from_bytes(cls, content: bytes) -> PerfectHash:
        return cls([unpacked_bits(part) for part in parted(content)])


# --- keys ---------------------------------------------------------------------------


def _line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: the six white-space characters, the letters A-Z


def _long_enough(key: bytes, shortest: int) -> bool:
    return len(key) >= shortest and (shortest <= 1 or len(key.decode()) >= shortest)


class LineKeys:
    """The lines of some texts and their different keys.

    ``high, low`` are the different keys, sorted, and ``n`` the number of texts that hold each; ``place`` is the number of
    each line's key among them, -1 for lines that are too short to have one.
    """

    def __init__(self, texts: list[bytes], shortest: int):
        self.lines = [text.split(b"\n") for text in texts]
        keys = [_line_key(line) for lines in self.lines for line in lines]
        self.counts = np.fromiter(map(len, self.lines), np.int64, len(texts))
        has_key = np.fromiter((_long_enough(key, shortest) for key in keys), bool, len(keys))
        digests = b"".join(xxhash.xxh3_128_digest(key) for key, real in zip(keys, has_key.tolist()) if real)
        high, low = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        low = low >> np.uint64(128 - KEY_BITS)
        document = np.repeat(np.arange(len(texts)), self.counts)[has_key]
        order = np.lexsort((document, low, high))
        high, low, document = high[order], low[order], document[order]
        new_key, new_document = np.ones(len(order), bool), np.ones(len(order), bool)
        new_key[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        new_document[1:] = new_key[1:] | (document[1:] != document[:-1])
        firsts = np.flatnonzero(new_key)
        self.high, self.low = high[firsts], low[firsts]
        self.n = np.add.reduceat(new_document.astype(np.int64), firsts) if len(firsts) else np.empty(0, np.int64)
        self.place = np.full(len(keys), -1, np.int64)
        with_key = np.empty(len(order), np.int64)
        with_key[order] = np.cumsum(new_key) - 1
        self.place[has_key] = with_key


# --- the index ----------------------------------------------------------------------


def _counting(chunk: int, bits: int, shortest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Messages to the shards: this chunk's different keys and their numbers of documents."""

        def counted() -> pa.RecordBatch:
            keys = LineKeys(texts, shortest)
            return messages(
                [
                    (shard, 0, ASKED, joined(packed_sorted(keys.high[i:j]), packed(keys.low[i:j]), packed(keys.n[i:j])))
                    for shard, i, j in bucket_slices(keys.high, bits)
                ]
            ).to_batches()

        texts, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= chunk:
                    yield from counted()
                    texts, size = [], 0
        if texts:
            yield from counted()

    return count


def _smallest_type(largest: int) -> type:
    return next(kind for kind in (np.uint8, np.uint16, np.uint32, np.uint64) if largest <= np.iinfo(kind).max)


def _building(table: pa.Table) -> pa.Table:
    """The index of one shard: counts of all chunks added up, a perfect hash over the different keys."""
    parts = [parted(payload) for payload in table.column("payload").to_pylist()]
    high = np.concatenate([unpacked_sorted(part[0]) for part in parts])
    low, n = (np.concatenate([unpacked(part[i]) for part in parts]) for i in (1, 2))
    order = np.lexsort((low, high))
    high, low, n = high[order], low[order], n[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    firsts = np.flatnonzero(new)
    high, low, n = high[firsts], low[firsts], np.add.reduceat(n, firsts)
    perfect = PerfectHash.build(high, low)
    place = perfect.places(high, low)
    fingerprints, counts = np.empty(len(n), np.uint32), np.empty(len(n), _smallest_type(int(n.max())))
    fingerprints[place], counts[place] = low.astype(np.uint32), n
    return pa.table(
        {
            "shard": pa.array([table.column("bucket")[0].as_py()], pa.int64()),
            "n_keys": pa.array([len(n)], pa.int64()),
            "levels": pa.array([perfect.to_bytes()], pa.binary()),
            "fingerprints": pa.array([fingerprints.tobytes()], pa.binary()),
            "counts": pa.array([bytes([counts.itemsize]) + counts.tobytes()], pa.binary()),
        }
    )


def _with_text(documents: DataFrame, text_column: str) -> DataFrame:
    return documents.where(F.octet_length(text_column) > 0)


def build_index(documents: DataFrame, bits: int, text_column: str = "text", shortest: int = 1) -> DataFrame:
    """``INDEX``, one row for each of at most ``2 ** bits`` shards: in how many documents every line stands."""
    texts = _with_text(documents, text_column).select(F.col(text_column).cast("binary").alias("text"))
    size = BATCH_BYTES << (bits // 3)  # chunks grow as shards get more; 256 MB at 100 TB
    counted = texts.mapInArrow(_counting(size, bits, shortest), MESSAGE)
    return counted.groupBy("bucket").applyInArrow(_building, INDEX)


class ShardIndex:
    """The arrays of one shard."""

    def __init__(self, levels: bytes, fingerprints: bytes, counts: bytes):
        self.perfect = PerfectHash.from_bytes(levels)
        self.fingerprints = np.frombuffer(fingerprints, np.uint32)
        self.counts = np.frombuffer(counts, f"<u{counts[0]}", offset=1)

    def documents_with(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """In how many documents each key stands; 0 for keys that are not in the index."""
        place = self.perfect.places(high, low)
        out = np.zeros(len(place), np.uint64)
        known = np.flatnonzero(place >= 0)
        known = known[self.fingerprints[place[known]] == low[known].astype(np.uint32)]
        out[known] = self.counts[place[known]]
        return out


# --- documents ----------------------------------------------------------------------


def _asking(bits: int, shortest: int):
    def ask(table: pa.Table) -> pa.Table:
        batch, keys = table.column("batch")[0].as_py(), LineKeys(table.column("text").to_pylist(), shortest)
        return messages(
            [
                (shard, batch, ASKED, joined(packed_sorted(keys.high[i:j]), packed(keys.low[i:j])))
                for shard, i, j in bucket_slices(keys.high, bits)
            ]
        )

    return ask


def _answering(least: int):
    def answer(asked: pa.Table, index: pa.Table) -> pa.Table:
        """For each key of each batch: do at least ``least`` documents hold it."""
        if not asked.num_rows or not index.num_rows:
            return messages([])
        shard = ShardIndex(*(index.column(c)[0].as_py() for c in ("levels", "fingerprints", "counts")))
        rows = []
        for bucket, batch, payload in zip(*(asked.column(c).to_pylist() for c in ("bucket", "batch", "payload"))):
            high, low = parted(payload)
            common = shard.documents_with(unpacked_sorted(high), unpacked(low)) >= least
            if common.any():
                rows.append((bucket, batch, ANSWERED, packed_bits(common)))
        return messages(rows)

    return answer


def _dropping(bits: int, shortest: int):
    def drop(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        keys = LineKeys(texts, shortest)
        found = dict(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist()))
        common = np.zeros(len(keys.high) + 1, bool)  # the last is that of lines without a key
        for shard, i, j in bucket_slices(keys.high, bits):
            if shard in found:
                common[i:j] = unpacked_bits(found[shard])
        gone = common[keys.place]
        ends = np.cumsum(keys.counts)
        kept, dropped = [], []
        for text, lines, end in zip(texts, keys.lines, ends.tolist()):
            here = gone[end - len(lines) : end]
            dropped.append(int(here.sum()))
            kept.append(b"\n".join(line for line, g in zip(lines, here.tolist()) if not g) if dropped[-1] else text)
        return pa.table(
            {
                "id": table.column("id"),
                "n_lines": pa.array(keys.counts, pa.int64()),
                "n_dropped": pa.array(dropped, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return drop


def probe(texts: DataFrame, index: DataFrame, bits: int, least: int, shortest: int = 1) -> DataFrame:
    """``KEPT`` of the rows ``batch, id, text`` of ``batched``, after a look into the index."""
    by_batch = texts.groupBy("batch")
    asked = by_batch.applyInArrow(_asking(bits, shortest), MESSAGE)
    answers = asked.groupBy("bucket").cogroup(index.groupBy("shard")).applyInArrow(_answering(least), MESSAGE)
    return by_batch.cogroup(answers.groupBy("batch")).applyInArrow(_dropping(bits, shortest), KEPT)


def drop_common_lines(documents: DataFrame, least: int = 10, shortest: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_lines, n_dropped, kept``: every document without the lines whose keys stand in ``least`` documents or more.

    Keys have ``shortest`` characters at least; lines with shorter ones stay.
    """
    if shortest < 1:
        raise ValueError("an empty line has no key: shortest must be 1 or more")
    texts, bits = batched(_with_text(documents, text_column), id_column, text_column, SHARD_BYTES)
    index = written(build_index(documents, bits, text_column, shortest), "line-index")
    without = documents.where(F.coalesce(F.octet_length(text_column), F.lit(0)) == 0)
    plain = without.selectExpr(f"CAST(`{id_column}` AS long) AS id", "1L AS n_lines", "0L AS n_dropped", "CAST('' AS binary) AS kept")
    out = probe(texts, index, bits, least, shortest).unionByName(plain)
    return out.selectExpr(f"id AS `{id_column}`", "n_lines", "n_dropped", "CAST(kept AS STRING) AS kept")

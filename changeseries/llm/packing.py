"""Packing documents into fixed-length training sequences over several context sizes.

Documents are routed to tiers of context sizes (powers of two up to the capacity) by
their length; what exceeds the capacity is cut into full sequences first. Every
tier is packed from the longest down: a document opens a sequence of its tier's
length, the gap is filled with the longest documents of shorter tiers that fit, and
what then remains with the front part of a shorter document, whose rest goes back
to its new tier. Sequences therefore end exactly at their tier's length and need no
padding. Sequences of one length are dealt to step groups of equally many tokens.

The work is local to a task: a task packs its documents in buffers of
``BUFFER_TOKENS`` and carries open ends from one buffer to the next, so that memory
is bounded, no token is shuffled, and a lost task is simply run again. What is left
at the end of a task is cut at powers of two, which need no padding either.

Tokens: the vocabulary drops white space and never joins characters across it, so a
text's ids are those of its words one after the other. Each different word is
encoded once per worker process and known by its hash; the memory for words is bounded, too.

Results for odd rows: null and empty text is the end id alone. Null ids and repeated
rows are packed as documents of their own. Very long texts are cut, not truncated. An
empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import os
import sys
import types
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeseries.llm.wordhash import Powers, Words

CAPACITY = 2048
SMALLEST_TIER = 256
END_ID = 1
STEP_TOKENS = 32_768
BUFFER_TOKENS = 500_000
CHUNK_BYTES = 1_000_000
CACHED_WORDS = 1_500_000
WORDS_AT_ONCE = 1_000
PARTING = "\x01"

SCHEMA = (
    "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_length int, step_group long"
)


def tiers(capacity: int = CAPACITY, smallest: int = SMALLEST_TIER) -> list[int]:
    """Context sizes from the largest down."""
    sizes = [capacity]
    while sizes[-1] // 2 >= smallest:
        sizes.append(sizes[-1] // 2)
    return sizes


class WordEncoder:
    """Ids of texts by encoding every different word once.

    Words are known by a 64-bit hash. Unknown words are encoded many at a time, parted by
    a control character that stands alone between spaces and so has an id of its own.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.powers = Tokenizer.from_file(tokenizer_file), Powers()
        (self.parting,) = self._ids(PARTING)
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        found, sizes = [], []
        for first in range(0, len(words), WORDS_AT_ONCE):
            part = words[first : first + WORDS_AT_ONCE]
            if any(PARTING in w for w in part):
                single = [np.array(self._ids(w), np.uint32) for w in part]
                found += single
                sizes.append(np.fromiter(map(len, single), np.int64, len(single)))
                continue
            ids = np.array(self._ids(f" {PARTING} ".join(part)), np.uint32)
            between = np.flatnonzero(ids == self.parting)
            sizes.append(np.diff(between, prepend=-1, append=len(ids)) - 1)
            found.append(np.delete(ids, between))
        return np.concatenate(found), np.concatenate(sizes)

    def _learn(self, words: Words, hashes: np.ndarray, examples: np.ndarray) -> None:
        """Add those of the sorted ``hashes`` that are unknown; ``examples`` are words that have them."""
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        if new.sum() + len(self.known) > CACHED_WORDS and len(self.known):
            self._forget()
            return self._learn(words, hashes, examples)
        if new.any():
            raw = words.buffer.tobytes()
            spans = zip(words.starts[examples[new]].tolist(), words.ends[examples[new]].tolist())
            ids, sizes = self._encode_words([raw[a:b].decode("utf-8", "replace") for a, b in spans])
            self.known = np.insert(self.known, at[new], hashes[new])
            self.starts = np.insert(self.starts, at[new], len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes = np.insert(self.sizes, at[new], sizes)
            self.ids = np.concatenate((self.ids, ids))
        return None

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, and the end id."""
        words = Words(texts, self.powers)
        hashes, examples, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        self._learn(words, hashes, examples)
        at = np.searchsorted(self.known, hashes)[which]
        sizes = self.sizes[at]
        before = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.ids[np.repeat(self.starts[at] - before[:-1], sizes) + np.arange(before[-1])]
        bounds, last = before[words.bounds], np.array([END_ID], np.uint32)
        return [np.concatenate((flat[a:b], last)) for a, b in zip(bounds[:-1], bounds[1:])]


def word_encoder(tokenizer_file: str) -> WordEncoder:
    """The encoder of this worker process; reused workers keep its words for their next task."""
    kept = sys.modules.setdefault("kept_word_encoders", types.ModuleType("kept_word_encoders")).__dict__
    if tokenizer_file not in kept:
        kept[tokenizer_file] = WordEncoder(tokenizer_file)
    return kept[tokenizer_file]


class Packer:
    """Packs pieces ``(document, start, length)`` into sequences of exact tier lengths."""

    def __init__(self, capacity: int = CAPACITY, smallest: int = SMALLEST_TIER):
        self.capacity, self.tiers = capacity, tiers(capacity, smallest)
        self.waiting: list[tuple[int, int, int]] = []  # length, document, start; shortest first

    def add(self, document: int, tokens: int) -> Iterator[list[tuple[int, int, int]]]:
        """Route a document; its full-capacity sequences come back at once."""
        start = 0
        while tokens - start >= self.capacity:
            yield [(document, start, self.capacity)]
            start += self.capacity
        if start < tokens:
            insort(self.waiting, (tokens - start, document, start))

    def _fill(self, size: int, below: int) -> list[tuple[int, int, int]] | None:
        """A sequence of ``size`` tokens opened by the longest waiting piece, or None if too few wait.

        Pieces of up to ``below`` tokens, the shorter tiers, are preferred as fillers.
        """
        first = self.waiting.pop()
        pieces, gap = [(first[1], first[2], first[0])], size - first[0]
        taken = [first]
        while gap:
            fits = bisect_right(self.waiting, (gap, float("inf"), 0)) - 1
            if fits >= 0:
                length, document, start = self.waiting.pop(fits)
                taken.append((length, document, start))
                pieces.append((document, start, length))
                gap -= length
            elif self.waiting:
                shorter = bisect_left(self.waiting, (below + 1,))
                length, document, start = self.waiting.pop(max(shorter - 1, 0))
                pieces.append((document, start, gap))
                insort(self.waiting, (length - gap, document, start + gap))
                return pieces
            else:
                for piece in taken:
                    insort(self.waiting, piece)
                return None
        return pieces

    def pack(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences from all that waits, except an open end, which keeps waiting."""
        for size in self.tiers:
            while self.waiting and self.waiting[-1][0] > size // 2:
                pieces = self._fill(size, size // 2)
                if pieces is None:
                    return
                yield pieces

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """Everything that waits, cut at powers of two."""
        yield from self.pack()
        left = sum(piece[0] for piece in self.waiting)
        size = self.capacity
        while self.waiting:
            while size > left:
                size //= 2
            pieces, gap = [], size
            while gap:
                length, document, start = self.waiting.pop()
                use = min(gap, length)
                pieces.append((document, start, use))
                gap -= use
                if use < length:
                    self.waiting.append((length - use, document, start + use))
            left -= size
            yield pieces


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of a batch in groups of a few megabytes."""
    ids, texts, size = [], [], 0
    for identity, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(identity)
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= CHUNK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


class _Writer:
    """Numbers sequences and step groups and turns them into record batches."""

    def __init__(self, partition: int, step_tokens: int):
        self.first, self.step_tokens = partition << 36, step_tokens
        self.sequences, self.counts, self.groups = 0, {}, {}
        self.columns: list[list] = [[] for _ in range(9)]

    def _group(self, size: int) -> int:
        """A new group begins when the group of this length holds its tokens."""
        count = self.counts.get(size, 0)
        if count % max(self.step_tokens // size, 1) == 0:
            self.groups[size] = self.first + sum(self.counts.values())
        self.counts[size] = count + 1
        return self.groups[size]

    def add(self, pieces: list[tuple[int, int, int]], documents: dict) -> None:
        size, offset = sum(piece[2] for piece in pieces), 0
        group = self._group(size)
        for document, start, length in pieces:
            identity, ids = documents[document]
            row = (identity, start, length, ids[start : start + length].tobytes(), len(ids), self.first + self.sequences, offset, size, group)
            for column, value in zip(self.columns, row):
                column.append(value)
            offset += length
        self.sequences += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds)], names)
        self.columns = [[] for _ in range(9)]
        return out


def _packing(tokenizer_file: str, capacity: int, step_tokens: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = word_encoder(tokenizer_file), Packer(capacity)
        writer = _Writer(TaskContext.get().partitionId(), step_tokens)
        documents: dict[int, tuple] = {}
        number = buffered = 0
        for batch in batches:
            for identities, texts in _chunks(batch):
                for identity, ids in zip(identities, encoder.encode(texts)):
                    documents[number] = identity, ids.astype("<u4")
                    for pieces in packer.add(number, len(ids)):
                        writer.add(pieces, documents)
                    number, buffered = number + 1, buffered + len(ids)
                if buffered >= BUFFER_TOKENS:
                    for pieces in packer.pack():
                        writer.add(pieces, documents)
                    yield writer.batch()
                    open_ends = {piece[1] for piece in packer.waiting}
                    documents = {k: v for k, v in documents.items() if k in open_ends}
                    buffered = sum(piece[0] for piece in packer.waiting)
        for pieces in packer.rest():
            writer.add(pieces, documents)
        yield writer.batch()

    return packed


def pack(
    documents: DataFrame,
    tokenizer_file: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: ``id, start, length, ids, doc_tokens, sequence_id, offset, sequence_length, step_group``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers; a
    document's tokens are its text's ids and the end id. ``capacity`` is a power of two.
    """
    if capacity & (capacity - 1) or capacity < SMALLEST_TIER:
        raise ValueError(f"the capacity must be a power of two of at least {SMALLEST_TIER}")
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(_packing(tokenizer_file, capacity, step_tokens), SCHEMA).withColumnRenamed("id", id_column)

"""Removing passages that an earlier document holds, by fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of
``BLOCK = (WINDOW + 1) // 2`` words. Any window of ``WINDOW`` words contains a whole block of its
own document, so two documents share a window only if one of the rolling
``BLOCK``-word windows of either meets a reference block of the other. That
gives the anchors: block hashes that stand in a reference index and occur in two or more
documents. Around anchors, and only there, hits are extended to the full window;
neighbouring repeated windows join to maximal exact repeats.

Both steps are exchanges between batches of documents and buckets of hashes (see
``batches``). In the first a batch sends the hashes of all its rolling windows, marked
where they are reference blocks, and learns which ones other batches hold. In the second
it sends the hash and its smallest document of every window around an anchor, and
learns which windows a smaller document of another batch has. Extension is
by hash and not by comparing pairs, so a passage that n documents share costs n entries at most. The
answers are bit arrays; pairs of documents never appear. Anchors may hold false
positives, windows are compared with all 64 bits of their hash.

Windows are judged on the input: the smallest document keeps a shared passage, all
others lose every word that a shared window covers.

Results for odd rows: null text has no word. A document without an id counts as larger
than all others and loses what they have. Rows with equal ids are documents of their
own but none is smaller, so they take nothing from each other. Texts are compared whole. An empty table gives an
empty result. Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeseries.llm.batches import (
    MESSAGE,
    batched,
    bucket_slices,
    groups,
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
from changeseries.llm.wordhash import SEED_2, Powers, Words, runs_of_texts, window_hashes

WINDOW = 13
KEY_BITS = 36
NO_ID = np.iinfo(np.int64).max
CHUNK_BYTES = 500_000

ANCHORS, REPEATS, KNOWN = 1, 2, 3


def block_size(window: int) -> int:
    """The longest block such that every window holds a whole one."""
    return (window + 1) // 2


class Batch:
    """Word windows of the documents of one batch; places are words of all its texts in a row."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.block = window, block_size(window)
        self.ids, self.texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        powers, hashes, lefts, texts = Powers(), [], [], []
        for first, end in runs_of_texts(self.texts, CHUNK_BYTES):
            words = Words(self.texts[first:end], powers)
            hashes.append(words.hashes)
            lefts.append(words.left())
            texts.append(words.text_of_word() + first)
        empty = [np.empty(0, np.int64)]
        self.hashes = np.concatenate(hashes or [np.empty(0, np.uint64)])
        self.left = np.concatenate(lefts or empty)
        self.text_of_word = np.concatenate(texts or empty)
        self.counts = np.bincount(self.text_of_word, minlength=len(self.texts))
        keys = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.document = keys[self.text_of_word] if len(keys) else np.empty(0, np.int64)
        self._find_blocks()

    def _find_blocks(self) -> None:
        """Different hashes of rolling block windows, sorted, with what the batch knows of each."""
        self.places = np.flatnonzero(self.left >= self.block)
        hashes = window_hashes(self.hashes, self.block)[self.places]
        order = np.argsort(hashes)
        firsts, run = groups(hashes[order])
        self.run_of_place = np.empty(len(order), np.int64)
        self.run_of_place[order] = run
        self.blocks = hashes[order][firsts]
        within = (self.counts[self.text_of_word] - self.left)[self.places]
        self.is_reference = np.zeros(len(firsts), bool)
        self.is_reference[self.run_of_place[within % self.block == 0]] = True
        documents = self.document[self.places][order]
        if len(firsts):
            self.shared = np.minimum.reduceat(documents, firsts) != np.maximum.reduceat(documents, firsts)
        else:
            self.shared = np.empty(0, bool)

    def block_messages(self, batch: int, bits: int) -> pa.Table:
        shift = np.uint64(64 - bits - KEY_BITS)
        keys = (self.blocks >> shift) & np.uint64((1 << KEY_BITS) - 1)
        entries = keys << np.uint64(1) | self.is_reference.astype(np.uint64)
        return messages([(b, batch, ANCHORS, packed_sorted(entries[i:j])) for b, i, j in bucket_slices(self.blocks, bits)])

    def find_windows(self, answers: dict[int, bytes], bits: int) -> None:
        """Windows around anchors: places, different hashes, and the smallest document of each."""
        indexed, elsewhere = self.is_reference.copy(), self.shared.copy()
        for bucket, first, end in bucket_slices(self.blocks, bits):
            if bucket in answers:
                indexed_there, seen_there = map(unpacked_bits, parted(answers[bucket]))
                indexed[first:end] |= indexed_there
                elsewhere[first:end] |= seen_there
        hit = np.zeros(len(self.hashes) + 1, np.int64)
        hit[self.places + 1] = (indexed & elsewhere)[self.run_of_place]
        before = np.cumsum(hit)
        whole = np.flatnonzero(self.left >= self.window)
        near = before[whole + self.window - self.block + 1] > before[whole]
        self.window_places = whole[near]
        hashes = window_hashes(self.hashes, self.window, SEED_2)[self.window_places]
        order = np.argsort(hashes)
        firsts, run = groups(hashes[order])
        self.run_of_window = np.empty(len(order), np.int64)
        self.run_of_window[order] = run
        self.windows = hashes[order][firsts]
        documents = self.document[self.window_places][order]
        self.smallest = np.minimum.reduceat(documents, firsts) if len(firsts) else np.empty(0, np.int64)

    def window_messages(self, batch: int, bits: int) -> list[tuple[int, int, int, bytes]]:
        return [
            (b, batch, REPEATS, joined(packed_sorted(self.windows[i:j]), packed(self.smallest[i:j].view(np.uint64))))
            for b, i, j in bucket_slices(self.windows, bits)
        ]

    def kept(self, answers: dict[int, bytes], bits: int) -> pa.Table:
        smaller = np.zeros(len(self.windows), bool)
        for bucket, first, end in bucket_slices(self.windows, bits):
            if bucket in answers:
                smaller[first:end] = unpacked_bits(answers[bucket])
        repeated = smaller[self.run_of_window] | (self.document[self.window_places] > self.smallest[self.run_of_window])
        begun, size = self.window_places[repeated], len(self.hashes) + 1
        open_windows = np.cumsum(np.bincount(begun, minlength=size) - np.bincount(begun + self.window, minlength=size))
        removed = open_windows[:-1] > 0
        per_text = np.bincount(self.text_of_word[removed], minlength=len(self.texts))
        ends = np.cumsum(self.counts)
        kept = []
        for text, end, count, gone in zip(self.texts, ends, self.counts, per_text):
            words = text.split()
            kept.append(b" ".join(w for w, r in zip(words, removed[end - count : end].tolist()) if not r) if gone else b" ".join(words))
        return pa.table(
            {
                "id": pa.array(self.ids, pa.int64()),
                "n_words": pa.array(self.counts, pa.int64()),
                "n_removed": pa.array(per_text, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For each entry of each batch: is it a reference block in another batch, is it in another batch at all."""
    bucket = table.column("bucket")[0].as_py()
    entries = [unpacked_sorted(p) for p in table.column("payload").to_pylist()]
    everything = np.concatenate(entries)
    order = np.argsort(everything)
    marked = (everything & np.uint64(1)).astype(np.int64)
    firsts, run = groups(everything[order] >> np.uint64(1))
    run_of = np.empty(len(order), np.int64)
    run_of[order] = run
    references = np.add.reduceat(marked[order], firsts)[run_of] - marked
    holders = np.bincount(run_of)[run_of] - 1
    rows, at = [], 0
    for batch, sent in zip(table.column("batch").to_pylist(), entries):
        here = slice(at, at + len(sent))
        if (holders[here] > 0).any():
            rows.append((bucket, batch, ANCHORS, joined(packed_bits(references[here] > 0), packed_bits(holders[here] > 0))))
        at += len(sent)
    return messages(rows)


def _answer_repeats(table: pa.Table) -> pa.Table:
    """For each window of each batch: does a smaller document of another batch have it."""
    bucket, kinds = table.column("bucket")[0].as_py(), table.column("kind").to_pylist()
    if kinds[0] == KNOWN:
        return table.select(["bucket", "batch", "kind", "payload"])
    sent = [parted(p) for p in table.column("payload").to_pylist()]
    windows = [unpacked_sorted(p[0]) for p in sent]
    smallest = [unpacked(p[1]).view(np.int64) for p in sent]
    everything, documents = np.concatenate(windows), np.concatenate(smallest)
    order = np.argsort(everything)
    firsts, run = groups(everything[order])
    run_of = np.empty(len(order), np.int64)
    run_of[order] = run
    smaller = np.minimum.reduceat(documents[order], firsts)[run_of] < documents
    rows, at = [], 0
    for batch, own in zip(table.column("batch").to_pylist(), windows):
        here = smaller[at : at + len(own)]
        if here.any():
            rows.append((bucket, batch, REPEATS, packed_bits(here)))
        at += len(own)
    return messages(rows)


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    """Payloads of a kind by bucket."""
    if not table.num_rows:
        return {}
    columns = [table.column(c).to_pylist() for c in ("bucket", "kind", "payload")]
    return {bucket: payload for bucket, k, payload in zip(*columns) if k == kind}


def remove_repeats(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW
) -> DataFrame:
    """``id, n_words, n_removed, kept``: the kept words joined by single spaces, one row per document."""
    texts, bits = batched(documents, id_column, text_column)

    def ask_anchors(table: pa.Table) -> pa.Table:
        return Batch(table, window).block_messages(table.column("batch")[0].as_py(), bits)

    def ask_repeats(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return messages([])
        number, batch, found = table.column("batch")[0].as_py(), Batch(table, window), _answers(answers, ANCHORS)
        batch.find_windows(found, bits)
        known = [(-1 - number, number, KNOWN, joined(*[b.to_bytes(8, "little") + p for b, p in found.items()]))]
        return messages(batch.window_messages(number, bits) + known)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table, window)
        known = _answers(answers, KNOWN)
        anchors = {int.from_bytes(p[:8], "little"): p[8:] for payload in known.values() for p in parted(payload)}
        batch.find_windows(anchors, bits)
        return batch.kept(_answers(answers, REPEATS), bits)

    by_batch = texts.groupBy("batch")
    anchors = by_batch.applyInArrow(ask_anchors, MESSAGE).groupBy("bucket").applyInArrow(_answer_anchors, MESSAGE)
    windows = by_batch.cogroup(anchors.groupBy("batch")).applyInArrow(ask_repeats, MESSAGE)
    repeats = windows.groupBy("bucket").applyInArrow(_answer_repeats, MESSAGE)
    out = by_batch.cogroup(repeats.groupBy("batch")).applyInArrow(
        remove, "id long, n_words long, n_removed long, kept binary"
    )
    return out.selectExpr(f"id AS `{id_column}`", "n_words", "n_removed", "CAST(kept AS STRING) AS kept")

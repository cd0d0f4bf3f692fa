"""Near-duplicate documents by HyperMinHash: compressed registers, bands, estimate, verification.

A document is the set of its distinct shingles. Every shingle's hash chooses one of
``REGISTERS`` registers by its first bits; a register keeps, of the smallest hash it sees, the count of
leading zeros and the ``MANTISSA_BITS`` bits after the leading one. Two sets agree in
a register about as often as their Jaccard similarity says, plus rare collisions.

1. Texts with equal sets form a class, known by its smallest id; only classes go on.
2. Registers are cut into bands, as wide as the wanted recall permits (``band_width``);
   for that, empty registers borrow from full ones, so that short texts agree no more
   easily than long ones. Classes that agree in a band are candidates. Within a band's
   bucket each class is paired with the smallest one only, so a bucket of n classes costs n rows.
3. The similarity of a pair is estimated from its registers, corrected for
   collisions; pairs that cannot reach the threshold (five standard deviations) go.
4. The rest is verified on the full shingle sets of both texts.
5. Connected components of the verified links are contracted. Buckets that then still
   hold several components are the ones where pairing with the smallest may
   have lost a link between two others. There the full sets of all members are
   compared, block by block of bounded members and bytes, and only links that join components leave
   the task, as pairs of components, which are then joined the same way. So no candidate that matters
   for the components is left out, however large a bucket is.

Band keys are written once and read by both steps that need them. The number of steps that shuffle does
not grow with the size of groups, beyond the rounds that contracting takes.

Results for odd rows: text without words has no shingle and is linked with nothing; a text
of fewer words than a shingle has one shingle. A row without an id takes part in nothing:
its component is null and it is kept. Repeated rows and rows with equal ids belong to one component. Texts
are taken whole. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeseries.llm.components import components
from changeseries.llm.storage import written
from changeseries.llm.wordhash import SEED_1, SEED_2, Powers, Words, mixed, runs_of_texts, window_hashes

SHINGLE_WORDS = 5
REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
MANTISSA_BITS = 10
MISS_PROBABILITY = 1e-6
DEVIATIONS = 5.0
CHUNK_BYTES = 500_000
BORROWING_TRIES = 16
BLOCK_MEMBERS = 500
BLOCK_BYTES = 16_000_000
INCIDENCE_COLUMNS = 2_048

#: Chance that two different smallest hashes leave equal registers: the sum of squared
#: cell probabilities of a smallest hash, cells being 2**-MANTISSA_BITS of a power of two wide.
COLLISION = 0.18 / (1 << MANTISSA_BITS)


def band_width(percent: int) -> int:
    """The widest band with which pairs at the threshold are missed at most with ``MISS_PROBABILITY``."""
    for width in range(REGISTERS, 1, -1):
        if (1 - (percent / 100) ** width) ** (REGISTERS // width) <= MISS_PROBABILITY:
            return width
    return 1


def shingles(texts: list[bytes], size: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and how many each text has."""
    words = Words(texts, powers, lower=True)
    counts, left = words.counts(), words.left()
    keep = left >= size
    hashes = [window_hashes(words.hashes, size)[keep]]
    owners = [words.text_of_word()[keep]]
    for short in range(1, size):
        at = np.flatnonzero(counts == short)
        seed = mixed(np.array([short], np.uint64), SEED_2)[0]
        hashes.append(window_hashes(words.hashes, short, seed)[words.bounds[at]])
        owners.append(at)
    found, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    if len(found):
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.bincount(owner[new], minlength=len(texts))


def registers(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of 16-bit registers per text; 0 is an empty register."""
    out = np.zeros((len(counts), REGISTERS), np.uint16)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = owner * REGISTERS + (found >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    smallest = found[first] << np.uint64(REGISTER_BITS)
    zeros = np.where(smallest == 0, 56, np.minimum(64 - np.frexp(smallest.astype(np.float64))[1], 56)).astype(np.uint64)
    mantissa = (smallest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out.reshape(-1)[place[first]] = (zeros << np.uint64(MANTISSA_BITS) | mantissa) + np.uint64(1)
    return out


def set_keys(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each text's shingles, equal for equal sets."""
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros((len(counts), 2), np.uint64)
    for column, seed in enumerate((SEED_1, SEED_2)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(found, seed))))
        out[:, column] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out.view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _sketching(size: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, end in runs_of_texts(texts, CHUNK_BYTES):
                found, counts = shingles(texts[first:end], size, powers)
                keys = set_keys(found, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(counts, pa.int64()),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.array(np.fromiter(map(len, texts[first:end]), np.int64, end - first)),
                        _binary(registers(found, counts)),
                    ],
                    ["id", "n_shingles", "key_1", "key_2", "bytes", "sketch"],
                )

    return sketches


def _as_matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def densified(matrix: np.ndarray) -> np.ndarray:
    """Registers with the empty ones filled from full ones of the same row, chosen the same way in every row."""
    out, full = matrix.copy(), matrix > 0
    chosen = np.random.default_rng(REGISTERS).integers(0, REGISTERS, (BORROWING_TRIES, REGISTERS))
    for source in chosen:
        if out.all():
            return out
        out = np.where(out > 0, out, matrix[:, source])
    rows = np.flatnonzero(~out.all(axis=1) & full.any(axis=1))
    twice = np.where(np.tile(full[rows], 2), np.arange(2 * REGISTERS), 2 * REGISTERS)
    following = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS] % REGISTERS
    out[rows] = np.where(out[rows] > 0, out[rows], np.take_along_axis(matrix[rows], following, axis=1))
    return out


def band_keys(matrix: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key per row and band of its densified registers."""
    count = REGISTERS // width
    bands = densified(matrix)[:, : count * width].reshape(len(matrix), count, width)
    keys = np.broadcast_to(mixed(np.arange(count, dtype=np.uint64)), bands.shape[:2]).copy()
    for offset in range(width):
        keys = mixed(keys + bands[:, :, offset].astype(np.uint64))
    return keys.view(np.int64)


def _banding(width: int):
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4_000):
                part = batch.slice(first, 4_000)
                keys = band_keys(_as_matrix(part.column("sketch")), width)
                row = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                repeated = [part.column(c).take(row) for c in ("node", "bytes")]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *repeated], ["band", "node", "bytes"])

    return banded


def estimates(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of paired sketches, and how many registers it rests on."""
    used = ((left > 0) | (right > 0)).sum(axis=1)
    equal = ((left == right) & (left > 0)).sum(axis=1)
    share = equal / np.maximum(used, 1)
    return np.clip((share - COLLISION) / (1 - COLLISION), 0, 1), used


def hopeful(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which paired sketches could belong to sets at the threshold."""
    similar, used = estimates(left, right)
    wanted = percent / 100
    return similar >= wanted - DEVIATIONS * np.sqrt(wanted * (1 - wanted) / np.maximum(used, 1))


def _verifying(percent: int, size: int):
    """Pairs ``a, b`` with their texts, in the order of ``b``: estimate, then compare full sets."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, last, other, other_sketch = Powers(), None, None, None
        for batch in batches:
            b, texts_a = batch.column("b").to_pylist(), batch.column("text_a").to_pylist()
            links = []
            for first, end in runs_of_texts(texts_a, CHUNK_BYTES):
                found, counts = shingles(texts_a[first:end], size, powers)
                sketches, ends = registers(found, counts), np.cumsum(counts)
                for i in range(first, end):
                    text_b = batch.column("text_b")[i].as_py() if b[i] != last or last is None else None
                    if text_b is not None:
                        last = b[i]
                        other, other_count = shingles([text_b], size, powers)
                        other_sketch = registers(other, other_count)
                    if hopeful(sketches[i - first : i - first + 1], other_sketch, percent)[0]:
                        own = found[ends[i - first] - counts[i - first] : ends[i - first]]
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        if common and 100 * common >= percent * (len(own) + len(other) - common):
                            links.append(i)
            yield batch.select(["a", "b"]).take(pa.array(links, pa.int64()))

    return linked


def common_shingles(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``[text, text]``: sizes of all intersections, from the incidence of the shingles that several texts have."""
    owner = np.repeat(np.arange(len(counts)), counts)
    _, place, times = np.unique(found, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    number = (np.cumsum(times > 1) - 1)[place[shared]]
    owner, out = owner[shared], np.zeros((len(counts), len(counts)), np.float32)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    end = int(number[-1]) + 1 if len(number) else 0
    for first in range(0, end, INCIDENCE_COLUMNS):
        a, b = np.searchsorted(number, (first, first + INCIDENCE_COLUMNS))
        incidence = np.zeros((len(counts), min(INCIDENCE_COLUMNS, end - first)), np.float32)
        incidence[owner[a:b], number[a:b] - first] = 1
        out += incidence @ incidence.T
    return out


def _spanning(a: np.ndarray, b: np.ndarray, component: np.ndarray) -> list[int]:
    """Numbers of the links that join components, each at most once."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    used = []
    for i, (x, y) in enumerate(zip(component[a].tolist(), component[b].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(i)
    return used


def _comparing(percent: int, size: int):
    """Pairs of different components that have a link among the members of two blocks of one bucket."""

    powers = Powers()  # grows in the worker, kept from group to group

    def linked(table: pa.Table) -> pa.Table:
        component = table.column("component").to_numpy()
        texts = table.column("text").to_pylist()
        parts = [shingles(texts[i:j], size, powers) for i, j in runs_of_texts(texts, CHUNK_BYTES)]
        found, counts = (np.concatenate(x) for x in zip(*parts))
        common = common_shingles(found, counts)
        similar = (common > 0) & (100 * common >= percent * (counts[:, None] + counts[None, :] - common))
        a, b = np.nonzero(np.triu(similar, 1) & (component[:, None] != component[None, :]))
        used = _spanning(a, b, component)
        return pa.table({"a": pa.array(component[a[used]], pa.int64()), "b": pa.array(component[b[used]], pa.int64())})

    return linked


class _Corpus:
    """Classes of equal sets, and the texts of those that have candidates."""

    def __init__(self, documents: DataFrame, id_column: str, text_column: str, percent: int, size: int):
        self.percent, self.size = percent, size
        self.texts = documents.select(
            F.col(id_column).cast("long").alias("id"),
            F.coalesce(F.col(text_column).cast("binary"), F.lit("").cast("binary")).alias("text"),
        )
        schema = "id long, n_shingles long, key_1 long, key_2 long, bytes long, sketch binary"
        self.rows = written(self.texts.mapInArrow(_sketching(size), schema), "sketches")
        named = self.rows.where("id IS NOT NULL AND n_shingles > 0")
        self.classes = named.groupBy("key_1", "key_2").agg(F.min("id").alias("node"))
        sketched = named.groupBy("key_1", "key_2").agg(
            F.min("id").alias("node"), F.max("bytes").alias("bytes"), F.first("sketch").alias("sketch")
        )
        bands = sketched.mapInArrow(_banding(band_width(percent)), "band long, node long, bytes long")
        self.pairs, self.members = _paired_with_smallest(written(bands, "bands"))
        wanted = self.pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        self.texts = written(self.texts.join(wanted, "id", "left_semi").distinct(), "candidate-texts")

    def verified(self) -> DataFrame:
        """The links among the pairs."""
        one, other = self.texts.toDF("_a", "text_a"), self.texts.toDF("_b", "text_b")
        return (
            self.pairs.join(one, F.col("a") == F.col("_a"))
            .join(other, F.col("b") == F.col("_b"))
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(_verifying(self.percent, self.size), "a long, b long")
        )

    def across(self, labels: DataFrame) -> DataFrame:
        """Pairs of components with a link within a bucket that the pairs do not show."""
        placed = self.members.join(labels, F.col("node") == F.col("labelled"), "left").select(
            "band", "node", "bytes", F.coalesce("component", "node").alias("component")
        )
        blocks = F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("bytes") / BLOCK_BYTES)).cast("int")
        several = (
            placed.groupBy("band")
            .agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("members"), F.sum("bytes").alias("bytes"))
            .where("c1 <> c2")
            .select(F.col("band").alias("_band"), blocks.alias("blocks"))
        )
        several = written(several, "several")  # a join with it can be split where a bucket is large; sharing its exchange it could not
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        partners = F.sequence(F.lit(0), F.col("blocks") - 1)
        return (
            placed.join(several, F.col("band") == F.col("_band"))
            .select("band", "node", "component", block.alias("block"), F.explode(partners).alias("partner"))
            .select("band", "node", "component", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"))
            .join(self.texts, F.col("node") == F.col("id"))
            .groupBy("band", "low", "high")
            .applyInArrow(_comparing(self.percent, self.size), "a long, b long")
        )


def _paired_with_smallest(bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of each class with the smallest of its bucket, and the members of buckets of three or more."""
    buckets = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("members"))
    # Buckets and pairs are checkpoints, of a size that the planner does not know: what is large, band keys
    # and texts, is then joined with them by the same plan whatever the input's size.
    buckets = buckets.where("members > 1 AND low <> high").checkpoint()
    twos = buckets.where("members = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))
    larger = buckets.where("members > 2").select(F.col("band").alias("_band"), "low")
    members = bands.join(larger, F.col("band") == F.col("_band")).select("band", "node", "bytes", "low")
    members = written(members, "members")
    pairs = twos.union(members.select(F.col("node").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()
    return pairs.checkpoint(), members


def near_duplicates(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 85,
    shingle_words: int = SHINGLE_WORDS,
) -> DataFrame:
    """``id, n_shingles, component_id, kept``, one row per document.

    Documents are linked if ``100 * intersection >= percent * union`` of their shingle sets.
    """
    corpus = _Corpus(documents, id_column, text_column, percent, shingle_words)
    labels = components(corpus.verified()).toDF("labelled", "component")
    joined = components(corpus.across(labels)).toDF("part", "whole")
    classes = (
        corpus.classes.join(labels, F.col("node") == F.col("labelled"), "left")
        .select("key_1", "key_2", F.coalesce("component", "node").alias("component"))
        .join(joined, F.col("component") == F.col("part"), "left")
        .select(F.col("key_1").alias("_key_1"), F.col("key_2").alias("_key_2"), F.coalesce("whole", "component").alias("component"))
    )
    classes = written(classes, "classes")  # shares no exchange with the rows, so that a class of many copies can be split
    same = (F.col("key_1") == F.col("_key_1")) & (F.col("key_2") == F.col("_key_2")) & F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    return corpus.rows.join(classes, same, "left").select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )

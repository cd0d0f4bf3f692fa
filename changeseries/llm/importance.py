"""Importance resampling toward a target distribution, over hashed word runs.

Features of a text are its runs of one, two and three words; a feature's bucket is the CRC-32 of its bytes
modulo ``BUCKETS``. Each bucket has a gain, the logarithm of its share in the target over its share in
the pool; a document's weight is the sum of its features' gains. Documents are drawn without replacement by
adding seeded Gumbel noise to the weights and taking the highest.

CRC-32 is linear: the CRC of a text followed by a word is the first one's, shifted by the length of the
second, combined with the second's. So a feature's CRC never needs its bytes again:

* Head: the most frequent words of all documents are broadcast with their exact CRC states, and so are, for
  the first ``PAIR_WORDS`` of them, the states and buckets of all their pairs; both are bounded in number and
  bytes. A pair of them is one look into a table.
* Tail: any other word gets its CRC directly when a chunk first meets it, any other pair or triple by
  continuing the CRC of its beginning.

The head decides how fast a feature is hashed, never what its bucket is. It is found by one pass over all
documents in which tasks count words and send what is frequent with them.
Totals of all buckets are exact sums over all documents and over the target; tasks add up ``BUCKETS`` numbers each, and
the driver sees the same few. Ranks come from a range sort over (score, id), numbered within its
partitions and moved by the sizes of those before; equal rows are one row with a count until the end, so
copies without number do not gather in a partition.

Results for odd rows: null, empty and wordless texts have no features and weight 0. A document without an id
takes the noise of an empty one and comes after all others in ties. Repeated rows count each, in the
totals and in the draw, and get ranks of their own. Texts and words may be as long as they like. Without a
target, and without documents, all totals are 0. Only ids and texts are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeseries.llm.storage import written

BUCKETS = 10_000
RUN = 3
HEAD_WORDS, PAIR_WORDS, HEAD_BYTES = 65_536, 1_024, 32
COUNTED_WORDS = 400_000
CHUNK_BYTES = 4_000_000
LEAST_WORDS, DRAWN_PERCENT, SEED = 20, 5, 42
TABLE_LENGTHS = 64
POLYNOMIAL = 0xEDB88320

#: Bytes of words as they are, A-Z lower-cased, all others a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


# --- CRC arithmetic -----------------------------------------------------------------


def _shift_tables() -> np.ndarray:
    """``[length, place, byte]``: the byte at its place in a CRC, after ``length`` zero bytes more."""
    after_byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        after_byte = (after_byte >> np.uint32(1)) ^ np.where(after_byte & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [now]
    for _ in range(TABLE_LENGTHS):
        now = (now >> np.uint32(8)) ^ after_byte[now & np.uint32(255)]
        tables.append(now)
    return np.stack(tables)


class States:
    """What is known of some words: the CRC alone, that with a space before, and the length with the space."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self.spaced = np.fromiter((zlib.crc32(b" " + word) for word in words), np.uint32, len(words))
        self.length = np.fromiter((len(word) + 1 for word in words), np.int64, len(words))

    def with_(self, more: States) -> States:
        out = States([])
        out.words = self.words + more.words
        for name in ("crc", "spaced", "length"):
            setattr(out, name, np.concatenate((getattr(self, name), getattr(more, name))))
        return out


class Crc:
    """CRCs of word runs from the states of words."""

    def __init__(self):
        self.shift = _shift_tables().reshape(-1)

    def followed(self, crc: np.ndarray, states: States, word: np.ndarray) -> np.ndarray:
        """CRC of what ``crc`` stands for, a space, and the word."""
        length = states.length[word]
        base = np.minimum(length, TABLE_LENGTHS) * 1024
        shifted = self.shift[base + (crc & np.uint32(255))]
        for place in (1, 2, 3):
            shifted ^= self.shift[base + 256 * place + ((crc >> np.uint32(8 * place)) & np.uint32(255))]
        out = shifted ^ states.spaced[word]
        for i in np.flatnonzero(length > TABLE_LENGTHS).tolist():
            out[i] = zlib.crc32(b" " + states.words[word[i]], int(crc[i]))
        return out


class Head:
    """Broadcast: the frequent words' states, and states and buckets of the pairs of the most frequent."""

    def __init__(self, words: list[bytes]):
        self.states = States(words)
        few = min(len(words), PAIR_WORDS)
        first, second = np.repeat(np.arange(few), few), np.tile(np.arange(few), few)
        self.pairs = Crc().followed(self.states.crc[first], self.states, second).reshape(few, few)
        self.pair_buckets = (self.pairs % np.uint32(BUCKETS)).astype(np.uint16)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Features:
    """Buckets of all features of some texts; place ``i`` holds the run that begins at word ``i``.

    ``runs[k]`` are the buckets of runs of ``k + 1`` words, ``BUCKETS`` where the text ends before.
    """

    def __init__(self, texts: list[bytes], head: Head, numbers: _Numbers, crc: Crc):
        known = len(head.states.words)
        split = [words_of(text) for text in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(texts))
        total = int(self.counts.sum())
        word = np.fromiter((numbers[w] for words in split for w in words), np.int64, total)
        tail = list(numbers)[known:]
        states = head.states.with_(States(tail))
        for w in tail:
            del numbers[w]
        left = np.repeat(np.cumsum(self.counts), self.counts) - np.arange(total)
        state = states.crc[word]
        self.runs = [state % np.uint32(BUCKETS)]
        few = len(head.pairs)
        for size in range(2, RUN + 1):
            begins = np.flatnonzero(left >= size)
            last = word[begins + size - 1]
            buckets = np.full(total, BUCKETS, np.uint32)
            if size == 2 and few:
                frequent = (word[begins] < few) & (last < few)
                here, after = begins[frequent], last[frequent]
                next_state = np.zeros(total, np.uint32)
                next_state[here] = head.pairs[word[here], after]
                buckets[here] = head.pair_buckets[word[here], after]
                begins, last = begins[~frequent], last[~frequent]
            else:
                next_state = np.zeros(total, np.uint32)
            next_state[begins] = crc.followed(state[begins], states, last)
            buckets[begins] = next_state[begins] % np.uint32(BUCKETS)
            state = next_state
            self.runs.append(buckets)

    def n_features(self) -> np.ndarray:
        return sum(np.maximum(self.counts - size, 0) for size in range(RUN))

    def totals(self) -> np.ndarray:
        return sum(np.bincount(run, minlength=BUCKETS + 1)[:BUCKETS] for run in self.runs)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """Sum of gains of each text's features."""
        padded = np.append(gains, 0)
        sums = np.concatenate(([0], np.cumsum(sum(padded[run] for run in self.runs))))
        ends = np.cumsum(self.counts)
        return sums[ends] - sums[ends - self.counts]


def _chunks(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """Rows of about ``CHUNK_BYTES`` of text, with their texts."""
    for batch in batches:
        texts = [text.as_py() or b"" for text in batch.column(text_column)]
        first = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK_BYTES or i + 1 == len(texts):
                yield texts[first : i + 1], batch.slice(first, i + 1 - first)
                first, size = i + 1, 0


# --- the head -----------------------------------------------------------------------


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n``: this task's frequent words; rare ones are forgotten when memory would grow."""
    counts: Counter = Counter()
    for texts, _ in _chunks(batches, 0):
        for text in texts:
            counts.update(words_of(text))
        if len(counts) > COUNTED_WORDS:
            counts = Counter(dict(counts.most_common(COUNTED_WORDS // 4)))
    top = [(word, n) for word, n in counts.most_common(HEAD_WORDS) if len(word) <= HEAD_BYTES]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])


def head_of(texts: DataFrame) -> Head:
    """The frequent words of a table of one binary column."""
    counts = texts.mapInArrow(_counting, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    step = F.floor(F.log2("n") * 16)  # a few hundred at most
    counts = written(counts.withColumn("step", step), "word-counts")
    least = words = 0
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):
        words += row["count"]
        if words > HEAD_WORDS:
            least = row.step + 1
            break
    frequent = counts.where(F.col("step") >= least).collect()  # at most HEAD_WORDS rows
    return Head([bytes(row.word) for row in sorted(frequent, key=lambda row: (-row.n, row.word))])


# --- totals and weights -------------------------------------------------------------


def _totalling(head):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, numbers, sums = Crc(), _Numbers((w, i) for i, w in enumerate(head.value.states.words)), np.zeros(BUCKETS, np.int64)
        for texts, _ in _chunks(batches, 0):
            sums += Features(texts, head.value, numbers, crc).totals()
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(sums[there], pa.int64())], ["bucket", "n"])

    return total


def bucket_totals(texts: DataFrame, head) -> np.ndarray:
    """How many features of a table of one binary column fall into each bucket."""
    summed = texts.mapInArrow(_totalling(head), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(BUCKETS, np.int64)
    for row in summed.collect():  # at most BUCKETS rows
        totals[row.bucket] = row.n
    return totals


def gains_of(pool: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(share in the target / share in the pool))``, one occurrence added to each bucket."""
    s, t = pool.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighing(head, gains: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, numbers = Crc(), _Numbers((w, i) for i, w in enumerate(head.value.states.words))
        for texts, rows in _chunks(batches, 1):
            features = Features(texts, head.value, numbers, crc)
            columns = (features.counts, features.n_features(), features.weights(gains))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["id", "n_words", "n_features", "weight"])

    return weigh


# --- the draw -----------------------------------------------------------------------


def gumbel(identity: Column, seed: int) -> Column:
    """Whole thousandths of seeded Gumbel noise."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, quota: int) -> DataFrame:
    """``scored`` with ``rank``: 1 to ``quota`` by falling score, then rising id, for the rows that are ``eligible``."""
    columns = scored.columns
    copies = scored.where("eligible").groupBy(*columns).agg(F.count("*").alias("_copies"))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(copies.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.sum("_copies").alias("_rows"))  # one row a partition
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(up_to), F.lit(0)).alias("_before"))
    placed = ranged.join(offsets, "_part")
    within = Window.partitionBy("_part").orderBy(*order, "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.where(F.col("_before") < quota).withColumn("_before", F.col("_before") + F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    all_ = first.unionByName(placed.where(F.col("_before") >= quota))
    each = all_.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    rank = F.col("_before") + F.col("_copy")
    out = each.select(*columns, F.when(rank <= quota, rank).alias("rank"))
    return out.unionByName(scored.where(~F.col("eligible")).withColumn("rank", F.lit(None).cast("long")))


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = DRAWN_PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
) -> DataFrame:
    """``id, n_features, weight, score, rank``, one row per document; ``rank`` is null for those that are not drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    head = documents.sparkSession.sparkContext.broadcast(head_of(rows.select("text")))
    wanted = target.select(F.col(target_column).cast("binary").alias("text"))
    gains = gains_of(bucket_totals(rows.select("text"), head), bucket_totals(wanted, head))
    weighed = rows.mapInArrow(_weighing(head, gains), "id long, n_words long, n_features long, weight long")
    score = F.col("weight") + gumbel(F.col("id"), seed)
    scored = written(
        weighed.select("id", "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("eligible")), "weights"
    )
    quota = percent * scored.where("eligible").count() // 100
    return ranked(scored, quota).select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")

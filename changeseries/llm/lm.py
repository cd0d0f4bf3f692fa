"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words (lower-cased A-Z) and an end, each spelled as bytes with a closing
space; the end is a closing space at once. Every byte is eight binary
decisions. For each decision several predictors look up counts of zeros and ones in a
hash table, under the last 1, 2, 3, 4 and 6 bytes of the word and the bits of the byte
so far. Their log-odds are added up with weights chosen by a gate (the longest context seen
before, and which bit it is); the sum is refined by an adaptive map from (bits
so far, sum) to what really followed. Products of all decisions make a probability
distribution over texts, so the score is the text's log10 probability, and its total bits
per byte follow from it.

Training is spread over the cluster in passes over the vocabulary, whose
counts are summed over all training documents:

* Counts of the predictors are added up over tasks in 64 bits. The tables have ``TABLE_BITS``, as a bit predictor's hash
  tables have: what is broadcast is bounded, contexts share slots the more the larger the vocabulary is, and the gates
  and weights are learned on the tables as they are. What is gathered, counts of words, pairs and triples, grows with the corpus.
* Weights are learned online, word block by word block, by gradient steps on the coding
  error, predicting each word as if one occurrence of it had not been seen. The vocabulary is split by a hash of the
  word into parts that follow from the corpus alone; parts start alike and their weights are averaged by the
  occurrences behind them, so the cluster has no say in the result. The map's counts are added up.

Words of a block that begin alike share their decisions; a decision is computed once, with the weight of all of them.

A word's spelling has one probability, computed once. In its place in a text it is mixed with
what followed the word before it, and with what followed the two words before it, in all training texts, each a probability
over words. The three weights are chosen by a gate, how often either context was seen, and add up to 1, so the
sum over all words stays 1. They are learned from the training texts of each batch of documents, each word predicted
as if it had not been seen, from first weights in which a context weighs as much as its count against ``CONTEXT_PRIORS``.
Mixing bits under contexts that cross words would take eight decisions for every byte of every text, not of every different
word: at 0.3 millionths of a second each, 2.4 CPU seconds a MB of text.

Documents get the counts and spelling probabilities of their words, and the counts of their pairs and triples
of words, by two exchanges between batches and buckets (see ``batches``). In the first a batch sends a short key of each different
pair and triple and learns with a bit which ones other batches hold; the counts of all others it knows itself. In the
second it sends longer keys of the former, with its own counts, and hashes of its words. Words go by 64-bit hashes: two words
of ten million share one with a chance under one in 300,000. Pairs and triples go by as many bits as
leave a pair or triple four chances in a million to be taken for another, whatever the input (``FURTHER_BITS``).
Logarithms of spelling probabilities are rounded to a millionth (``SCORE_STEPS``) where they are sent.

Results for odd rows: null text counts as empty, which is the end alone. A row without an id is
trained on and not held out. Repeated rows count each. Texts are whole. An empty table gives an empty result.
Without training rows every count is 0 and predictors are even. Only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeseries.llm.batches import (
    BUCKET_BYTES,
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
from changeseries.llm.storage import release, written
from changeseries.llm.wordhash import SEED_1, SEED_2, STEP, Powers, Words, mixed, runs_of_texts

ORDERS = (1, 2, 3, 4, 6)
TABLE_BITS = 20
SLICES = 16
PRIOR = np.float32(0.4)
RATE = 0.02
GATES = (len(ORDERS) + 1) * 8
MAP_STEPS = 24
MAP_RANGE = 12.0
MAP_PRIOR = 20.0

CONTEXT_PRIORS = (300.0, 30.0)
COUNT_CLASSES = 12
GATE_PRIOR = 20.0
GATE_ROUNDS = 4
TEXT_START, TEXT_END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

WORDS_PER_BLOCK = 4_000
WORDS_PER_PART = 40_000
LM_BATCH_BYTES = 8_000_000
COUNTED_WORDS = 300_000
CHUNK_BYTES = 500_000
SPACES = b" \t\n\x0b\x0c\r"
FOLDS, HELD_OUT_FOLD = 7, 2


def held_out(identity: Column) -> Column:
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


# --- the vocabulary -----------------------------------------------------------------


def _counting(parts: int):
    """``part, payload``: training occurrences of every word of all documents, added up as far as memory allows, sorted and packed."""

    def counted(trained: Counter, seen: set, ends: int) -> pa.RecordBatch:
        trained = Counter(trained)
        if ends:
            trained[b""] = ends
        split: list[list[bytes]] = [[] for _ in range(parts)]
        for token in seen | trained.keys():
            split[zlib.crc32(token) % parts].append(token)
        compressor, rows = zstandard.ZstdCompressor(level=1), []
        for part, tokens in enumerate(split):
            if tokens:
                tokens.sort()
                counts = np.fromiter((trained[t] for t in tokens), np.uint64, len(tokens))
                rows.append((part, joined(compressor.compress(b"\n".join(tokens)), packed(counts))))
        numbers, payloads = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(payloads, pa.binary())], ["part", "payload"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, seen, ends = Counter(), set(), 0
        for batch in batches:
            for text, training in zip(batch.column(0), batch.column(1).to_pylist()):
                found = _words(text.as_py() or b"")
                if training:
                    trained.update(found)
                    ends += 1
                else:
                    seen.update(found)
                if len(trained) + len(seen) > COUNTED_WORDS:
                    yield counted(trained, seen, ends)
                    trained, seen, ends = Counter(), set(), 0
        yield counted(trained, seen, ends)

    return count


VOCABULARY = "n long, different long, tokens binary, counts binary"


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``VOCABULARY`` of one part of the words, over all tasks: rows of ``WORDS_PER_PART`` words in their order."""
    total: dict[bytes, int] = {}
    for batch in batches:
        for payload in batch.column(1):
            tokens, counts = parted(payload.as_py())
            tokens = zstandard.ZstdDecompressor().decompress(tokens).split(b"\n")
            for token, n in zip(tokens, unpacked(counts).tolist()):
                total[token] = total.get(token, 0) + n
    tokens, compressor = sorted(total), zstandard.ZstdCompressor(level=1)
    for first in range(0, len(tokens), WORDS_PER_PART):
        some = tokens[first : first + WORDS_PER_PART]
        counts = np.fromiter((total[t] for t in some), np.uint64, len(some))
        columns = [int(counts.sum()), int((counts > 0).sum()), compressor.compress(b"\n".join(some)), packed(counts)]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = [column.split()[0] for column in VOCABULARY.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(columns, kinds)], names)


def vocabulary(texts: DataFrame, parts: int) -> DataFrame:
    """Every word of the whole table, the end as the empty one, and its training count, packed as ``VOCABULARY``.

    How words are dealt into rows follows from the words alone.
    """
    counted = texts.mapInArrow(_counting(parts), "part long, payload binary")
    return counted.groupBy("part").applyInArrow(_counted_words, VOCABULARY)


def _unpacked_words(batch: pa.RecordBatch, trained_only: bool) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and counts of each row."""
    for tokens, counts in zip(batch.column(2), batch.column(3)):
        tokens, counts = zstandard.ZstdDecompressor().decompress(tokens.as_py()).split(b"\n"), unpacked(counts.as_py()).astype(np.float64)
        if trained_only:
            keep = np.flatnonzero(counts > 0)
            tokens, counts = [tokens[i] for i in keep], counts[keep]
        yield tokens, counts


# --- spelling -----------------------------------------------------------------------


class Spelling:
    """Different beginnings of some tokens: their last byte and the hashes of their contexts.

    ``symbol, contexts`` have an entry for each different beginning; ``beginning`` names that of each symbol of
    all tokens in a row, and ``token`` the token it belongs to.
    """

    def __init__(self, tokens: list[bytes], powers: Powers):
        spelled = b" " + b" ".join(tokens) + b" "
        symbols = np.frombuffer(spelled, np.uint8)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        self.token = np.repeat(np.arange(len(tokens)), lengths)
        begins = (np.cumsum(lengths) - lengths)[self.token]
        self.ends = np.cumsum(lengths)
        at = np.arange(1, len(symbols))
        up, down = powers.get(len(symbols) + 1)
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=sums[1:])
        spans = mixed((sums[at + 1] - sums[begins]) * down[begins])
        order = np.argsort(spans)
        firsts, run = groups(spans[order])
        self.beginning = np.empty(len(order), np.int64)
        self.beginning[order] = run
        at, begins = at[order[firsts]], begins[order[firsts]]
        self.symbol = symbols[at]
        self.contexts = []
        for length in ORDERS:
            first = np.maximum(begins, at - length)
            self.contexts.append(mixed((sums[at] - sums[first]) * down[first] + np.uint64(length)))

    def summed(self, of_tokens: np.ndarray) -> np.ndarray:
        """Per beginning the sum of a value over the tokens that have it."""
        return np.bincount(self.beginning, of_tokens[self.token], len(self.symbol))

    def per_token(self, of_beginnings: np.ndarray) -> np.ndarray:
        """Per token the sum of a value over its beginnings."""
        sums = np.concatenate(([0.0], np.cumsum(of_beginnings[self.beginning])))
        return sums[self.ends] - sums[np.concatenate(([0], self.ends[:-1]))]

    def decisions(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each of eight bits: its number, the bits so far, the bit, and the slots of its predictors."""
        node, shift = np.ones(len(self.symbol), np.int64), np.uint64(64 - TABLE_BITS)
        for level in range(8):
            bit = (self.symbol >> (7 - level)) & 1
            salt = node.astype(np.uint64) * SEED_1
            yield level, node, bit, [((c + salt) >> shift).astype(np.int64) for c in self.contexts]
            node = node * 2 + bit


def _block(tokens: list[bytes], counts: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for first in range(0, len(tokens), WORDS_PER_BLOCK):
        yield tokens[first : first + WORDS_PER_BLOCK], counts[first : first + WORDS_PER_BLOCK]


def _blocks(batches: Iterator[pa.RecordBatch], trained_only: bool) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for batch in batches:
        for tokens, counts in _unpacked_words(batch, trained_only):
            yield from _block(tokens, counts)


# --- counts of the predictors -------------------------------------------------------


def _tallying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, tally``: this task's counts, cut into slices of the tables."""
    size, powers = 1 << TABLE_BITS, Powers()
    tables = np.zeros((len(ORDERS), size, 2), np.int64)
    flat, any_word = tables.reshape(len(ORDERS), -1), False
    for tokens, counts in _blocks(batches, trained_only=True):
        any_word = True
        spelling = Spelling(tokens, powers)
        weight = np.rint(spelling.summed(counts)).astype(np.int64)
        for _, _, bit, slots in spelling.decisions():
            for order, slot in enumerate(slots):
                np.add.at(flat[order], slot * 2 + bit, weight)
    compressor = zstandard.ZstdCompressor(level=1)
    rows = []
    if any_word:
        for order in range(len(ORDERS)):
            for number, part in enumerate(np.split(tables[order], SLICES)):
                rows.append((order * SLICES + number, compressor.compress(np.ascontiguousarray(part.reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes())))
    parts, tallies = zip(*rows) if rows else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(tallies, pa.binary())], ["part", "tally"])


def _tally(content: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(content), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(-1, 2)


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the tallies of one part as they arrive."""
    total, part = None, None
    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else part
        for content in batch.column(1):
            tally = _tally(content.as_py())
            total = tally if total is None else total + tally
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "tally"])


def predictor_counts(words: DataFrame) -> np.ndarray:
    """``[order, slot, bit]``: the summed tables, of a size that ``TABLE_BITS`` fixes."""
    summed = words.mapInArrow(_tallying, "part int, tally binary").groupBy("part").applyInArrow(_summing, "part int, tally binary")
    tables = np.zeros((len(ORDERS) * SLICES, (1 << TABLE_BITS) // SLICES, 2), np.float32)
    for row in summed.toLocalIterator():
        tables[row.part] = np.frombuffer(row.tally, np.float32).reshape(-1, 2)
    return tables.reshape(len(ORDERS), -1, 2)


# --- mixing -------------------------------------------------------------------------


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def first_weights() -> np.ndarray:
    """``[gate, input]``: the longest known context counts most; the last input is constant."""
    weights = np.zeros((GATES, len(ORDERS) + 1))
    for known in range(len(ORDERS) + 1):
        weights[known * 8 : known * 8 + 8, :known] = 0.2
        if known:
            weights[known * 8 : known * 8 + 8, known - 1] = 0.6
    return weights


def _map_place(node: np.ndarray, odds: np.ndarray) -> np.ndarray:
    step = np.clip((odds + MAP_RANGE) * (MAP_STEPS / (2 * MAP_RANGE)), 0, MAP_STEPS - 1).astype(np.int64)
    return node * MAP_STEPS + step


def _learning(tables):
    """``place, value, weight``: weighted weights of this task, then the counts of its map."""

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, counts in _unpacked_words(batch, trained_only=True):
                yield from of_part(tokens, counts)

    def of_part(words: list[bytes], counts_of: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat, powers, weights = tables.value.reshape(len(ORDERS), -1), Powers(), first_weights()
        seen, mapped = np.zeros(GATES), np.zeros((256 * MAP_STEPS, 2))
        for tokens, counts in _block(words, counts_of):
            spelling = Spelling(tokens, powers)
            weight = spelling.summed(counts)
            for level, node, bit, slots in spelling.decisions():
                inputs, known = np.ones((len(ORDERS) + 1, len(bit))), np.zeros(len(bit), np.int64)
                for order, slot in enumerate(slots):
                    happened = flat[order][slot * 2 + bit] - np.float32(1)
                    other = flat[order][slot * 2 + 1 - bit]
                    odds = np.log((happened + PRIOR) / (other + PRIOR))
                    inputs[order] = np.where(bit == 1, odds, -odds)
                    known += happened + other > 0
                gate = known * 8 + level
                odds = _mixed_odds(weights, gate, inputs)
                mapped_at = _map_place(node, odds)
                mapped[:, 0] += np.bincount(mapped_at, weight * bit, len(mapped))
                mapped[:, 1] += np.bincount(mapped_at, weight, len(mapped))
                error = weight * (bit - squash(odds))
                there = np.bincount(gate, weight, GATES)
                for i in range(len(inputs)):
                    weights[:, i] += RATE * np.bincount(gate, error * inputs[i], GATES) / np.maximum(there, 1e-9)
                seen += there
        values = np.concatenate(((weights * seen[:, None]).ravel(), mapped.ravel()))
        shares = np.concatenate((np.repeat(seen, weights.shape[1]), np.ones(mapped.size)))
        places = pa.array(np.arange(len(values), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([places, pa.array(values), pa.array(shares)], ["place", "value", "share"])

    return learned


def _mixed_odds(weights: np.ndarray, gate: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    odds = weights[:, 0][gate] * inputs[0]
    for i in range(1, len(inputs)):
        odds += weights[:, i][gate] * inputs[i]
    return odds


def mixing_state(words: DataFrame, tables) -> tuple[np.ndarray, np.ndarray]:
    """Averaged weights ``[gate, input]`` and the refining map's log-odds ``[bits so far, step]``."""
    state = words.mapInArrow(_learning(tables), "place int, value double, share double").groupBy("place").agg(
        F.sum("value").alias("value"), F.sum("share").alias("share")
    )
    weights, size = first_weights(), first_weights().size
    values, shares = np.zeros(size + 512 * MAP_STEPS), np.zeros(size + 512 * MAP_STEPS)
    for row in state.collect():
        values[row.place], shares[row.place] = row.value, row.share
    weights = np.where(shares[:size] > 0, values[:size] / np.maximum(shares[:size], 1e-9), weights.ravel()).reshape(weights.shape)
    ones, all_ = values[size:].reshape(256 * MAP_STEPS, 2).T
    middle = ((np.arange(MAP_STEPS) + 0.5) * (2 * MAP_RANGE / MAP_STEPS) - MAP_RANGE)[None, :].repeat(256, 0).ravel()
    share = (ones + MAP_PRIOR * squash(middle)) / (all_ + MAP_PRIOR)
    return weights, np.log(share / (1 - share))


def _log_probabilities(tokens: list[bytes], odds_of: np.ndarray, known_of: np.ndarray, weights: np.ndarray, refined: np.ndarray, powers: Powers) -> np.ndarray:
    """Natural logarithm of each token's probability."""
    spelling = Spelling(tokens, powers)
    total = np.zeros(len(spelling.symbol))
    for level, node, bit, slots in spelling.decisions():
        inputs, known = np.ones((len(ORDERS) + 1, len(bit))), np.zeros(len(bit), np.int64)
        for order, slot in enumerate(slots):
            inputs[order] = odds_of[order][slot]
            known += known_of[order][slot]
        odds = _mixed_odds(weights, known * 8 + level, inputs)
        one = (squash(odds) + squash(refined[_map_place(node, odds)])) / 2
        total += np.log(np.where(bit == 1, one, 1 - one))
    return spelling.per_token(total)


def _scoring(tables, weights: np.ndarray, refined: np.ndarray, bits: int):
    """Buckets of scored words: tokens, counts and log10 probabilities of each block."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of, powers = tables.value, Powers()
        odds_of = np.log((counts_of[:, :, 1] + PRIOR) / (counts_of[:, :, 0] + PRIOR))
        known_of = counts_of.sum(axis=2) > 0
        for tokens, counts in _blocks(batches, trained_only=False):
            scores = _log_probabilities(tokens, odds_of, known_of, weights, refined, powers) / np.log(10)
            real = np.array([i for i, t in enumerate(tokens) if t], np.int64)
            hashes = Words([b"\n".join(tokens)], powers).hashes
            order = np.argsort(hashes)
            counts_there, scores_there, hashes = counts[real][order].astype(np.uint64), np.rint(-scores[real][order] * SCORE_STEPS).astype(np.uint64), hashes[order]
            rows = [
                (bucket, -1, 0, joined(packed_sorted(hashes[i:j]), packed(counts_there[i:j]), packed(scores_there[i:j])))
                for bucket, i, j in bucket_slices(hashes, bits)
            ]
            rows += [(-1, -1, 1, np.array([counts[i], scores[i]]).tobytes()) for i, t in enumerate(tokens) if not t]
            yield messages(rows).to_batches()[0]

    return scored


# --- documents ----------------------------------------------------------------------


FURTHER_BITS = 15
SCORE_STEPS = float(1 << 20)
SHORT, WORDS, WORD_ANSWERS, ELSEWHERE, COUNTS, COUNT_ANSWERS, NOTE = range(1, 8)


def short_bits(bucket: int) -> int:
    """Bits of a short key beside those that name its bucket: some eight places for each pair and triple of a bucket's text."""
    return max(8, (2 * bucket - 1).bit_length())


def _different(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[groups(values)[0]]


class _BatchWords:
    """The words of a batch, and the keys of its pairs and triples: a text is its words and an end, the first follows a start."""

    def __init__(self, texts: list[bytes], key_bits: int = 64):
        powers, hashes, self.counts = Powers(), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for first, end in runs_of_texts(texts, CHUNK_BYTES):
            words = Words(texts[first:end], powers, lower=True)
            hashes.append(words.hashes)
            self.counts.append(words.counts())
        self.counts = np.concatenate(self.counts)
        self.hashes = np.concatenate(hashes)
        self.end_at = np.cumsum(self.counts + 1) - 1
        self.first_at = self.end_at - self.counts
        self.is_word = np.ones(len(self.hashes) + len(texts), bool)
        self.is_word[self.end_at] = False
        self.later = np.ones(len(self.is_word), bool)
        self.later[self.first_at] = False
        token = np.full(len(self.is_word), TEXT_END)
        token[self.is_word] = self.hashes
        before = self.shifted(token, TEXT_START)
        pairs = before * STEP + token
        triples = (self.shifted(before, TEXT_START) * STEP + before) * STEP + token
        left_out = np.uint64(64 - key_bits)
        self.keys = np.concatenate((mixed(pairs), mixed(triples[self.later], SEED_2))) >> left_out << left_out

    def shifted(self, values: np.ndarray, at_first) -> np.ndarray:
        """The value of the token before each; ``at_first`` for the first of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first_at] = at_first
        return out

    def held(self, training: np.ndarray) -> np.ndarray:
        """Which entries of ``keys`` are of training texts."""
        of_token = np.repeat(training, self.counts + 1)
        return np.concatenate((of_token, of_token[self.later]))

    def different_keys(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs and triples, sorted, and how often the training texts hold each."""
        held = np.sort(self.keys[self.held(training)])
        firsts = groups(held)[0]
        different = _different(self.keys)
        trained = np.zeros(len(different), np.uint64)
        trained[np.searchsorted(different, held[firsts])] = np.diff(np.append(firsts, len(held)))
        return different, trained

    def in_context(self, counts: np.ndarray, spelled: np.ndarray, key_counts: np.ndarray, end: tuple[float, float], training: np.ndarray, rounds: int) -> np.ndarray:
        """log10 probability of each text, from training counts and log10 spelling probabilities of its words and counts of its keys."""
        n, single, scores = len(self.is_word), np.full(len(self.is_word), end[0]), np.full(len(self.is_word), end[1])
        single[self.is_word], scores[self.is_word] = counts, spelled
        pairs, triples = key_counts[:n], np.zeros(n)
        triples[self.later] = key_counts[n:]
        before_one = self.shifted(single, end[0])
        before_two = np.where(self.later, self.shifted(pairs, 0.0), 0.0)
        scores *= np.log(10)
        own = np.repeat(training, self.counts + 1)
        learn = [a[own] for a in (scores, pairs, before_one, triples, before_two)]
        weights = learned_gates(*learn, rounds=rounds)
        return np.add.reduceat(gated(scores, pairs, before_one, triples, before_two, weights), self.first_at) / np.log(10)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and the place of each value among them."""
    order = np.argsort(values)
    firsts, run = groups(values[order])
    place = np.empty(len(order), np.int64)
    place[order] = run
    return values[order[firsts]], place


def count_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 0) + 1), COUNT_CLASSES - 1).astype(np.int64)


def first_gates() -> np.ndarray:
    """``[gate, predictor]``: weights of spelling, pair and triple; those of a context that was never seen are 0."""
    seen = np.where(np.arange(COUNT_CLASSES) > 0, 2.0 ** np.arange(COUNT_CLASSES), 0.0)
    pair, triple = np.meshgrid(seen / (seen + CONTEXT_PRIORS[0]), seen / (seen + CONTEXT_PRIORS[1]), indexing="ij")
    return np.stack([(1 - triple) * (1 - pair), (1 - triple) * pair, triple], axis=-1).reshape(-1, 3)


def _shares(pairs: np.ndarray, before_one: np.ndarray, triples: np.ndarray, before_two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gate, and the probabilities by pair and by triple."""
    gate = count_class(before_one) * COUNT_CLASSES + count_class(before_two)
    return gate, pairs / np.maximum(before_one, 1), triples / np.maximum(before_two, 1)


def learned_gates(scores: np.ndarray, pairs: np.ndarray, before_one: np.ndarray, triples: np.ndarray, before_two: np.ndarray, rounds: int) -> np.ndarray:
    """Weights under which training words, each left out of its own counts, are most probable; near the first ones where there are few."""
    first = first_gates()
    less = [np.maximum(a - 1, 0) for a in (pairs, before_one, triples, before_two)]
    gate, by_pair, by_triple = _shares(*less)
    weights, of = first.copy(), (np.exp(scores), by_pair, by_triple)
    for _ in range(rounds):
        parts = [weights[:, i][gate] * of[i] for i in range(3)]
        total = parts[0] + parts[1] + parts[2]
        total[total <= 0] = 1
        sums = np.stack([np.bincount(gate, part / total, len(weights)) for part in parts], axis=-1) + GATE_PRIOR * first
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def gated(scores: np.ndarray, pairs: np.ndarray, before_one: np.ndarray, triples: np.ndarray, before_two: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability; logarithms, as long words have tiny ones."""
    gate, by_pair, by_triple = _shares(pairs, before_one, triples, before_two)
    with np.errstate(divide="ignore"):
        spelling = np.log(weights[:, 0])[gate] + scores
        found = weights[:, 1][gate] * by_pair + weights[:, 2][gate] * by_triple
        there = np.flatnonzero(found)
        spelling[there] = np.logaddexp(spelling[there], np.log(found[there]))
    return spelling


def _asking_shortly(bits: int, more: int):
    def ask(table: pa.Table) -> pa.Table:
        batch, keys = table.column("batch")[0].as_py(), _different(_BatchWords(table.column("text").to_pylist(), bits + more + FURTHER_BITS).keys)
        return messages([(b, batch, SHORT, packed_sorted(_short_keys(keys[i:j], bits, more))) for b, i, j in bucket_slices(keys, bits)])

    return ask


def _short_keys(keys: np.ndarray, bits: int, more: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits - more)) & np.uint64((1 << more) - 1)


def _answering_shortly(asked: pa.Table) -> pa.Table:
    """For each short key of each batch: does another entry have it."""
    sent = [unpacked_sorted(p) for p in asked.column("payload").to_pylist()]
    everything = np.sort(np.concatenate(sent))
    twice = _different(everything[1:][everything[1:] == everything[:-1]])
    rows = []
    for bucket, batch, keys in zip(asked.column("bucket").to_pylist(), asked.column("batch").to_pylist(), sent):
        at = np.minimum(np.searchsorted(twice, keys), max(len(twice) - 1, 0))
        rows.append((bucket, batch, ELSEWHERE, packed_bits(twice[at] == keys if len(twice) else np.zeros(len(keys), bool))))
    return messages(rows)


def _payloads(table: pa.Table, kind: int) -> dict[int, bytes]:
    columns = [table.column(c).to_pylist() for c in ("bucket", "kind", "payload")]
    return {bucket: payload for bucket, k, payload in zip(*columns) if k == kind}


def _elsewhere(keys: np.ndarray, bits: int, found: dict[int, bytes]) -> np.ndarray:
    """Which of the batch's keys other batches may hold."""
    out = np.zeros(len(keys), bool)
    for bucket, i, j in bucket_slices(keys, bits):
        out[i:j] = unpacked_bits(found[bucket])
    return out


def _asking(bits: int, more: int):
    key_bits = bits + more + FURTHER_BITS

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return messages([])
        batch, words = table.column("batch")[0].as_py(), _BatchWords(table.column("text").to_pylist(), key_bits)
        different = _different(words.hashes)
        rows = [(b, batch, WORDS, packed_sorted(different[i:j])) for b, i, j in bucket_slices(different, bits)]
        keys, trained = words.different_keys(table.column("training").to_numpy())
        elsewhere = _elsewhere(keys, bits, _payloads(answers, ELSEWHERE))
        asked, own = keys[elsewhere], trained[elsewhere]
        rows += [(b, batch, COUNTS, joined(packed_sorted(asked[i:j] >> np.uint64(64 - key_bits)), packed(own[i:j]))) for b, i, j in bucket_slices(asked, bits)]
        return messages([*rows, (-1 - batch, batch, NOTE, packed_bits(elsewhere))])

    return ask


def _answering(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Counts and scores of the words, and counts of the pairs and triples, that each batch asks for, in its order."""
    asks = list(zip(*[asked.column(c).to_pylist() for c in ("bucket", "batch", "kind", "payload")]))
    notes = [a for a in asks if a[2] == NOTE]
    return messages(notes + _answered_words([a for a in asks if a[2] == WORDS], known) + _answered_keys([a for a in asks if a[2] == COUNTS]))


def _answered_keys(asks: list[tuple]) -> list[tuple]:
    """The training counts of all batches added up."""
    if not asks:
        return []
    parts = [parted(a[3]) for a in asks]
    keys = [unpacked_sorted(p[0]) for p in parts]
    ends = np.cumsum([len(k) for k in keys])
    different, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(different), np.uint64)
    np.add.at(sums, place, np.concatenate([unpacked(p[1]) for p in parts]))
    return [(bucket, batch, COUNT_ANSWERS, packed(sums[place[end - len(k) : end]])) for (bucket, batch, *_), k, end in zip(asks, keys, ends)]


def _answered_words(asks: list[tuple], known: pa.Table) -> list[tuple]:
    if not asks:
        return []
    parts = [parted(p) for p in known.column("payload").to_pylist()]
    hashes = np.concatenate([unpacked_sorted(p[0]) for p in parts])
    order = np.argsort(hashes)
    hashes, counts, scores = hashes[order], *(np.concatenate([unpacked(p[i]) for p in parts])[order] for i in (1, 2))
    rows = []
    for bucket, batch, _, payload in asks:
        at = np.searchsorted(hashes, unpacked_sorted(payload))
        rows.append((bucket, batch, WORD_ANSWERS, joined(packed(counts[at]), packed(scores[at]))))
    return rows


def _adding(bits: int, more: int, end: tuple[float, float], rounds: int):
    def add(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, training = table.column("text").to_pylist(), table.column("training").to_numpy()
        words = _BatchWords(texts, bits + more + FURTHER_BITS)
        different, place = _numbered(words.hashes)
        counts, scores, found = np.zeros(len(different)), np.zeros(len(different)), _payloads(answers, WORD_ANSWERS)
        for bucket, i, j in bucket_slices(different, bits):
            there = parted(found[bucket])
            counts[i:j] = unpacked(there[0])
            scores[i:j] = unpacked(there[1]) / -SCORE_STEPS
        counts, scores = counts[place], scores[place]
        keys, place = _numbered(words.keys)
        key_counts = np.bincount(place, words.held(training), len(keys))
        elsewhere = unpacked_bits(next(iter(_payloads(answers, NOTE).values())))
        asked, found = keys[elsewhere], _payloads(answers, COUNT_ANSWERS)
        sums = np.zeros(len(asked))
        for bucket, i, j in bucket_slices(asked, bits):
            sums[i:j] = unpacked(found[bucket])
        key_counts[elsewhere] = sums
        ends = np.cumsum(words.counts)

        def per_text(values: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0.0], np.cumsum(values)))
            return total[ends] - total[ends - words.counts]

        return pa.table(
            {
                "id": table.column("id"),
                "n_tokens": pa.array(words.counts + 1, pa.int64()),
                "n_known": pa.array(per_text(counts > 0).astype(np.int64) + (end[0] > 0), pa.int64()),
                "smoothed": pa.array(per_text(np.log10(counts + 1)) + np.log10(end[0] + 1), pa.float64()),
                "score": pa.array(words.in_context(counts, scores, key_counts[place], end, training, rounds), pa.float64()),
                "n_bytes": pa.array([len(t.translate(None, SPACES)) for t in texts] + words.counts + 1, pa.int64()),
            }
        )

    return add


def score_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", gate_rounds: int = GATE_ROUNDS) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``, one row per document.

    ``gate_rounds`` are the passes in which a batch learns the weights of its words' contexts; with none the first weights stay.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    training = rows.select(F.col("text").cast("binary").alias("text"), (~held_out(F.col("id"))).alias("training"))
    texts, bits = batched(rows, "id", "text", least_batch=LM_BATCH_BYTES)
    texts = texts.withColumn("training", ~held_out(F.col("id")))
    words = written(vocabulary(training, 1 << bits), "vocabulary")
    release(spark)
    total, different = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()

    tables = spark.sparkContext.broadcast(predictor_counts(words))
    weights, refined = mixing_state(words, tables)
    scored = written(words.mapInArrow(_scoring(tables, weights, refined, bits), MESSAGE), "scored-words")
    end = scored.where("kind = 1").first()
    end_count, end_score = np.frombuffer(end.payload) if end else (0.0, 0.0)

    release(spark)
    by_batch = texts.groupBy("batch")
    more = short_bits(BUCKET_BYTES)
    shortly = by_batch.applyInArrow(_asking_shortly(bits, more), MESSAGE)
    elsewhere = shortly.groupBy("bucket").applyInArrow(_answering_shortly, MESSAGE)
    asked = by_batch.cogroup(elsewhere.groupBy("batch")).applyInArrow(_asking(bits, more), MESSAGE)
    answers = asked.groupBy("bucket").cogroup(scored.where("kind = 0").groupBy("bucket")).applyInArrow(_answering, MESSAGE)
    summed = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(
        _adding(bits, more, (float(end_count), float(end_score)), gate_rounds),
        "id long, n_tokens long, n_known long, smoothed double, score double, n_bytes long",
    )
    return summed.select(
        F.col("id").alias(id_column),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("smoothed") - F.col("n_tokens") * float(np.log10(total + different + 1))).alias("base_score"),
        "score",
        (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )

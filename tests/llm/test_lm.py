import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, words

from changeseries.llm import batches, lm
from changeseries.llm.wordhash import Powers


def base(rows):
    """Columns of the base score by the definition, one tuple per row."""
    tokens = [[w.lower() for w in words(r[1])] + [None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    counts = Counter(t for own, out in zip(tokens, held) if not out for t in own)
    total, different = sum(counts.values()), len(counts)
    return [
        (str(r[0]), out, len(own), sum(counts[t] > 0 for t in own), total, pytest.approx(sum(math.log10((counts[t] + 1) / (total + different + 1)) for t in own)))
        for r, own, out in zip(rows, tokens, held)
    ]


def run(spark, rows):
    return lm.score_documents(documents(spark, rows)).collect()


def check(spark, rows):
    got = run(spark, rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == sorted(base(rows), key=lambda t: t[:5])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    return got


def corpus(seed, n=150):
    rng = random.Random(seed)
    syllables = ["the", "in", "Ge", "é", "ou", "st", "a", "7", " ", "Ω"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(300)]
    return [(i, rng.choice([" ", "\n", "\t"]).join(rng.choices(vocabulary, range(300, 0, -1), k=rng.randrange(80)))) for i in range(n)]


def test_base_columns_equal_brute_force(spark, monkeypatch):
    check(spark, corpus(1))
    monkeypatch.setattr(lm, "LM_BATCH_BYTES", 3_000)
    monkeypatch.setattr(batches, "MESSAGE_TEXT", 1)
    monkeypatch.setattr(batches, "BUCKET_BYTES", 5_000)
    monkeypatch.setattr(lm, "WORDS_PER_PART", 50)
    check(spark, corpus(2))


def test_odd_rows(spark):
    rows = [(None, "no id here"), (1, None), (2, ""), (3, " \n"), (4, "word " * 40_000), (4, "word " * 40_000), (5, "x" * 30_000), (9, "unseen words only")]
    check(spark, rows)
    assert run(spark, []) == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = run(spark, [(held, "nothing was learned")])
    assert (row.n_known, row.train_tokens, row.base_score, row.score < 0) == (0, 0, 0.0, True)


def test_held_out_texts_cost_fewer_bits_than_letter_frequencies(spark):
    rows = corpus(3, 400)
    got = [r for r in run(spark, rows) if r.held_out]
    letters = Counter(b" ".join(w.lower() for r in rows for w in words(r[1])))
    total = sum(letters.values())
    entropy = -sum(c / total * math.log2(c / total) for c in letters.values())
    assert len(got) > 20 and sum(r.bits_per_byte for r in got) / len(got) < 0.6 * entropy


def test_a_probability_equals_the_plain_computation():
    rng = np.random.default_rng(5)
    size, inputs = 1 << lm.TABLE_BITS, len(lm.ORDERS) + 1
    odds_of, known_of = rng.normal(size=(len(lm.ORDERS), size)), rng.random((len(lm.ORDERS), size)) < 0.5
    weights, refined = rng.normal(size=(lm.GATES, inputs)), rng.normal(size=256 * lm.MAP_STEPS)
    tokens = [b"abc", b"", "é".encode(), b"abcdefghij", b"a"]
    got = lm._log_probabilities(tokens, odds_of, known_of, weights, refined, Powers())
    spelling, want = lm.Spelling(tokens, Powers()), np.zeros(len(tokens))
    for level, node, bit, slots in spelling.decisions():
        for token, i in zip(spelling.token, spelling.beginning):
            known = sum(known_of[o][slots[o][i]] for o in range(len(lm.ORDERS)))
            x = sum(weights[known * 8 + level][o] * odds_of[o][slots[o][i]] for o in range(len(lm.ORDERS))) + weights[known * 8 + level][-1]
            step = int(min(max((x + lm.MAP_RANGE) * lm.MAP_STEPS / (2 * lm.MAP_RANGE), 0), lm.MAP_STEPS - 1))
            sigmoid = lambda v: 1 / (1 + math.exp(-v))
            one = (sigmoid(x) + sigmoid(refined[node[i] * lm.MAP_STEPS + step])) / 2
            want[token] += math.log(one if bit[i] else 1 - one)
    assert np.allclose(got, want)
    assert bytes(spelling.symbol[spelling.beginning]) == b"abc  " + "é".encode() + b" abcdefghij a "
    assert len(spelling.symbol) == 4 + 1 + 3 + 8 + 1  # what begins like an earlier token is there once


def test_spelling_knows_nothing_of_other_words():
    alone = lm.Spelling([b"word"], Powers())
    among = lm.Spelling([b"other", b"word", b"x", b"wore"], Powers())
    for one, many in zip(alone.contexts, among.contexts):
        assert (one[alone.beginning] == many[among.beginning][6:11]).all()

"""Words in their contexts: order and repeated passages count."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, words

from changeseries.llm import batches, lm


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_the_order_of_words_counts(spark):
    rng = random.Random(4)
    names = [f"w{i}" for i in range(40)]
    phrases = [[rng.choice(names) for _ in range(8)] for _ in range(12)]
    fluent = [sum(rng.choices(phrases, k=5), []) for _ in range(200)]
    ids = [i for i in range(2_000) if held(i)]
    rows = [(i, " ".join(t)) for i, t in zip([i for i in range(2_000) if not held(i)], fluent[:180])]
    for i, t in enumerate(fluent[180:]):
        rows += [(ids[2 * i], " ".join(t)), (ids[2 * i + 1], " ".join(rng.sample(t, len(t))))]
    got = {r.doc_id: r for r in lm.score_documents(documents(spark, rows)).collect()}
    for i in range(20):
        assert got[ids[2 * i]].bits_per_byte < 0.7 * got[ids[2 * i + 1]].bits_per_byte
        assert got[ids[2 * i]].base_score == pytest.approx(got[ids[2 * i + 1]].base_score)


def test_batches_and_partitions_have_no_say_in_the_counts(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choices(["the", "cat", "sat", "on", "mats"], k=30))) for i in range(80)]

    def scores(frame):
        return [s for _, s in sorted((r.doc_id, r.score) for r in lm.score_documents(frame, gate_rounds=0).collect())]

    once = scores(documents(spark, rows))
    monkeypatch.setattr(lm, "LM_BATCH_BYTES", 1_000)
    monkeypatch.setattr(batches, "MESSAGE_TEXT", 1)
    monkeypatch.setattr(batches, "BUCKET_BYTES", 2_000)
    assert scores(documents(spark, rows)) == pytest.approx(once)


def test_the_cluster_has_no_say_in_the_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS_PER_PART", 60)
    rows = [(i, " ".join(random.Random(i).choices([f"w{k * k}" for k in range(400)], k=40))) for i in range(120)]
    found = []
    for partitions in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        frame = documents(spark, rows).repartition(int(partitions))
        found.append([s for _, s in sorted((r.doc_id, r.score) for r in lm.score_documents(frame).collect())])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == pytest.approx(found[1], rel=1e-9)


def test_probabilities_in_a_context_add_up_to_one():
    rng = np.random.default_rng(3)
    weights = rng.random((lm.COUNT_CLASSES**2, 3))
    weights[[i for i in range(len(weights)) if i % lm.COUNT_CLASSES == 0], 2] = 0
    weights[: lm.COUNT_CLASSES, 1] = 0
    weights /= weights.sum(axis=1, keepdims=True)
    for one, two in ((0, 0), (9, 0), (9, 4)):
        pairs, triples = np.array([one - one // 3, one // 3, 0.0]), np.array([0.0, two, 0.0])
        spelled = np.log([0.2, 0.5, 0.3])
        found = lm.gated(spelled, pairs, np.full(3, float(one)), triples, np.full(3, float(two)), weights)
        assert np.exp(found).sum() == pytest.approx(1)


# --- the whole score by dictionaries and loops --------------------------------------


def squash(x):
    return 1 / (1 + math.exp(-x))


def bits(token):
    """Per decision of a token: level, bits so far, bit, and the contexts of its predictors."""
    spelled = b" " + token + b" "
    for at in range(1, len(spelled)):
        contexts = [(length, spelled[max(0, at - length) : at]) for length in lm.ORDERS]
        for level in range(8):
            yield level, 1 << level | spelled[at] >> (8 - level), spelled[at] >> (7 - level) & 1, contexts


def spelled_scores(counts, words):
    """Natural logarithms: tables, weights, refining map and what they make of every word."""
    tables = {}
    for token, n in counts.items():
        for _, node, bit, contexts in bits(token):
            for context in contexts:
                tables.setdefault((context, node), [0, 0])[bit] += n
    first = lm.first_weights()
    weights, seen, mapped = first.copy(), {}, {}
    for now in range(8):
        steps, there = {}, {}
        for token, n in counts.items():
            for level, node, bit, contexts in bits(token):
                if level != now:
                    continue
                inputs, known = [], 0
                for context in contexts:
                    c = list(tables[context, node])
                    c[bit] -= 1
                    inputs.append(math.log((c[1] + 0.4) / (c[0] + 0.4)))
                    known += sum(c) > 0
                inputs.append(1.0)
                gate = known * 8 + level
                odds = sum(w * x for w, x in zip(weights[gate], inputs))
                place = (node, step(odds))
                mapped.setdefault(place, [0, 0])[0] += n * bit
                mapped[place][1] += n
                error = n * (bit - squash(odds))
                steps[gate] = [a + error * x for a, x in zip(steps.get(gate, [0] * 6), inputs)]
                there[gate] = there.get(gate, 0) + n
        for gate, step_ in steps.items():
            weights[gate] += [lm.RATE * x / there[gate] for x in step_]
            seen[gate] = True
    out = {}
    for token in words:
        total = 0.0
        for level, node, bit, contexts in bits(token):
            found = [tables.get((context, node), [0, 0]) for context in contexts]
            known = sum(sum(c) > 0 for c in found)
            gate = known * 8 + level
            used = weights[gate] if gate in seen else first[gate]
            odds = sum(w * x for w, x in zip(used, [math.log((c[1] + 0.4) / (c[0] + 0.4)) for c in found] + [1.0]))
            middle = (step(odds) + 0.5) * (2 * lm.MAP_RANGE / lm.MAP_STEPS) - lm.MAP_RANGE
            ones, all_ = mapped.get((node, step(odds)), (0, 0))
            share = (ones + lm.MAP_PRIOR * squash(middle)) / (all_ + lm.MAP_PRIOR)
            one = (squash(odds) + share) / 2
            total += math.log(one if bit else 1 - one)
        out[token] = total
    return out


def step(odds):
    return int(min(max((odds + lm.MAP_RANGE) * lm.MAP_STEPS / (2 * lm.MAP_RANGE), 0), lm.MAP_STEPS - 1))


def plain(rows):
    """log10 probabilities of all rows: one batch, one part of the vocabulary."""
    texts = [[w.lower() for w in words(t)] + [b""] for _, t in rows]
    training = [not held(i) for i, _ in rows]
    counts = Counter(w for t, on in zip(texts, training) if on for w in t)
    spelled = spelled_scores(counts, {w for t in texts for w in t})
    grams = [[None, *t] for t in texts]
    pairs = Counter(p for g, on in zip(grams, training) if on for p in zip(g, g[1:]))
    triples = Counter(p for g, on in zip(grams, training) if on for p in zip(g, g[1:], g[2:]))
    ones = Counter(x for g, on in zip(grams, training) if on for x in g[:-1])

    def seen(g, k):
        two = (triples[g[k - 2], g[k - 1], g[k]], pairs[g[k - 2], g[k - 1]]) if k > 1 else (0, 0)
        return pairs[g[k - 1], g[k]], ones[g[k - 1]], *two

    def parts(word, pair, one, triple, two):
        gate = tuple(int(min(math.log2(n + 1), lm.COUNT_CLASSES - 1)) for n in (one, two))
        return gate, (math.exp(spelled[word]), pair / max(one, 1), triple / max(two, 1))

    def first(gate):
        one, two = ((2.0**c if c else 0.0) for c in gate)
        a, b = one / (one + lm.CONTEXT_PRIORS[0]), two / (two + lm.CONTEXT_PRIORS[1])
        return [(1 - b) * (1 - a), (1 - b) * a, b]

    learn = [parts(g[k], *[max(n - 1, 0) for n in seen(g, k)]) for g, on in zip(grams, training) if on for k in range(1, len(g))]
    weights = {}
    for _ in range(lm.GATE_ROUNDS):
        sums = {}
        for gate, p in learn:
            shares = [w * x for w, x in zip(weights.get(gate, first(gate)), p)]
            total = sums.setdefault(gate, [lm.GATE_PRIOR * w for w in first(gate)])
            if sum(shares):
                sums[gate] = [t + s / sum(shares) for t, s in zip(total, shares)]
        weights = {gate: [s / sum(total) for s in total] for gate, total in sums.items()}
    out = []
    for g in grams:
        total = 0.0
        for k in range(1, len(g)):
            gate, p = parts(g[k], *seen(g, k))
            total += math.log10(sum(w * x for w, x in zip(weights.get(gate, first(gate)), p)))
        out.append(total)
    return out


def test_the_whole_score_equals_the_plain_computation(spark):
    rng = random.Random(9)
    names = ["the", "cat", "cats", "sat", "on", "Mats", "é", "x"]
    rows = [(i, " ".join(rng.choices(names[: 5 + i % 4], k=rng.randrange(14)))) for i in range(60)] + [(100, ""), (101, None), (102, "unseen words"), (103, "zzz " * 5)]
    got = {r.doc_id: r.score for r in lm.score_documents(documents(spark, rows)).collect()}
    for (identity, _), score in zip(rows, plain(rows)):
        assert got[identity] == pytest.approx(score, rel=2e-5)

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents

from changeseries.llm import importance
from changeseries.llm.importance import Crc, Features, Head, States, _Numbers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def runs(text):
    found = WORD.findall((text or "").translate(LOWER))
    return found, [" ".join(found[i : i + k]) for k in (1, 2, 3) for i in range(len(found) - k + 1)]


def bucket(run):
    return zlib.crc32(run.encode()) % 10_000


def brute(rows, target, percent=5, least=20, seed=42):
    s, t = (Counter(bucket(r) for text in texts for r in runs(text)[1]) for texts in ([text for _, text in rows], target))
    pool, wanted = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (pool + 10_000) / ((s[b] + 1) * (wanted + 10_000))))

    scored = []
    for identity, text in rows:
        found, features = runs(text)
        weight = sum(gain(bucket(r)) for r in features)
        h = int(hashlib.sha256(f"{seed}:{'' if identity is None else identity}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([identity, len(features), weight, score, len(found) >= least])
    in_order = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    quota = percent * len(in_order) // 100
    out = [(*r[:4], n + 1 if n < quota else None) for n, r in enumerate(in_order)] + [(*r[:4], None) for r in scored if not r[4]]
    return sorted(out, key=str)


def run(spark, rows, target, **options):
    pool, wanted = documents(spark, rows), documents(spark, list(enumerate(target)))
    found = importance.resample(pool, wanted, **options).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "ÜBER", "naïve", "x" * 70, "日本", "a1b2"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--", "\x7f"]) for _ in range(rng.randrange(60)))
        rows.append((i * 3 - 30, text))
    return rows, ["w1 w2 w3 über naïve", "a1b2 w1 w2", "W5_w6", None]


def test_brute_force(spark):
    rows, target = corpus(1)
    assert run(spark, rows, target) == brute(rows, target)
    assert run(spark, rows, target, percent=50, least_words=3, seed=7) == brute(rows, target, 50, 3, 7)


def test_results_do_not_depend_on_the_head(spark, monkeypatch):
    rows, target = corpus(2)
    monkeypatch.setattr(importance, "CHUNK_BYTES", 300)
    monkeypatch.setattr(importance, "COUNTED_WORDS", 10)
    for head_words, pair_words in ((0, 0), (3, 2), (12, 12)):
        monkeypatch.setattr(importance, "HEAD_WORDS", head_words)
        monkeypatch.setattr(importance, "PAIR_WORDS", pair_words)
        assert run(spark, rows, target) == brute(rows, target)


def test_odd_rows(spark):
    rows, target = corpus(3, 20)
    plenty = " ".join(f"z{i}" for i in range(30))
    rows += [(None, None), (None, plenty), (None, plenty), (7, plenty), (7, plenty), (8, ""), (9, "- _ !"), (10, "ab " * 30_000), (11, "q" * 400_000)]
    rows += [(i, plenty) for i in range(1_000, 1_040)]
    assert run(spark, rows, target, percent=60) == brute(rows, target, 60)
    assert run(spark, rows, [], percent=100) == brute(rows, [], 100)
    assert run(spark, [], target) == []


def test_copies_without_number_get_ranks_of_their_own(spark):
    plenty = " ".join(f"z{i}" for i in range(25))
    rows = [(5, plenty)] * 300 + [(i, plenty) for i in range(100, 200)]
    assert run(spark, rows, ["z1 z2"], percent=70) == brute(rows, ["z1 z2"], 70)


def test_crc_of_runs():
    words = [b"a", b"bc", "é".encode(), b"x" * 63, b"y" * 64, b"z" * 65, b"w" * 5_000]
    states, crc = States(words), Crc()
    for i in range(len(words)):
        for j in range(len(words)):
            pair = crc.followed(states.crc[[i]], states, np.array([j]))
            assert pair[0] == zlib.crc32(words[i] + b" " + words[j])
            assert crc.followed(pair, states, np.array([i]))[0] == zlib.crc32(b" ".join((words[i], words[j], words[i])))


@pytest.mark.parametrize("few", [0, 1, 3])
def test_features_of_a_chunk(few, monkeypatch):
    monkeypatch.setattr(importance, "PAIR_WORDS", few)
    head = Head([b"the", b"of", b"and"])
    numbers = _Numbers((w, i) for i, w in enumerate(head.states.words))
    texts = ["The end of THE and of the story", "", "of the", "and", "new new-words"]
    features = Features([t.encode() for t in texts], head, numbers, Crc())
    assert features.n_features().tolist() == [len(runs(t)[1]) for t in texts]
    expected = Counter(bucket(r) for t in texts for r in runs(t)[1])
    totals = features.totals()
    assert {b: int(totals[b]) for b in np.flatnonzero(totals)} == expected
    assert len(numbers) == 3

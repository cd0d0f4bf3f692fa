import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents

from changeseries.llm import batches, common_lines

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def key_of(line):
    return line.strip(SPACE).translate(LOWER)


def brute(rows, least=10, shortest=1):
    split = [(identity, (text or "").split("\n")) for identity, text in rows]
    held = Counter(key for _, lines in split for key in {key_of(line) for line in lines})
    common = {key for key, n in held.items() if n >= least and len(key) >= shortest}
    out = []
    for identity, lines in split:
        kept = [line for line in lines if key_of(line) not in common]
        out.append((str(identity), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, rows, **options):
    found = common_lines.drop_common_lines(documents(spark, rows), **options).collect()
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in found)


def corpus(seed, n=200):
    rng = random.Random(seed)
    shared = [f"Shared line {i}" for i in range(30)] + ["", " ", "é", "ÉCOLE", " ", "x"]
    rows = []
    for i in range(n):
        lines = rng.choices(shared, k=rng.randrange(6)) + [f"own {rng.randrange(3000)}" for _ in range(rng.randrange(5))]
        lines = [rng.choice(["", " ", "\t", "\r"]) + rng.choice([line, line.upper()]) + rng.choice(["", " ", "\r", "\x0b"]) for line in lines]
        rng.shuffle(lines)
        rows.append((i * 3 - 50, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5_000])
def test_places_are_without_gaps(n):
    rng = np.random.default_rng(n)
    high, low = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 32, n, np.uint64)
    high[: n // 3] = high[:1] if n else 0  # keys that differ in one part only
    perfect = common_lines.PerfectHash.from_bytes(common_lines.PerfectHash.build(high, low).to_bytes())
    assert sorted(perfect.places(high, low).tolist()) == list(range(n))
    assert sum(len(level) for level in perfect.levels) < 5 * n + 1_000


def test_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, least=2, shortest=4) == brute(rows, 2, 4)
    assert run(spark, rows, least=1) == brute(rows, 1)


def test_many_batches_and_shards(spark, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 900)
    monkeypatch.setattr(batches, "MESSAGE_TEXT", 1)
    monkeypatch.setattr(common_lines, "BATCH_BYTES", 500)
    monkeypatch.setattr(common_lines, "SHARD_BYTES", 700)
    rows = corpus(2)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    assert run(spark, []) == []
    rows = [(None, None), (4, None), (5, ""), (6, "\n"), (7, "\n\n \n"), (None, "a\nb"), (None, "a\nb")]
    assert run(spark, rows, least=2) == brute(rows, 2)
    rows += [(8, "A\n" * 50_000 + "tail"), (9, "z" * 300_000), (10, " " + "Z" * 300_000), (11, "a"), (11, "a"), (12, "b\r\n")]
    assert run(spark, rows, least=2) == brute(rows, 2)
    with pytest.raises(ValueError):
        common_lines.drop_common_lines(documents(spark, rows), shortest=0)


def test_a_line_of_all_documents(spark):
    rows = [(i, f"one {i}\n  All Rights Reserved \nall rights reserved\ntwo {i % 40}") for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_index_counts_and_unknown_lines(spark):
    rows = [(i, "\n".join(["everywhere"] * 3 + [f"in {i % 2}"])) for i in range(300)]
    index = common_lines.build_index(documents(spark, rows), bits=1).collect()
    assert sum(r.n_keys for r in index) == 3
    asked = common_lines.LineKeys([b"everywhere\nin 0\nin 1\nnowhere\nelse"], 1)
    found = np.zeros(len(asked.high), np.int64)
    for row in index:
        there = np.flatnonzero(asked.high >> np.uint64(63) == np.uint64(row.shard))
        shard = common_lines.ShardIndex(row.levels, row.fingerprints, row.counts)
        found[there] = shard.documents_with(asked.high[there], asked.low[there])
    assert found[asked.place].tolist() == [300, 150, 150, 0, 0]


def test_other_documents_can_be_probed(spark):
    index = common_lines.build_index(documents(spark, [(i, "boiler plate\nrest") for i in range(20)]), bits=0)
    texts, bits = batches.batched(documents(spark, [(1, "Boiler Plate \nnew")]), "doc_id", "text")
    assert [(r.n_dropped, bytes(r.kept)) for r in common_lines.probe(texts, index, bits, 10).collect()] == [(1, b"new")]
    assert [(r.n_dropped, bytes(r.kept)) for r in common_lines.probe(texts, index, bits, 21).collect()] == [(0, b"Boiler Plate \nnew")]


def test_messages_follow_the_input():
    """Batches times buckets stay in proportion to the size of all texts."""
    for size in (10**9, 10**11, 10**13, 10**14):
        count = size / batches.batch_bytes(size, batches.BATCH_BYTES) * (size / batches.batch_bytes(size, batches.BUCKET_BYTES))
        assert count <= 1.01 * size / batches.MESSAGE_TEXT

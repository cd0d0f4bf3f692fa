import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents
from tokenizers import Tokenizer

from changeseries.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")


def rows_of(spark, texts, **options):
    return packing.pack(documents(spark, texts), FILE, **options).collect()


def check(rows, texts, capacity=packing.CAPACITY):
    """Every id of every document lies in one piece; sequences are gapless; the padding is returned."""
    tokenizer = Tokenizer.from_file(FILE)
    want = sorted((str(i), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in texts)
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    if len({w[0] for w in want}) == len(want):
        got = []
        for (identity, count), found in pieces.items():
            found.sort(key=lambda p: p[0])
            assert [p[0] for p in found] == list(np.cumsum([0] + [len(p[1]) for p in found])[:-1])
            got.append((identity, tuple(int(i) for p in found for i in p[1])))
            assert len(got[-1][1]) == count
        assert sorted(got) == want
    padding = 0
    for parts in sequences.values():
        parts.sort()
        total = sum(p[1] for p in parts)
        assert [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts])[:-1])
        assert total <= capacity and all(p[2] == total for p in parts)
        padding += 0 if total & (total - 1) == 0 else capacity - total
    return padding


def test_random_documents(spark):
    rng = random.Random(1)
    syllables = ["the", "re", "é", "Straße", "ing", "42", "don't", "<|endoftext|>", "日本", "…", "Á", " x", "ΟΔΟΣ"]
    texts = [
        (i, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.choice([0, 1, 5, 60, 700, 2500]))))
        for i in range(120)
    ]
    rows = rows_of(spark, texts)
    assert check(rows, texts) == 0


def test_odd_rows(spark):
    texts = [(None, "no id"), (1, None), (2, ""), (3, " \n\t"), (4, "long " * 30_000), (5, "wort" * 5_000)]
    assert check(rows_of(spark, texts), texts) == 0
    repeated = [(7, "same text here")] * 5
    rows = rows_of(spark, repeated)
    check(rows, repeated)
    assert sum(r.length for r in rows) == 5 * rows[0].doc_tokens
    assert rows_of(spark, []) == []


def test_small_buffers_and_word_memory(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER_TOKENS", 5_000)
    monkeypatch.setattr(packing, "CHUNK_BYTES", 500)
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    rng = random.Random(2)
    texts = [(i, " ".join(f"w{rng.randrange(300)}x" for _ in range(rng.randrange(400)))) for i in range(150)]
    assert check(rows_of(spark, texts, capacity=512), texts, 512) == 0


def test_step_groups_hold_equal_tokens(spark):
    texts = [(i, "several words in a row " * (i % 90)) for i in range(400)]
    rows = rows_of(spark, texts, step_tokens=4096)
    groups = {}
    for r in rows:
        groups.setdefault((r.step_group, r.sequence_length), set()).add(r.sequence_id)
    per_group = {}
    for (group, size), members in groups.items():
        assert group not in per_group
        per_group[group] = size * len(members)
    assert max(per_group.values()) <= 4096
    tasks = len({group >> 36 for group in per_group})
    lengths = len({size for _, size in groups})
    assert sum(v < 4096 for v in per_group.values()) <= tasks * lengths


def test_capacity_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(documents(spark, [(1, "a")]), FILE, capacity=1000)


def test_checksums_of_the_query(spark):
    from changeseries.llm.queries import op9_packing

    folder = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(FILE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {k: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for k, t in texts.items()}
    for r in op9_packing(spark, folder).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())

import random

from helpers import documents, words

from changeseries.llm import batches, substring_dedup


def brute(rows, window=13):
    """Kept words by the definition: a window that starts in a document with a smaller id is removed."""
    top = float("inf")
    starts = {}
    for identity, text in rows:
        found = words(text)
        for i in range(len(found) - window + 1):
            key = tuple(found[i : i + window])
            starts[key] = min(starts.get(key, top), top if identity is None else identity)
    out = []
    for identity, text in rows:
        found, own = words(text), top if identity is None else identity
        gone = {i + k for i in range(len(found) - window + 1) if starts[tuple(found[i : i + window])] < own for k in range(window)}
        out.append((str(identity), len(found), len(gone), b" ".join(w for i, w in enumerate(found) if i not in gone).decode()))
    return sorted(out)


def run(spark, rows, **options):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(documents(spark, rows), **options).collect())


def corpus(seed):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices("abcdefg", k=rng.randint(10, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [" ".join(f"w{rng.randrange(1000)}" for _ in range(rng.randrange(20))) for _ in range(4)]
        parts += rng.choices(shared, k=rng.randrange(4))
        rng.shuffle(parts)
        rows.append((i * 3 - 100, rng.choice([" ", "\n", "\t ", "  "]).join(parts)))
    return rows


def test_brute_force(spark):
    rows = corpus(5)
    assert run(spark, rows) == brute(rows)


def test_many_batches_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 2_000)
    monkeypatch.setattr(batches, "BUCKET_BYTES", 3_000)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 300)
    rows = corpus(6)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, window=5) == brute(rows, 5)


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(5, passage), (3, "x " + passage), (9, passage + " y " + passage), (None, passage), (None, passage), (7, None), (8, ""), (3, "x " + passage)]
    rows += [(11, " ".join(f"p{i}" for i in range(12))), (-1, "a " * 50_000), (12, "a " * 14), (13, "A " * 14), (14, passage.upper())]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_a_passage_of_all_documents(spark):
    passage = " ".join(f"license{i}" for i in range(60))
    rows = [(i, f"start{i} " * (i % 15) + passage + f" end{i}") for i in range(300)]
    assert run(spark, rows) == brute(rows)

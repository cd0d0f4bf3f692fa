"""Every stage of the pipeline on what its predecessor kept, against brute force."""

import random

import pytest
import test_minhash
import test_mixing
import test_packing
import test_quality
from helpers import DOCUMENTS

import corpus_pipeline
from changeseries.llm import minhash, quality, secrets


def corpus():
    rng = random.Random(21)
    stops = ["the", "of", "and", "to", "in"]
    rows = []
    for i in range(160):
        if i % 4 == 3 and rows:
            text = rows[rng.randrange(len(rows))][1].split(" ")
            text[rng.randrange(len(text))] = f"changed{i}"
            rows.append((i, " ".join(text), "en", f"s{i % 5}", 0))
            continue
        found = [rng.choice(stops) if rng.random() < 0.4 else f"word{rng.randrange(9_000)}" for _ in range(rng.choice([5, 30, 90, 300]))]
        if i % 10 == 0:
            found[2] = f"password=own{i}secret"
        if i % 13 == 0:
            found = ["###"] * 40
        rows.append((i, " ".join(found), "en", f"s{i % 5}", 0))
    rows += [(None, "the text of a row without an id " * 2 + " ".join(f"n{i}" for i in range(30)), None, None, None), (900, None, "en", "s1", 0), (901, "", "en", None, 0)]
    return [(a, b, c, d, len(b or "")) for a, b, c, d, _ in rows]


@pytest.fixture(scope="module")
def stages(spark):
    out, rows = [], spark.createDataFrame(corpus(), DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "unused").cache()
        out.append(rows.collect())
    return out


def test_quality_stage(stages):
    kept = []
    for r in corpus():
        found = test_quality.brute(r[1])
        base = found["n_words"] < 20 or 100 * found["n_repeat_words"] > 30 * found["n_words"]
        if not base and found["n_symbols"] <= 0.1 * found["n_words"] and (found["n_words"] < 60 or found["n_stop_words"] >= 0.03 * found["n_words"]):
            kept.append(r)
    assert sorted(map(repr, map(tuple, stages[0]))) == sorted(map(repr, kept))
    assert len(kept) < len(corpus()) and quality.MIN_WORDS == 20


def test_near_dedup_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[0]]
    want = {identity for identity, _, _, kept in test_minhash.brute(rows, 80) if kept}
    assert {str(r.doc_id) for r in stages[1]} == want and len(stages[1]) == len(want) < len(rows)
    assert minhash.SHINGLE_WORDS == 5


def test_secrets_stage(stages):
    before, after = {r.doc_id: r.text for r in stages[1]}, {r.doc_id: r.text for r in stages[2]}
    assert before.keys() == after.keys()
    for identity, text in before.items():
        words = [w if not w.startswith("password=") else "[secret]" for w in text.split(" ")]
        assert after[identity] == " ".join(words)
    assert any("[secret]" in t for t in after.values()) and all(r.n_chars == len(r.text) for r in stages[2])
    assert secrets.MAX_OWNERS >= 1


def test_mixing_stage(stages):
    rows = [(f"{r.doc_id}" if r.doc_id is not None else None, r.text, r.source) for r in stages[2]]
    named = [r for r in rows if r[0] is not None]
    times = {}
    for r in stages[3]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    taken = sum(times[r.doc_id] * len(r.text.split()) for r in stages[2] if r.doc_id in times)
    assert abs(taken - sum(len(r[1].split()) for r in rows)) <= 300
    assert set(times.values()) <= {1, 2, 3}
    want = {b[0]: b[4] // b[1] for b in test_mixing.brute([(r[0] or "", r[1], r[2]) for r in named]) if b[4]}
    assert sum(times.get(int(k), 0) == v for k, v in want.items()) >= 0.9 * len(want)
    assert set(stages[3][0].asDict()) == set(corpus_pipeline.COLUMNS)


def test_packing_stage(stages):
    tokens = {}
    for r in stages[4]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    copies = {}
    for r in stages[3]:
        copies.setdefault(r.doc_id, []).append((r.doc_id, r.text))
    assert tokens.keys() == copies.keys()
    lengths = {r.doc_id: r.doc_tokens for r in stages[4]}
    assert all(tokens[i] == lengths[i] * len(rows) for i, rows in copies.items())
    assert test_packing.check(stages[4], [(i, t) for rows in copies.values() for i, t in rows]) == 0


def test_run_writes_and_rereads_every_stage(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() > 100 and [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "minhash_near_dedup", "secret_scans", "mixing", "packing",
    ]
    spark.createDataFrame([], DOCUMENTS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_different_texts_under_one_id_and_copies_without_an_id(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    near = text("a").replace("a39", "changed")
    rows = [(1, text("a"), "en", "s", 2), (1, text("a"), "en", "s", 1), (1, text("b"), "en", "s", 3), (2, near, "en", "s", 4), (3, text("c"), "en", "s", 5)]
    rows += [(None, text("c"), "en", "s", 6), (None, text("d"), "en", "s", 7), (None, text("d"), None, None, 7), (None, text("d") + " more", "en", "s", 8)]
    rows += [(4, None, "en", "s", 0), (4, "", "en", "s", 0), (None, None, None, None, None)]
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, DOCUMENTS).repartition(3), "unused").collect()
    assert len([r for r in got if r.text is None]) == 2 and len([r for r in got if r.text == ""]) == 1
    kept = sorted((str(r.doc_id), r.text, r.n_chars) for r in got if r.text)
    without_id = [r for r in kept if r[0] == "None"]
    assert [r for r in kept if r[0] != "None"] == [("1", text("a"), 1), ("1", text("b"), 3), ("3", text("c"), 5)]
    assert len(without_id) == 1 and without_id[0][1] in (text("d"), text("d") + " more")
    again = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows[::-1], DOCUMENTS).repartition(5), "unused").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, again)))

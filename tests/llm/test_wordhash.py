import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from changeseries.llm import batches
from changeseries.llm.wordhash import Powers, Words, mixed, runs_of_texts, window_hashes

TEXT = st.text("ab \t\n\x0b\x0c\r\x00é ", max_size=30).map(str.encode)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_words_are_those_of_a_plain_split(texts):
    words = Words(texts, Powers())
    want = [w for t in texts for w in t.split()]
    raw = words.buffer.tobytes()
    assert [raw[a:b] for a, b in zip(words.starts, words.ends)] == want
    assert words.counts().tolist() == [len(t.split()) for t in texts]
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(want, words.hashes.tolist()))
    assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_place_or_size():
    rng = random.Random(1)
    word = b"x" * 3_000
    alone, among = Words([word], Powers()), Words([b"a " * rng.randrange(9), b"b " + word], Powers())
    assert alone.hashes[0] == among.hashes[-1]
    assert Words([b"AbC \xc3\x84"], Powers(), lower=True).hashes.tolist() == Words([b"abc \xc3\x84"], Powers()).hashes.tolist()


def test_windows_depend_on_order_and_length():
    values = mixed(np.arange(6, dtype=np.uint64))
    hashes = window_hashes(np.concatenate((values, values[::-1], values)), 3)
    assert hashes[0] == hashes[12] and len({*hashes[:4].tolist(), *hashes[6:10].tolist()}) == 8
    assert len(window_hashes(values[:2], 5)) == 2


def test_runs_cover_all_texts():
    texts = [b"x" * n for n in (3, 0, 9, 1, 1, 1, 20, 0)]
    runs = list(runs_of_texts(texts, 4))
    assert [i for a, b in runs for i in range(a, b)] == list(range(8)) and len(runs) == 3
    assert list(runs_of_texts([], 4)) == []


def test_messages_come_back_as_they_were():
    rng = np.random.default_rng(2)
    for size in (0, 1, 1000):
        values = np.sort(rng.integers(0, 2**63, size, np.uint64) * np.uint64(2))
        assert (batches.unpacked_sorted(batches.packed_sorted(values)) == values).all()
        assert (batches.unpacked(batches.packed(values)) == values).all()
        bits = rng.random(size) < 0.5
        assert (batches.unpacked_bits(batches.packed_bits(bits)) == bits).all()
    assert batches.parted(batches.joined(b"", b"ab", b"\x00" * 9)) == [b"", b"ab", b"\x00" * 9]


def test_buckets_cut_sorted_hashes():
    hashes = np.sort(np.random.default_rng(3).integers(0, 2**63, 500, np.uint64) * np.uint64(2))
    slices = list(batches.bucket_slices(hashes, 4))
    assert [i for _, a, b in slices for i in range(a, b)] == list(range(500))
    assert all((hashes[a:b] >> np.uint64(60) == bucket).all() for bucket, a, b in slices)
    assert list(batches.bucket_slices(hashes, 0)) == [(0, 0, 500)] and list(batches.bucket_slices(hashes[:0], 3)) == []

import base64
import hashlib
import random

import pytest
import zstandard

from changeseries.llm import warc
from changeseries.llm.queries import op8_warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, first int").repartition(2)


def round_trip(spark, folder, rows):
    path = str(folder / "archives")
    warc.write_archives(pages(spark, rows), path)
    return warc.read_archives(spark, path).collect()


def expected(rows):
    smallest = {}
    for identity, _, html in rows:
        if identity is not None:
            smallest[html or ""] = min(smallest.get(html or "", identity), identity)
    out = []
    for identity, url, html in rows:
        first = smallest.get(html or "")
        revisit = first is not None and first != identity
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((identity, url, "revisit" if revisit else "response", first if revisit else None, digest, None if revisit else payload))
    return sorted(out, key=repr)


def found(records):
    number = lambda x: None if x is None or x == warc.IDENTITY.format("") else int(x[10:-1])
    return sorted(
        ((number(r.record_id), r.target_uri, r.record_type, number(r.refers_to), r.payload_digest, r.payload and bytes(r.payload) if r.payload else r.payload) for r in records),
        key=repr,
    )


def test_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "<p>" + " ".join(rng.choices(["some", "wörds", "\r\n\r\n", "\x00"], k=rng.randrange(200)))) for i in range(300)]
    rows += [(1000 + i, None, rows[i][2]) for i in range(50)]
    rows += [(None, "http://none", "only here"), (None, None, rows[0][2]), (5000, "u", None), (5001, "u", ""), (6000, "u", "x" * 1_000_000)]
    rows += [(7000, "twice", "repeated row")] * 2
    got = [(a, b, c, d, e, bytes(f) if f is not None else None) for a, b, c, d, e, f in found(round_trip(spark, tmp_path, rows))]
    assert sorted(got, key=repr) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, tmp_path, []) == []


def test_an_archive_begins_with_its_dictionary(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body><p>page {i} " + "common words of all pages " * 20) for i in range(400)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "a"))
    archives = [p.read_bytes() for p in (tmp_path / "a").glob("part-*")]
    assert archives
    for archive in archives:
        frames = list(warc.frames_of(archive))
        assert frames[0][0] == warc.DICTIONARY_FRAME and frames[0][1] == 0
        assert frames[-1][2] == len(archive)
        stored = zstandard.ZstdCompressionDict(archive[8 : frames[0][2]])
        tool = zstandard.ZstdDecompressor(dict_data=stored)
        for magic, start, end in frames[1:]:
            if magic == warc.FRAME:
                assert tool.decompress(archive[start:end]).startswith(b"WARC/1.1\r\n")


def test_archives_are_bounded(spark, tmp_path):
    bound = 30_000
    rng = random.Random(5)
    rows = [(i, f"http://h/{i}", "<html><body><p>" + " ".join(rng.choices(["some", "words", "of", "all", str(i)], k=60)) + f" {rng.random()}") for i in range(1500)]
    rows += [(2000, "long", "".join(rng.choices("abcdefgh", k=200_000)))]
    path = str(tmp_path / "bounded")
    warc.write_archives(pages(spark, rows), path, archive_bytes=bound)
    contents = [p.read_bytes() for p in (tmp_path / "bounded").glob("part-*")]
    assert len(contents) > 6
    over = 0
    for content in contents:
        frames = [f for f in warc.frames_of(content) if f[0] in (warc.FRAME, warc.DICTIONARY_FRAME)]
        assert frames[0][0] == warc.DICTIONARY_FRAME and frames[0][1] == 0
        kept = [end - start for _, start, end in frames]
        sample = 1 + warc.SAMPLE_RECORDS
        over += sum(kept[:-1]) >= bound and len(kept) > sample
        assert sum(magic == warc.FRAME for magic, _, _ in frames) >= 1
    assert over == 0
    records = warc.read_archives(spark, path).collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in records) == sorted((warc.IDENTITY.format(i), h.encode()) for i, _, h in rows)


def test_a_sample_of_long_records_ends_early(monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 10_000)
    records = [warc.record("response", f"<urn:page:{i}>", None, b"x" * 900, warc.digest(b"x" * 900), None, "1970-01-01T00:00:00Z") for i in range(100)]
    made = list(warc.archives(iter(records), 1))
    assert len(made) > 2
    assert [r["record_id"] for archive in made for r in warc.records_of(archive)] == [f"<urn:page:{i}>" for i in range(100)]


def test_a_frequent_payload_is_split_over_tasks(spark, tmp_path):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    hot = "".join(random.Random(7).choices("abcdefgh", k=5_000))
    rows = [(i, f"http://h/{i}", hot if i % 3 == 0 else f"page {i} " + hot[: i % 300]) for i in range(3_000)]
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        path = str(tmp_path / "hot")
        warc.write_archives(pages(spark, rows).repartition(16), path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == len(rows)
    revisits = [r for r in records if r.record_type == "revisit"]
    assert len(revisits) == 999 and {r.refers_to for r in revisits} == {warc.IDENTITY.format(0)}
    assert len({r.archive for r in revisits}) > 1


def archive_of(*records):
    compressor = zstandard.ZstdCompressor()
    return b"".join(compressor.compress(r) + warc.EMPTY_FRAME for r in records)


GOOD = warc.record("response", "<urn:page:1>", "http://h/", b"payload", warc.digest(b"payload"), None, "1970-01-01T00:00:00Z")


@pytest.mark.parametrize(
    "content",
    [
        archive_of(GOOD)[:-20],
        b"not zstandard at all",
        archive_of(GOOD.replace(b"WARC/1.1", b"WARC/9.9")),
        archive_of(GOOD.replace(b"WARC-Date", b"WARC-Data")),
        archive_of(GOOD.replace(b"payload\r\n", b"paxload\r\n")),
        archive_of(GOOD[:-2]),
        archive_of(GOOD + GOOD),
        archive_of(GOOD.replace(b"Content-Length: 67", b"Content-Length: 66").replace(b"Content-Length: 66", b"Content-Length: x")),
        warc.skippable_frame(warc.DICTIONARY_FRAME, b"no dictionary") + archive_of(GOOD),
    ],
)
def test_broken_archives_are_refused(content):
    with pytest.raises(warc.WarcError):
        list(warc.records_of(content))


def test_a_compressed_dictionary_is_read():
    samples = [GOOD.replace(b"payload", str(i).encode() * 7) for i in range(200)]
    trained = zstandard.train_dictionary(4096, samples, k=64, d=8)
    record = zstandard.ZstdCompressor(dict_data=trained).compress(GOOD)
    for stored in (trained.as_bytes(), zstandard.ZstdCompressor().compress(trained.as_bytes())):
        (read,) = warc.records_of(warc.skippable_frame(warc.DICTIONARY_FRAME, stored) + record)
        assert read["payload"] == b"payload" and read["record_id"] == "<urn:page:1>"


def test_query_with_copies(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 7}") for i in range(40)]
    pages(spark, rows).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    for r in op8_warc(spark, str(tmp_path)).collect():
        payload = f"page {r.page_id % 7}".encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == warc.digest(payload)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id < 7 else ("revisit", r.page_id % 7))

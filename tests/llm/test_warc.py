"""Archives: round trips, and what is left of damaged ones."""

import gzip
import hashlib
import random

import pyarrow.fs as fs
import pytest

from vigilog.llm import warc

KIND = "page_id long, url string, html string"


def files(archives):
    return {r.path: fs.LocalFileSystem().open_input_file(r.path.removeprefix("file://")).read() for r in archives.collect()}


def put(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string")


def members(n=12, size=700):
    noise = random.Random(3)
    bodies = [bytes(noise.randrange(32, 120) for _ in range(size)) for _ in range(n)]
    return bodies, [warc.record(k, f"https://h/{k}", b, hashlib.sha256(b).hexdigest(), None, False, "2020-01-01T00:00:00Z") for k, b in enumerate(bodies)]


def test_round_trip(spark):
    big = "é" * 200
    rows = [(5, "https://h/a b\n", big), (3, "https://h/b", big), (9, None, big), (3, "https://h/b2", big), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "u", None), (6, "u", ""), (None, "u", "y" * 500), (None, "v", "y" * 500), (None, "w", big)]
    rows += [(7, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 9 + "\x00\r\n"), (8, "u", "long line " * 300_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND + ", digest string, first int")
    archives = warc.write(pages, archive_bytes=2000)
    found = warc.read(archives).collect()
    assert sum(r.records for r in archives.collect()) == len(rows) and [(r.path, r.offset, r.reason) for r in found if r.gap] == []
    seen = []
    for i, u, t in rows:
        data = (t or "").encode()
        first = None if len(data) < 100 else min((j for j, _, s in rows if s == t and j is not None), default=None)
        revisit = first is not None and i != first
        seen.append((warc._name(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", warc._name(first) if revisit else None, None if revisit else data, u.replace("\n", "%0A") if u else None))
    assert sorted(map(str, seen)) == sorted(str((r.record_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to, None if r.payload is None else bytes(r.payload), r.target_uri)) for r in found)
    for data in files(archives).values():
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark):
    archives = warc.write(spark.createDataFrame([], KIND))
    assert archives.collect() == [] and warc.read(archives).collect() == []


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_only_the_records_it_touches(spark, tmp_path, packed):
    bodies, records = members()
    parts = [warc.pack(r) if packed else r for r in records]
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    data = bytearray(b"".join(parts))
    data[starts[2] + 300] ^= 0xFF  # inside a record
    data[starts[6] : starts[6] + 4] = b"\0\0\0\0"  # the first bytes of one
    data[starts[9] : starts[9]] = b"junk \x1f\x8b\x08 WARC/1.1 more\nWARC/1.1\r\nx: y\r\n"  # between two
    data = bytes(data[:-20])  # the end is torn off
    rows = warc.read(put(spark, tmp_path, "damaged", data)).collect()
    kept = [r for r in rows if not r.gap]
    assert [r.record_id for r in kept] == [warc._name(k) for k in range(12) if k not in (2, 6, 11)]
    assert all(bytes(r.payload) == bodies[int(r.record_id[10:-1])] for r in kept)
    gaps = [(r.offset, r.length) for r in rows if r.gap]
    shift = len(data) + 20 - starts[-1]
    assert gaps == [(starts[2], len(parts[2])), (starts[6], len(parts[6])), (starts[9], shift), (starts[11] + shift, len(parts[11]) - 20)]
    assert all(r.reason for r in rows if r.gap)
    # no byte is unaccounted for
    assert sum(r.length for r in rows) == len(data)


def test_members_of_several_records(spark, tmp_path):
    bodies, records = members(6)
    bad = records[4][:-30] + b"?" * 26 + records[4][-4:]
    data = warc.pack(b"".join(records[:3])) + warc.pack(records[3] + bad + records[5])
    rows = warc.read(put(spark, tmp_path, "several.warc.gz", data)).collect()
    assert [r.record_id for r in rows if not r.gap] == [warc._name(k) for k in (0, 1, 2, 3, 5)]
    assert ["block digest" in r.reason for r in rows if r.gap] == [True]


def test_files_without_records(spark, tmp_path):
    for name, data in (("none", b""), ("text", b"plain text\n" * 50), ("short", b"WARC/1.1\r\n"), ("magic", b"\x1f\x8b\x08" * 40)):
        rows = warc.read(put(spark, tmp_path, name, data)).collect()
        assert [(r.gap, r.offset, r.length) for r in rows] == ([(True, 0, len(data))] if data else [])


def test_a_stated_length_past_the_end_is_not_read(spark, tmp_path):
    _, records = members(3)
    lying = records[1].replace(b"Content-Length: ", b"Content-Length: 99999999999999", 1)
    rows = warc.read(put(spark, tmp_path, "lying", records[0] + lying + records[2])).collect()
    assert [r.record_id for r in rows if not r.gap] == [warc._name(0), warc._name(2)]
    assert [r.length for r in rows if r.gap] == [len(lying)]

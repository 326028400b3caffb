"""Zip members, headerless shards and misnamed gzip files read as the plain files are."""

import csv
import gzip
import io
import json
import tracemalloc
import zipfile

import pytest

from vigilog.sources import ingest, packed


def flows(n, seed=1):
    return [[f"10.0.{k % 7}.{(k * seed) % 250}", str(k % 65536), f"{k * 0.5}", "caf\xe9" if k % 9 == 0 else 'a "quoted", text' if k % 5 == 0 else "two\nlines" if k % 11 == 0 else "BENIGN"] for k in range(n)]


NAMES = ["Source IP", "Port", "Duration", "Label"]


def text(rows, header=None):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(([header] if header else []) + rows)
    return out.getvalue()


def sorted_rows(df):
    return sorted(map(tuple, df.collect()))


def test_members_of_a_zip(spark, tmp_path):
    path = str(tmp_path / "captures.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, day in enumerate(("mon", "tue", "wed")):
            z.writestr(f"days/{day}.csv", text(flows(300, k + 1), [" Source IP", " Port ", "Duration", " Label"]).encode("latin-1"))
        z.writestr("README.txt", "none")
        z.writestr("days/empty.csv", "")
    df = packed.read_zip(spark, path, "*.csv", "latin-1")
    assert df.columns == NAMES and df.rdd.getNumPartitions() == 3
    assert sorted_rows(df) == sorted(tuple(r) for k in range(3) for r in flows(300, k + 1))
    one = packed.read_zip(spark, path, "*/tue.csv", "latin-1")
    assert sorted_rows(one) == sorted(map(tuple, flows(300, 2)))
    for pattern, error in (("*.tsv", ValueError), ("*empty.csv", ValueError)):
        with pytest.raises(error):
            packed.read_zip(spark, path, pattern)
    with pytest.raises(FileNotFoundError):
        packed.read_zip(spark, str(tmp_path / "none.zip"))


def test_zip_members_without_a_header(spark, tmp_path):
    path = str(tmp_path / "mixed.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.csv", text(flows(40)))
        z.writestr("b.csv", text(flows(30, 3), NAMES))
    assert sorted_rows(packed.read_zip(spark, path, columns=NAMES)) == sorted(map(tuple, flows(40) + flows(30, 3)))
    with pytest.raises(ValueError, match="expected 2"):
        packed.read_zip(spark, path, columns=["a", "b"])


def test_shards_with_given_columns(spark, tmp_path):
    rows = [[f"h{k}", str(k), "", "na\xefve"] for k in range(50)]
    for name, header in (("s1.csv", None), ("s2.csv", NAMES)):
        (tmp_path / name).write_bytes(text(rows, header).encode("latin-1"))
    paths = [str(tmp_path / n) for n in ("s1.csv", "s2.csv", "absent.csv")]
    assert sorted_rows(packed.read_shards(spark, paths, NAMES, "ISO-8859-1")) == sorted(map(tuple, rows + rows))
    with pytest.raises(FileNotFoundError):
        packed.read_shards(spark, paths[2:], NAMES)
    with pytest.raises(ValueError, match="expected 49"):
        packed.read_shards(spark, paths, [f"c{k}" for k in range(49)])


def test_misnamed_gzip_reads_like_the_plain_file(spark, tmp_path):
    made = text(flows(500), NAMES)
    (tmp_path / "plain.csv").write_text(made, newline="")
    (tmp_path / "packed.csv").write_bytes(gzip.compress(made.encode()))
    plain, kind = ingest.read_table(spark, str(tmp_path / "plain.csv"))
    found, same = ingest.read_table(spark, str(tmp_path / "packed.csv"))
    assert (kind, plain.columns) == (same, found.columns) == ("csv", NAMES) and sorted_rows(plain) == sorted_rows(found) == sorted(map(tuple, flows(500)))
    records = [{"a": k, "b": {"c": f"x{k}"}} for k in range(40)]
    for name, body in (("j.jsonl", "\n".join(map(json.dumps, records))), ("k.json", json.dumps(records)), ("w.json", json.dumps({"n": 1, "rows": records}))):
        (tmp_path / name).write_bytes(gzip.compress(body.encode()))
        df, _ = ingest.read_table(spark, str(tmp_path / name))
        assert df.columns == ["a", "b.c"] and sorted(map(tuple, df.collect())) == sorted((str(r["a"]), r["b"]["c"]) for r in records)


def test_a_large_file_is_unpacked_in_pieces(tmp_path):
    line = ",".join(["0123456789"] * 10) + "\n"
    with gzip.open(tmp_path / "big.csv", "wb", compresslevel=1) as f:
        for _ in range(40):
            f.write((line * 10_000).encode())
    reader = packed.PackedReader({"files": json.dumps([[f"file://{tmp_path}/big.csv", None]]), "columns": json.dumps(list("abcdefghij")), "mode": "rows", "encoding": "utf-8"})
    tracemalloc.start()
    n = sum(b.num_rows for b in reader.read(reader.partitions()[0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400_000 and peak < 16 << 20  # of 44 MB unpacked


def test_records_of_too_many_fields_are_errors(spark, tmp_path):
    for name, pack in (("a.csv", str.encode), ("b.csv", lambda t: gzip.compress(t.encode()))):
        (tmp_path / name).write_bytes(pack("user,age\nann,1\nbob,2\ncid,3,4\n"))
        with pytest.raises(Exception, match="more than 2 fields|has 3 fields"):
            ingest.read_table(spark, str(tmp_path / name))[0].collect()


def test_a_bad_line_is_named(spark, tmp_path):
    good = [json.dumps({"a": k, "text": "x" * 200}) for k in range(3000)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        for at in (0, 1, 1700, 2999):
            lines = [*good[:500], "", *good[500:]]
            lines[at] = '{"a": 1, "text": '
            for name, pack in (("log.jsonl", str.encode), ("log.ndjson", lambda t: gzip.compress(t.encode()))):
                (tmp_path / name).write_bytes(pack("\n".join(lines)))
                with pytest.raises(ValueError, match=f"^Line {at + 1} is not valid JSON"):
                    ingest.read_table(spark, str(tmp_path / name))
        assert ingest.first_bad_line(spark.createDataFrame([("f", 0, "{}"), ("f", 0, " ")], "file string, block long, value string")) is None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("body", ["5", '"text"', "true", "[1, 2", '{"a": '])
def test_json_that_is_no_table(spark, tmp_path, body):
    (tmp_path / "x.json").write_text(body)
    with pytest.raises(ValueError):
        ingest.read_table(spark, str(tmp_path / "x.json"))


def test_header_and_delimiter_rules(spark, tmp_path):
    cases = {
        "words.log": ("user|place\nann|rome\nbob|oslo\n", ["user", "place"], "csv"),
        "tabs.log": ("a\tb\n1\t2\n3\t4\n", ["a", "b"], "tsv"),
        "numbers.csv": ("1;2\n3;4\n5;6\n", ["col0", "col1"], "csv"),
        "twice.csv": ("a,a,b\n1,2,3\n4,5,6\n", ["a", "a.1", "b"], "csv"),
        "array.log": ('[{"k": "v"}, {"k": "w"}]', ["k"], "json"),
        "lines.log": ('{"k": 1}\n{"k": 2}\n', ["k"], "jsonl"),
    }
    for name, (body, columns, kind) in cases.items():
        (tmp_path / name).write_text(body)
        df, fmt = ingest.read_table(spark, str(tmp_path / name))
        assert (df.columns, fmt) == (columns, kind), name
        assert df.count() == {"numbers.csv": 3}.get(name, 2)

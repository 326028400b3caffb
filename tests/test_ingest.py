"""Reading, inference, overrides and typing on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from vigilog.sources import ingest


def put(tmp_path, name, text, zipped=False):
    path = tmp_path / name
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    return str(path)


def roles(schema):
    return {c.name: c.role for c in schema.columns}


CLICKS = (
    "event_id\tevent_time\tregion\tbrowser\tos\turl\n"
    "e1\t2021-06-01 00:00:10\tus\tchrome\tios\t/click?d=a.example&q=best%20shoes&ttc=10&ct=us\n"
    "e2\t2021-06-01 00:00:10\tus\tchrome\tios\t/click?d=a.example&q=best+shoes&ttc=10&ct=us\n"
    "e3\t2021-06-01 00:05:00\tgb\tsafari\tios\t/click?d=b.example&q=car&ttc=3000&ct=gb\n"
    "e4\t2021-06-01 00:09:00\tde\tedge\twindows\t/click?d=c.example&q=tea&ttc=2500&ct=de\n"
)


def test_click_log(spark, tmp_path):
    df, schema = ingest.load(spark, put(tmp_path, "clicks.tsv", CLICKS))
    found = roles(schema)
    assert (found["event_id"], found["event_time"], found["region"], found["url"]) == ("identifier", "timestamp", "categorical", "url")
    assert schema.row_id == "event_id" and schema.primary_timestamp == "event_time"
    by = {c.name: c for c in schema.columns}
    assert by["url__ttc"].role == "numeric" and by["url__ttc"].subtype == "int" and by["url__ttc"].derived_from == "url"
    rows = df.orderBy("event_id").collect()
    assert [r.url__ttc for r in rows] == [10, 10, 3000, 2500] and rows[0].url__q == rows[1].url__q == "best shoes" and rows[0].url__path == "/click"
    assert json.dumps(schema.to_dict()) and "event_id: identifier" in schema.describe()


def test_missing_boolean_and_no_header(spark, tmp_path):
    df, schema = ingest.load(spark, put(tmp_path, "users.csv", "user,age,active,country\na,31,yes,US\nb,,no,\nc,25,yes,DE\nd,40,no,US\n"))
    by = {c.name: c for c in schema.columns}
    assert by["age"].role == "numeric" and by["age"].n_missing == by["country"].n_missing == 1 and by["active"].role == "boolean"
    assert {r.user: r.active for r in df.collect()} == {"a": True, "b": False, "c": True, "d": False}
    df, _ = ingest.load(spark, put(tmp_path, "plain.csv", "1,2,3\n4,5,6\n7,8,9\n10,11,12\n"))
    assert df.columns == ["col0", "col1", "col2"] and df.count() == 4


def test_json_forms(spark, tmp_path):
    lines = "".join(json.dumps({"ts": f"2024-01-0{k} 00:00:00", "actor": {"id": f"u{k % 2}"}, "n": k}) + "\n" for k in (1, 2, 3))
    _, schema = ingest.load(spark, put(tmp_path, "a.jsonl", lines))
    assert {k: v for k, v in roles(schema).items() if k != "actor.id"} == {"ts": "timestamp", "n": "numeric"} and "actor.id" in roles(schema)
    for name, value in (("b.json", [{"a": "x", "v": k} for k in range(3)]), ("c.json", {"events": [{"a": "x", "v": k} for k in range(3)]})):
        df, fmt = ingest.read_table(spark, put(tmp_path, name, json.dumps(value)))
        assert fmt == "json" and df.columns == ["a", "v"] and df.count() == 3


@pytest.mark.parametrize("name", ["log.csv.gz", "log.csv"])
def test_gzip_by_its_bytes(spark, tmp_path, name):
    text = "ts,user,val\n2024-01-01 00:00:00,a,1\n2024-01-01 00:00:01,b,2\n2024-01-01 00:00:02,a,3\n"
    df, _ = ingest.read_table(spark, put(tmp_path, name, text, True))
    assert [tuple(r) for r in df.orderBy("val").collect()] == [tuple(x.split(",")) for x in text.splitlines()[1:]]


def test_empty_and_absent_files(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        ingest.read_table(spark, put(tmp_path, "e.csv.gz", "", True))
    with pytest.raises(FileNotFoundError):
        ingest.read_table(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize(
    ("stamp", "seconds"),
    [("03/04/2024 00:00:0{}", 1712102400), ("2024-04-03 00:00:0{}.250", 1712102400.25), ("03/Apr/2024:00:00:0{} +0000", 1712102400), ("03.04.2024 00:00:0{}", 1712102400), ("2024-04-03T01:00:0{}+01:00", 1712102400), ("03 Apr 2024 00:00:0{}", 1712102400)],
)
def test_timestamp_formats(spark, tmp_path, stamp, seconds):
    text = "t;x\n" + "".join(f"{stamp.format(k)};v{k % 2}\n" for k in (0, 1, 2))
    df, schema = ingest.load(spark, put(tmp_path, "t.csv", text))
    assert schema.primary_timestamp == "t"
    assert [r.s for r in df.selectExpr("unix_micros(cast(t as timestamp)) / 1e6 s").orderBy("s").collect()] == [seconds + k for k in (0, 1, 2)]


def test_mixed_formats_and_epochs(spark, tmp_path):
    df, schema = ingest.load(spark, put(tmp_path, "m.csv", "t,kind\n2024-04-03 00:00:00,a\n2024/04/03 00:00:01,b\n2024-04-03T00:00:02,a\n"))
    assert schema.primary_timestamp == "t" and df.filter("t is null").count() == 0
    _, schema = ingest.load(spark, put(tmp_path, "n.csv", "t,x\n1712102400,1\n1712102401,2\n1712102402,1\n"))
    assert roles(schema)["t"] == "numeric" and schema.primary_timestamp is None


def test_overrides(spark, tmp_path):
    path = put(tmp_path, "o.csv", "created,event_time,x\n2024-01-01 00:00:00,2024-01-02 00:00:00,1\n2024-01-01 00:00:01,2024-01-02 00:00:01,2\n")
    assert ingest.load(spark, path)[1].primary_timestamp == "created"
    assert ingest.load(spark, path, timestamp="event_time")[1].primary_timestamp == "event_time"
    _, schema = ingest.load(spark, path, entity=("x",))
    assert roles(schema)["x"] == "categorical" and [c.entity for c in schema.columns if c.name == "x"] == [True]
    for bad in ({"timestamp": "x"}, {"entity": ("nope",)}, {"entity": ("x",), "content": ("x",)}):
        with pytest.raises(ValueError):
            ingest.load(spark, path, **bad)


def test_more_parameters_than_columns_are_a_map(spark, tmp_path):
    import math
    from collections import Counter

    from vigilog.plans import detect

    rows = [f"/p{k % 3}?" + "&".join([f"k{k * 10 + j}=v{j}" for j in range(9)] + ["all=same", f"few={k % 5}"] + ["all=last"] * (k % 7 == 0)) if k % 50 else "/none?" for k in range(5600)]
    path = put(tmp_path, "sparse.csv", "url;kind\n" + "".join(f"{u};k{k % 4}\n" for k, u in enumerate(rows)))
    df, schema = ingest.load(spark, path, row_number="_rid")
    by = {c.name: c for c in schema.columns}
    n = sum(k % 50 > 0 for k in range(5600))
    assert by["url__params"].role == "map" and by["url__params"].n_unique == 9 * n + 2 > 49_000 and by["url__params"].n_missing == 5600 - n and by["url__path"].role == "categorical"
    assert not any(c.startswith("url__k") for c in df.columns)
    held = {r._rid: r.url__params for r in df.collect()}
    assert len(held[7]) == 11 and held[7]["all"] == "last" and held[8]["all"] == "same" and held[50] == {}
    made = detect.features(df, detect.Log.of(schema, "_rid"))
    assert {"url__params__keys", "url__params__conc"} <= made.families.keys()
    counted = Counter(e for m in held.values() for e in m.items())
    for r in made.frame.select("_rid", "x__url__params__keys", "x__url__params__conc").filter("_rid % 37 = 0").collect():
        m = held[r[0]]
        assert r[1] == len(m) and r[2] == pytest.approx(sum(math.log1p(counted[e]) for e in m.items()) / len(m) if m else 0)


def test_the_source_is_read_once(spark, tmp_path):
    # a source whose values differ at each reading
    from pyspark.sql import functions as F

    df = spark.range(300).select(F.concat(F.lit("/a?x="), F.expr("uuid()")).alias("url"), F.expr("uuid()").alias("name"))
    typed, schema = ingest.load(spark, df)
    assert sorted(map(str, typed.collect())) == sorted(map(str, typed.collect()))
    assert {r.url.split("=")[1] for r in typed.collect()} == {r.url__x for r in typed.collect()} >= set(next(c for c in schema.columns if c.name == "url__x").examples)


def test_samples_are_the_first_rows(spark, tmp_path):
    lines = [f"n{k:05d};{k}" for k in range(9000)]
    lines += [f"w{k};word{k}" for k in range(9000, 12000)]
    df = spark.createDataFrame([tuple(x.split(";")) for x in lines], "a string, b string").coalesce(1).repartitionByRange(6, "a").sortWithinPartitions("a")
    numbered = df.withColumn("_n", F.monotonically_increasing_id())
    found = ingest._samples(numbered, {"b": F.col("b")}, "_n")
    assert found["b"] == [str(k) for k in range(1000)]
    late = {"b": F.when(F.col("b").like("word%"), F.col("b"))}
    assert ingest._samples(numbered, late, "_n")["b"] == [f"word{k}" for k in sorted(range(9000, 12000), key=lambda k: f"w{k}")[:1000]]

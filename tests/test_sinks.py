"""Single files in order, replaced whole or not at all, and names that hold Spark's own signs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vigilog.plans.run import plain_names, run_pipeline
from vigilog.sources import sinks


def frame(spark, n=5000):
    return spark.range(n).select("id", F.concat(F.lit("a\tb\r\n"), F.col("id").cast("string")).alias("t"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x")).repartition(7)


@pytest.mark.parametrize("partitions", ["3", "13"])
def test_ordered_files(spark, tmp_path, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one, two = str(tmp_path / "one.tsv"), str(tmp_path / "deep" / "er" / "two.tsv")
        sinks.write_tables(frame(spark), [-F.col("id")], {one: {"who": F.col("id"), "t": F.col("t")}, two: {"x.y": sinks.six("x")}})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = range(4999, -1, -1)
    assert open(one, newline="").read() == "who\tt\n" + "".join(f"{i}\ta b {i}\n" for i in order)
    assert open(two, newline="").read() == "x.y\n" + "".join(f"{i / 7:.6f}\n" if i % 3 else "null\n" for i in order)
    assert os.listdir(tmp_path) in (["one.tsv", "deep"], ["deep", "one.tsv"])


def test_empty_table_and_folders(spark, tmp_path):
    path = str(tmp_path / "none.tsv")
    sinks.write_tables(frame(spark).limit(0), [F.col("id")], {path: {"id": F.col("id")}})
    assert open(path).read() == "id\n"
    folder = str(tmp_path / "folder")
    sinks.write_tables(frame(spark), [F.col("id")], {folder: {"id": F.col("id")}}, single=False)
    parts = sorted(p for p in os.listdir(folder) if p.startswith("part-"))
    assert [int(x) for p in parts for x in open(f"{folder}/{p}").read().splitlines()[1:]] == list(range(5000))


def test_a_failure_leaves_the_old_file(spark, tmp_path):
    path = tmp_path / "kept.tsv"
    path.write_text("old")
    with pytest.raises(Exception, match="broken"):
        sinks.write_tables(frame(spark), [F.col("id")], {str(path): {"id": F.when(F.col("id") < 4000, F.col("id")).otherwise(F.raise_error(F.lit("broken")))}})
    with pytest.raises(RuntimeError), sinks._replacing(f"file://{path}") as out:
        out.write(b"half")
        raise RuntimeError
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["kept.tsv"]
    sinks.write_json(spark, str(path), {"a": 1})
    assert json.loads(path.read_text()) == {"a": 1} and os.listdir(tmp_path) == ["kept.tsv"]


def test_names_with_signs_are_shown_as_they_are(spark, tmp_path):
    assert plain_names(["a", "b.c", "column1", "d`e"]) == {"a": "a", "b.c": "column1_", "column1": "column1", "d`e": "column3"}
    rows = [{"actor": {"id": f"user-{k % 25}"}, "kind․of": f"k{k % 30}", "n.m": k % 40, "note": "same text here" if k % 4 == 0 else f"note {k} {k * 7919}"} for k in range(240)]
    log = tmp_path / "log.jsonl"
    log.write_text("".join(json.dumps(r) + "\n" for r in rows))
    summary = run_pipeline(spark, str(log), str(tmp_path / "out"), backend="deviation")
    assert "actor.id__conc" in summary["feature_names"] and "n.m__rep" in summary["feature_names"] and "kind․of__conc" in summary["feature_names"]
    assert set(summary["rule_thresholds"]["categorical_concentration"]) == {"actor.id", "kind․of"} and "n.m" in summary["rule_thresholds"]["numeric_reuse"]
    lines = (tmp_path / "out" / "artifacts" / "features.tsv").read_text().splitlines()
    assert lines[0].split("\t") == ["row_id", *summary["feature_names"]] and [x.split("\t")[0] for x in lines[1:]] == [f"row_{k}" for k in range(240)]
    told = json.loads((tmp_path / "out" / "artifacts" / "selected_events.json").read_text())
    assert not any("column0" in json.dumps(x) for x in told)

"""Rules and outputs on small logs with a known answer."""

import csv
import json

from pyspark.sql import functions as F

from vigilog import cli
from vigilog.operators import counts, timing
from vigilog.plans import detect, evaluate
from vigilog.sources import generate, ingest


def rows_of(found, rule):
    return {r.id for r in found.frame.filter(F.exists("hits", lambda h: h["rule_id"] == rule)).select("id").collect()}


def run(spark, rows, schema, log, **how):
    return detect.detect(spark.createDataFrame(rows, schema), log, backend="deviation", **how)


def network_log(hosts=40, payloads=12):
    """A hub reached from four sources, a channel between two hosts, and hosts whose numbers step over the whole range."""
    rows = []
    spread = lambda j, host: [float(j * hosts * 13 + host + k * 101) for k in range(payloads)]
    for source in range(4):
        rows += [(f"10.0.2.{source}", "10.0.0.9", *[0.0] * payloads)] * 8
        rows += [(f"10.0.2.{source}", f"10.0.3.{j % 5}", *spread(j, source)) for j in range(10)]
    rows += [("10.0.1.1", "10.0.1.2", *[0.0] * payloads)] * 20
    rows += [(f"10.0.4.{h}", f"10.0.5.{h}", *spread(j, h)) for h in range(hosts) for j in range(12)]
    names = [f"p{k}" for k in range(payloads)]
    return [(i, *r) for i, r in enumerate(rows)], "id long, src string, dst string, " + ", ".join(f"{n} double" for n in names), detect.Log("id", None, ["src", "dst"], names)


def test_hub_fires_and_channel_does_not(spark):
    rows, schema, log = network_log()
    assert len(rows) == 572
    found = run(spark, rows, schema, log)
    assert found.features.entity == ["src", "dst"] and found.thresholds["entity_graph_active"] and found.thresholds["min_hub_degree"] == 3
    fired = rows_of(found, "entity_monotony")
    hub = {r[0] for r in rows if r[2] == "10.0.0.9"}
    assert hub <= fired and not fired & {r[0] for r in rows if r[1] == "10.0.1.1"}
    scores = {r.id: r for r in found.frame.collect()}
    assert all(scores[i].heuristic >= 0.7 for i in hub) and all(scores[r[0]].heuristic < 0.7 for r in rows if r[1] == "10.0.1.1")
    assert "with 4 counterparts" in next(h.reason for h in scores[min(hub)].hits if h.rule_id == "entity_monotony")


def scans_and_files(spark, columns):
    """Scans of the plan of the features of a log of so many columns, and the tables written for it."""
    import os

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    rows = [(i, *[f"v{(i * (k + 3)) % (20 + k)}" for k in range(columns // 2)], *[float((i * (k + 7)) % 97) for k in range(columns // 2)]) for i in range(300)]
    names, numbers = [f"c{k}" for k in range(columns // 2)], [f"n{k}" for k in range(columns // 2)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join([f"{c} string" for c in names] + [f"{c} double" for c in numbers]))
    before = len(os.listdir(root))
    made = detect.features(df, detect.Log("id", None, names, numbers))
    assert made.frame.count() == 300 and len(made.families) == columns // 2 + 1 + columns
    return len(os.listdir(root)) - before


def test_the_plan_does_not_grow_with_the_columns(spark):
    from vigilog.session import materialise

    materialise(spark.range(1), "first")  # names the folder
    assert scans_and_files(spark, 4) == scans_and_files(spark, 24) == scans_and_files(spark, 84)


def test_broadcaster_fires_and_fan_in_does_not(spark):
    star = [("10.0.0.1", f"10.9.0.{k}", "smtp") for k in range(90)]
    clients = [(f"10.5.0.{c}", f"10.6.0.{k % 2}", f"s{(c * 5 + k) % 9}") for c in range(60) for k in range(12)]
    rows = [(i, *r) for i, r in enumerate(star + clients)]
    found = run(spark, rows, "id long, src string, dst string, svc string", detect.Log("id", None, ["src", "dst", "svc"]))
    assert found.features.actor == ["src", "dst"]
    assert rows_of(found, "asymmetric_degree") == set(range(90))


def test_timing_is_gated_on_a_coarse_grid(spark):
    for step, fires in ((0.5, True), (60, False)):
        rows = [(i, int((i // 8) * step * 1e6), f"c{i % 2}", float(i)) for i in range(48)]
        df = spark.createDataFrame(rows, "id long, us long, channel string, amount double").selectExpr("id", "timestamp_micros(us) ts", "channel", "amount")
        found = detect.detect(df, detect.Log("id", "ts", ["channel"], ["amount"]), backend="deviation")
        assert found.features.gated is not fires
        for rule in ("same_instant_burst", "local_burst"):
            assert (len(rows_of(found, rule)) == 48) is fires


def test_low_cardinality_columns_do_not_concentrate(spark):
    rows = [(i, f"t{i % 3}", f"u{i % 70}" if i % 4 else "u0") for i in range(900)]
    found = run(spark, rows, "id long, kind string, user string", detect.Log("id", None, ["kind", "user"]))
    assert list(found.thresholds["categorical_concentration"]) == ["user"] and rows_of(found, "concentration") == {i for i in range(900) if not i % 4 or i % 70 == 0}


def test_planted_rows_are_found(spark, tmp_path):
    draw = lambda s, n: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(n))
    df = spark.range(600).select(F.concat(F.lit("id-"), "id").alias("uid"), F.timestamp_seconds(F.lit(1_700_000_000) + draw("t", 400_000)).alias("ts"), F.concat(F.lit("c"), draw("c", 40)).alias("channel"), (draw("a", 9000) + 0.5).alias("amount"), F.concat_ws(" ", F.lit("note"), draw("n", 10**9).cast("string"), F.md5(F.col("id").cast("string"))).alias("note"))
    path = str(tmp_path / "log.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        w.writerows([tuple(r) for r in df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).collect()])
    typed, schema = ingest.load(spark, path)
    mixed = generate.inject_bots(typed, schema, 80)
    assert mixed.count() == 680 and mixed.filter("is_injected = 1").groupBy("archetype").count().count() == 4
    mixed = mixed.withColumn("_rid", F.xxhash64("uid"))
    found = detect.detect(mixed.drop("is_injected", "archetype"), detect.Log.of(schema, "_rid"))
    scored = found.frame.join(mixed.select("_rid", F.col("is_injected").alias("planted"), "archetype"), "_rid")
    by = {r.archetype: r for r in evaluate.metrics(scored).collect()}
    assert by["burst"].recall >= 0.85 and by["mechanical_timing"].recall >= 0.85
    timed = scored.filter("is_bot and heuristic >= 0.7").agg(F.avg("planted")).first()[0]
    assert timed >= 0.9


def test_command_line(tmp_path, capsys, spark):
    log, out = str(tmp_path / "log.tsv"), str(tmp_path / "out")
    assert cli.main(["generate", "--output", log, "--legit", "180", "--bots", "60", "--seed", "3"]) == 0
    lines = open(log).read().splitlines()
    assert lines[0].split("\t") == ["event_id", "event_time", "region", "browser", "os", "url"] and len(lines) == 241
    assert cli.main(["run", "--input", log, "--output-dir", out]) == 0
    table = [x.split("\t") for x in open(f"{out}/predictions-extended.tsv").read().splitlines()]
    assert table[0][0] == "event_id" and len(table) == 241 and [r[0] for r in table[1:]] == [x.split("\t")[0] for x in lines[1:]]
    summary = json.load(open(f"{out}/artifacts/summary.json"))
    assert summary["total_events"] == 240 and summary["bot_events"] == sum(r[1] == "1" for r in table[1:])
    chosen = json.load(open(f"{out}/artifacts/selected_events.json"))
    assert len(chosen) == summary["bot_events"] and all(len(x["feature_deviations"]) <= 5 for x in chosen)
    assert {r[0] for r in table if r[1] == "1" and r[0][0] == "b"} == {r[0] for r in table if r[0][0] == "b"}
    assert cli.main(["run", "--input", str(tmp_path / "none.tsv"), "--output-dir", out]) == 2
    assert cli.main(["run", "--input", log, "--output-dir", out, "--entity-column", "nope"]) == 2
    assert cli.main(["doctor", "--output-dir", str(tmp_path)]) == 0 and cli.main(["doctor", "--input", "/none"]) == 1
    capsys.readouterr()


def shuffled_rows(spark):
    """Rows written to shuffles in this session so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_rows_are_shuffled_few_times(spark):
    rows = [(i, (i * 7_919) % 500_000 * 1_000_000, f"u{i % 400}", f"t{(i // 400) % 5}", float((i * 31) % 97)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, us long, user string, kind string, amount double").selectExpr("id", "timestamp_micros(us) ts", "user", "kind", "amount")
    before = shuffled_rows(spark)
    run(spark, df.collect(), df.schema, detect.Log("id", "ts", ["user", "kind"], ["amount"], entity=("user",)), burst_seconds=600)
    assert shuffled_rows(spark) - before < 12 * len(rows)


def test_paced_rows_are_those_of_bursts_and_runs(spark, monkeypatch):
    """A context in chunks, runs over many of them, and rows without a time."""
    at = lambda i: None if i % 50 == 7 else (i * 3 if i < 500 else 40_000 + i * i % 9_000 if i < 800 else i * 190) * 500_000
    rows = [(i, at(i), None if i % 11 == 0 and i > 900 else "big" if i < 850 else f"c{i % 9}") for i in range(1_100)]
    df = spark.createDataFrame(rows, "id long, us long, c string").selectExpr("id", "timestamp_micros(us) ts", "c")
    for context in (["c"], []):
        old = timing.runs(timing.burst_counts(df, context, "ts", 10, "burst__n"), context, "ts", "id", 10)
        expected = {r.id: r for r in old.select("id", "burst__n", "run_size", "dt_std", "dt_cv").collect()}
        joint = counts.joint(context) if context else None
        sizes = df.groupBy(joint.alias("value")).agg(F.count(F.lit(1)).alias("c")) if context else None
        held = {r.value: r.c for r in sizes.collect()} if context else {}
        for large in (100, 1 << 16):
            monkeypatch.setattr(timing, "LARGE_CONTEXT", large)
            found = timing.paced(df.withColumn("joint", joint if context else F.lit("")), joint, sizes, "ts", "id", 10).collect()
            assert len(found) == len(rows) and len(expected) == sum(r[1] is not None for r in rows)
            for r in found:
                if (e := expected.get(r.id)) is None:
                    assert r.ts is None and (r.burst__n, r.run__n, r.dt_std, r.dt_cv) == (1, 1, timing.SENTINEL, timing.SENTINEL)
                else:
                    assert (r.burst__n, r.run__n) == (e.burst__n, e.run_size) and abs(r.dt_std - e.dt_std) < 1e-9 and abs(r.dt_cv - e.dt_cv) < 1e-9
                assert not context or r.context__n == held[r.joint]
    assert max(e.run_size for e in expected.values()) > 400


def test_attached_measures_are_those_looked_up(spark, monkeypatch):
    rows = [(i, None if i % 13 == 0 else f"u{i % 37 if i % 3 else 0}", "" if i % 5 else None, float(i % 4)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a string, b string, v double")
    named = {c: F.col(c) for c in ("a", "b", "v")}
    place = {c: i for i, c in enumerate(named)}
    wanted = {f"{c}__n": (i, "c") for c, i in place.items()} | {"a__twice": (0, "twice")}
    found = counts.store(df, named).withColumn("twice", F.col("c") * 2)
    expected = sorted(map(str, counts.look_up(df, "id", named, found, wanted).select("id", *wanted).collect()))
    for values, share in ((1 << 19, 1 / 8192), (10, 0.05), (0, 1.0)):
        monkeypatch.setattr(counts, "BROADCAST_VALUES", values)
        monkeypatch.setattr(counts, "HOT_SHARE", share)
        assert sorted(map(str, counts.attach(df, "id", named, place, found, wanted).select("id", *wanted).collect())) == expected

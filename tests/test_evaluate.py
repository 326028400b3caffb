"""Sampling of whole groups and mixes with held-out truth."""

from vigilog.plans import evaluate


def sessions(spark, sizes):
    return spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "session string, at long")


def test_whole_groups_up_to_the_bound(spark):
    sizes = {f"s{i}": 1 + i % 5 for i in range(60)}
    got = {r["session"]: r["count"] for r in evaluate.sample_groups(sessions(spark, sizes), "session", 50).groupBy("session").count().collect()}
    assert got and all(sizes[k] == c for k, c in got.items())
    assert 45 < sum(got.values()) <= 50
    again = evaluate.sample_groups(sessions(spark, sizes).repartition(7), "session", 50).select("session").distinct().collect()
    assert {r[0] for r in again} == set(got)


def test_one_group_is_always_kept(spark):
    rows = evaluate.sample_groups(sessions(spark, {"a": 9, "b": 9}), "session", 3).collect()
    assert len(rows) == 9 and len({r["session"] for r in rows}) == 1


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "session string, at long")
    assert [r["at"] for r in evaluate.sample_groups(df, "session", 5).collect()] == [2]
    assert evaluate.sample_groups(df.limit(0), "session", 5).count() == 0


def test_mix_keeps_the_benign_rows(spark):
    mixed = evaluate.mix(sessions(spark, {"h": 30}), sessions(spark, {f"b{i}": 2 for i in range(20)}), "session", 10)
    assert {r["planted"]: r["count"] for r in mixed.groupBy("planted").count().collect()} == {0: 30, 1: 10}


def test_labels_slices_and_hold_out(spark):
    rows = [(k, ["Bot-a", " Bot-b ", "Normal", "To-Normal", None, "bot"][k % 6], None if k % 11 == 0 else k % 7) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, label string, t int").repartition(5)
    both = {(r.id, r.planted) for r in evaluate.labelled(df, "label", ("Bot",), ("Normal",)).collect()}
    assert both == {(k, int(k % 6 < 2)) for k in range(120) if k % 6 < 3}
    assert {r.id % 6 for r in evaluate.labelled(df, "label", ("Bot-b",), ("bot",), exact=True).collect()} == {1, 5} and evaluate.labelled(df, "label").count() == 0
    order = sorted((r for r in rows if r[0] % 6 < 2), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    assert [r.id for r in evaluate.earliest(evaluate.labelled(df, "label", ("Bot",)), "t", 15, "id").collect()] == [r[0] for r in order[:15]]
    mixed = evaluate.slice_mix(df, "label", "t", "id", ("Bot",), ("Normal",), 15, 9)
    assert mixed.columns == ["id", "t", "planted"] and sorted(r.planted for r in mixed.collect()) == [0] * 9 + [1] * 15
    seen, truth = evaluate.held_out(mixed, "planted")
    assert seen.columns == ["id", "t"] and truth.columns == mixed.columns

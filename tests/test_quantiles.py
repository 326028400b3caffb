"""Exact quantiles, ranks and thresholds: both ways of taking quantiles agree with numpy, and small, tied and constant scores have their own methods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.operators import counts, entities, robust, timing
from vigilog.plans import detect


@pytest.mark.parametrize("limit", [10**6, 0])
def test_quantiles_equal_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(counts, "SMALL_TABLE", limit)
    draw = np.random.default_rng(3)
    rows = [(float(draw.integers(0, 40)), float(x), None) for x in draw.normal(size=501)] + [(None, float("nan"), None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    found = counts.quantiles(df, ["a", "b", "c"], [0.1, 0.5, 0.99])
    for k, c in enumerate("ab"):
        own = [r[k] for r in rows if r[k] is not None and r[k] == r[k]]
        for q in (0.1, 0.5, 0.99):
            assert abs(found[c, q] - np.quantile(own, q)) < 1e-12
    assert ("c", 0.5) not in found


def scores(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, s double")


@pytest.mark.parametrize(
    ("values", "threshold", "method"),
    [([], 0.0, "empty_input"), ([0.3, float("nan"), 0.9], 0.9, "small_input_fallback"), ([0.5] * 20, 0.5, "tied_score_fallback"), ([0.5, 0.7] * 10, 0.7, "tied_score_fallback")],
)
def test_threshold_of_degenerate_scores(spark, values, threshold, method):
    assert robust.knee_threshold(scores(spark, values), "s", "id") == (threshold, method)


def test_threshold_of_an_elbow(spark):
    values = [1.0, 0.95, 0.9, 0.85] + [0.1 - 0.0004 * k for k in range(200)]
    threshold, method = robust.knee_threshold(scores(spark, values), "s", "id")
    assert method == "kneedle_descending" and 0.05 < threshold < 0.85
    assert robust.geometric_knee(scores(spark, [0.4] * 12), "s", "id").first().threshold == 0.4


def test_percentiles_keep_missing_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, 2.0)], "id long, v double")
    assert {r.id: r.percentile for r in robust.percentile_ranks(df, "v").collect()} == {1: 0.5, 2: None, 3: 1.0, 4: 0.5}


def test_runs_cross_chunks(spark):
    rows = [(k, k * 5_000_000 if k < 9000 else 90_000_000_000 + k * 1_000_000, "a" if k % 2 else None) for k in range(9100)]
    df = spark.createDataFrame(rows, "id long, us long, c string").selectExpr("id", "timestamp_micros(us) ts", "c")
    found = {(r.c, r.run): (r.run_size, r.n) for r in timing.runs(df, ["c"], "ts", "id", 10).groupBy("c", "run").agg({"run_size": "max", "id": "count"}).toDF("c", "run", "run_size", "n").collect()}
    assert found == {(c, r): (n, n) for c in ("a", None) for r, n in ((0, 4500), (1, 50))}


def test_one_row_and_constant_logs(spark):
    log = detect.Log("id", None, ["c"], ["v"])
    for rows in ([(1, "a", 1.0)], [(i, "a", 1.0) for i in range(30)]):
        found = detect.detect(spark.createDataFrame(rows, "id long, c string, v double"), log)
        assert found.frame.filter("is_bot").count() == 0 and detect.summary(found).first().n_rows == len(rows)
    assert found.method.startswith("tied_score_fallback")


def test_bins_of_all_columns_equal_those_of_one(spark):
    draw = np.random.default_rng(5)
    names = [f"c{k}" for k in range(40)]
    values = [[float(x) for x in draw.normal(size=203)] if k % 4 == 0 else [float(x) for x in draw.integers(0, 1 + k, 203)] for k in range(40)]
    for k in range(5, 40, 7):
        values[k][3::4] = [None] * len(values[k][3::4])
    values[9] = [None] * 203
    values[10] = [None] * 202 + [4.0]
    values[11] = [float("nan")] * 200 + [1.0, 1.0, 2.0]
    df = spark.createDataFrame([(i, *(v[i] for v in values)) for i in range(203)], "id long, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    bins, medians = entities.all_bins(df, names, "id")
    found = {r[0]: r[1] for r in df.select("id", bins).collect()}
    for k, c in enumerate(names[:12] + names[28:30]):
        k = int(c[1:])
        one = {r["id"]: r["bin"] for r in entities.quantile_bins(df.select("id", c), c, ["id"]).collect()}
        assert {i: row[k] for i, row in found.items()} == one, c
    for k, c in enumerate(names):
        some = [x for x in values[k] if x is not None and x == x]
        assert medians.get(c) == (float(np.median(some)) if some else None)


def test_values_are_looked_up_alike_with_and_without_a_broadcast(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"v{i % 40}", None if i % 5 == 0 else float(i % 90)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a string, b double").repartition(4)
    named = {"a": df["a"], "b": df["b"]}
    found = counts.store(df, named)
    made = []
    for limit in (10**6, 7):
        monkeypatch.setattr(counts, "BROADCAST_VALUES", limit)
        made.append(sorted(map(tuple, counts.look_up(df, "id", named, found, {"x": (0, "c"), "y": (1, "c")}).collect())))
    size = lambda k, v: sum(r[k] == v for r in rows)
    assert made[0] == made[1] == [(i, size(1, a), size(2, b)) for i, a, b in rows]


def test_long_values_are_counted_by_their_digest(spark):
    long = ["x" * 500 + str(k % 3) for k in range(9)] + ["", "\0", None]
    df = spark.createDataFrame(list(enumerate(long)), "id long, t string")
    found = {(r.code, r.c) for r in counts.store(df, {"t": df["t"]}).collect()}
    assert found == {(0, 3), (0, 1), (1, 1)} and counts.store(df, {"t": df["t"]}).count() == 6
    twice = df.select(counts.short(df["t"]).alias("s")).select("s", counts.short(F.col("s")).alias("again"))
    assert twice.filter("not (s <=> again)").count() == 0

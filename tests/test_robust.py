"""Deviations whose order the values alone decide."""

import pytest
from pyspark.sql import functions as F

from vigilog.operators import robust


@pytest.mark.parametrize("turn", [False, True])
def test_rows_of_one_key_and_equal_deviation_come_by_value(spark, turn):
    rows = [(1, 0.0), (1, 8.0), (2, 2.0), (3, 4.0), (4, 6.0)]
    df = spark.createDataFrame(rows[::-1] if turn else rows, "id long, x double").coalesce(1)
    made = robust.feature_deviations(df, "id", ["x"], F.col("id") == 1, 2).select("id", "value", "place").collect()
    assert sorted(map(tuple, made)) == [(1, 0.0, 1), (1, 8.0, 2)]


def plain_knees(values):
    """The thresholds of Kneedle (None without an elbow) and of the farthest place, row by row."""
    v = sorted(values, reverse=True)
    n, lo, hi = len(v), v[-1], v[0]
    d = [round(1 - (x - lo) / (hi - lo) - k / (n - 1), 12) for k, x in enumerate(v)]
    peaks = [k for k in range(1, n - 1) if d[k] >= d[k - 1] and d[k] > d[k + 1]]
    elbow = next((v[k] for k, end in zip(peaks, [*peaks[1:], n], strict=True) if min(d[k:end]) < d[k] - 1 / (n - 1)), None)
    return elbow, v[max(range(n), key=lambda k: (abs(d[k]), -k))]


@pytest.mark.parametrize("kinds", [3, 40, 100_000])
def test_knees_are_those_of_the_rows(spark, monkeypatch, kinds):
    import random

    monkeypatch.setattr(robust, "CHUNK", 7)
    for seed in range(3):
        draw = random.Random(seed * 100 + kinds)
        values = [round(draw.randrange(kinds) / kinds, 9) ** (1 + 2 * seed) for _ in range(300)]
        df = spark.createDataFrame(list(enumerate(values)), "id long, s double").repartition(4)
        elbow, far = plain_knees(values)
        found = robust.kneedle(df, "s", "id").first()
        assert (None if found is None else found.threshold) == elbow and robust.geometric_knee(df, "s", "id").first().threshold == far


def test_large_tables_have_the_deviations_of_small_ones(spark, monkeypatch):
    from vigilog.operators import counts

    rows = [(i, float(i * i % 37), 5.0 if i % 9 else None, float("nan") if i % 4 == 0 else i * 0.5, None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    scaled = lambda: {r.id: [round(r[f"{c}__z"], 12) for c in "abcd"] for r in robust.robust_z(df, list("abcd")).collect()}
    small = scaled()
    monkeypatch.setattr(counts, "SMALL_TABLE", 0)
    assert scaled() == small


def test_the_knee_sorts_values_instead_of_rows(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 50 / 50.0).alias("s"))
    ranked = robust._curve(df, "s")
    assert ranked.count() == 50

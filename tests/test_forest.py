"""The forest against a walk down each tree in plain Python, its properties, and the registered query's defaults."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.operators import forest
from vigilog.plans import catalogue


def plain(rows, trees, sample, seed=7):
    """Scores of rows (key, x...) by growing and walking each tree one row at a time."""
    x = {str(k): [v or 0.0 for v in vs] for k, *vs in rows}
    depth = math.ceil(math.log2(max(2, min(sample, len(x)))))
    total, usual, held = dict.fromkeys(x, 0.0), [], 0

    def grow(tree, node, level, some):
        low, high = [min(c) for c in zip(*some, strict=True)] if some else [], [max(c) for c in zip(*some, strict=True)] if some else []
        live = [f for f, (a, b) in enumerate(zip(low, high, strict=True)) if b > a]
        if level >= depth or len(some) <= 1 or not live:
            return level + forest.mean_path(len(some))
        picked = sorted(live, key=lambda f: forest._digest(seed, tree, node, "feature", f))[:2]
        w = [forest._normal(seed, tree, node, "weight", k) for k in range(len(picked))]
        cut = sum(wk * (low[f] + forest._uniform(seed, tree, node, "point", k) * (high[f] - low[f])) for k, (wk, f) in enumerate(zip(w, picked, strict=True)))
        right = lambda v: sum(wk * v[f] for wk, f in zip(w, picked, strict=True)) >= cut
        return right, grow(tree, 2 * node, level + 1, [v for v in some if not right(v)]), grow(tree, 2 * node + 1, level + 1, [v for v in some if right(v)])

    for tree in range(trees):
        some = [v for k, v in x.items() if len(x) <= sample or forest._uniform(seed, tree, k) < sample / len(x)]
        if not some:
            continue
        held += 1
        usual.append(forest.mean_path(len(some)))
        top = grow(tree, 1, 0, some)
        for k, v in x.items():
            at = top
            while isinstance(at, tuple):
                at = at[1 + at[0](v)]
            total[k] += at
    return {k: 2 ** (-(t / held) / max(np.mean(usual), 1e-9)) for k, t in total.items()}


@pytest.mark.parametrize(("n", "sample"), [(300, 64), (40, 4096), (2, 16)])
def test_scores_equal_a_plain_walk(spark, n, sample):
    draw = np.random.default_rng(1)
    rows = [(k, float(draw.normal()), None if k % 9 == 0 else float(draw.integers(0, 5)), 3.0, float(k % 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(3)
    found = {str(r.id): r.ml_score for r in forest.forest_scores(df, ["a", "b", "c", "d"], "id", trees=12, sample=sample).collect()}
    assert found == pytest.approx(plain(rows, 12, sample), rel=1e-12)


def test_outliers_score_highest_whatever_the_partitions(spark):
    draw = np.random.default_rng(2)
    rows = [(k, *map(float, draw.normal(size=5))) for k in range(600)] + [(1000, *[9.0] * 5), (1001, *[-9.0] * 5)]
    df = spark.createDataFrame(rows, "key long, " + ", ".join(f"f{k} double" for k in range(5)))
    names = df.columns[1:]
    one, two = ({r.key: r.ml_score for r in forest.forest_scores(df.repartition(p), names, "key").collect()} for p in (2, 7))
    assert one == two and set(sorted(one, key=one.get)[-2:]) == {1000, 1001} and all(0 <= s <= 1 for s in one.values())


def test_rows_are_thinned_before_they_draw_trees(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 97 as double) a", "cast(id * id % 89 as double) b")
    scores = [r.ml_score for r in forest.forest_scores(df, ["a", "b"], "id", trees=4, sample=32).collect()]
    assert len(scores) == 5000 and 0.3 < min(scores) < max(scores) < 0.9


def test_forest_scores_uses_production_defaults(spark, monkeypatch):
    seen = {}

    def record(df, columns, key, **options):
        seen.update(options)
        return df.withColumn("ml_score", df["value"])

    monkeypatch.setattr(forest, "forest_scores", record)
    catalogue.QUERIES["forest_scores"](spark, "/root/testdata/sf0.001")
    assert not seen.keys() & {"trees", "sample"}


def test_each_row_draws_its_trees_however_many_rows_there_are(spark):
    draw = np.random.default_rng(4)
    rows = [(k, float(draw.normal()), float(draw.normal())) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    found = {str(r.id): r.ml_score for r in forest.forest_scores(df, ["a", "b"], "id", trees=3, sample=32).collect()}
    assert found == pytest.approx(plain(rows, 3, 32), rel=1e-12)


@pytest.mark.parametrize("share", [0.5, 1e-9, 1 / 3, 1 - 2**-33])
def test_draws_told_from_digits_are_those_told_from_numbers(spark, share):
    found = spark.range(2000).select(forest.below(share, F.lit(7), F.col("id").cast("string"), F.lit("x")).alias("b")).collect()
    assert [r.b for r in found] == [forest._uniform(7, k, "x") < share for k in range(2000)]

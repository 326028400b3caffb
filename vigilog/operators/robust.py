"""Robust deviations, percentile ranks and knee thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def robust_z(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<c>__z``: (x - median) / scale; scale is 1.4826 MAD, else the population deviation, else 1."""
    from ..session import materialise
    from .counts import SMALL_TABLE, quantiles, sized_quantiles, value_sizes

    if df.count() <= SMALL_TABLE:
        median = quantiles(df, columns, [0.5])
        away = df.select(*[F.abs(F.col(c) - F.lit(median.get((c, 0.5)))).alias(c) for c in columns])
        mad = quantiles(away, columns, [0.5])
    else:
        # the values are counted once; their distances have the same counts
        sizes = materialise(value_sizes(df, columns), "sizes")
        median = sized_quantiles(sizes, columns, [0.5])
        middle = F.element_at(F.create_map(*[x for (c, _), m in median.items() for x in (F.lit(c), F.lit(float(m)))]), F.col("column")) if median else F.lit(0.0)
        mad = sized_quantiles(sizes.groupBy("column", F.abs(F.col("v") - middle).alias("v")).agg(F.sum("c").alias("c")).filter(~F.isnan("v")), columns, [0.5])
    flat = [c for c in columns if not mad.get((c, 0.5))]
    std = df.agg(*[F.stddev_pop(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in flat]).first() if flat else {}
    made = []
    for c in columns:
        scale = 1.4826 * mad[c, 0.5] if mad.get((c, 0.5)) else std[c] or 1.0
        z = (F.col(c) - F.lit(median.get((c, 0.5)))) / F.lit(float(scale))
        made.append(F.when(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), 0.0).otherwise(z).alias(f"{c}__z"))
    return df.select("*", *made)


def deviation_score(df: DataFrame, columns: list[str], out: str = "ml_score") -> DataFrame:
    """Add the mean absolute robust z, scaled to 0..1 (0.5 if constant)."""
    scored = robust_z(df, columns)
    raw = sum((F.abs(F.col(f"{c}__z")) for c in columns), F.lit(0.0)) / len(columns)
    scored = scored.withColumn("_raw", raw)
    span = scored.agg(F.min("_raw").alias("lo"), F.max("_raw").alias("hi")).first()
    unit = (F.col("_raw") - F.lit(span.lo)) / F.lit(span.hi - span.lo) if span.lo is not None and span.hi > span.lo else F.lit(0.5)
    return scored.withColumn(out, unit).drop("_raw", *[f"{c}__z" for c in columns])


def percentile_ranks(df: DataFrame, col: str, out: str = "percentile") -> DataFrame:
    """Add the average rank over the number of rows with a value (null without one); ranks come from the value counts."""
    from .counts import global_rank

    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = global_rank(counts, [F.col(col)], "_pos").withColumn("_part", F.floor(F.col("_pos") / 100_000))
    sums = ranked.groupBy("_part").agg(F.sum("_c").alias("_sum"))
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_all"))
    within = F.sum("_c").over(Window.partitionBy("_part").orderBy("_pos"))
    placed = ranked.withColumn("_till", within).join(F.broadcast(sums), "_part")
    rank = (F.col("_before") + F.col("_till") - F.col("_c") + (F.col("_c") + 1) / 2) / F.col("_all")
    return df.join(placed.select(col, rank.alias(out)), col, "left")


def feature_deviations(df: DataFrame, key: str, columns: list[str], chosen, top_k: int = 5) -> DataFrame:
    """key, feature, value, z, place: the largest deviations of the ``chosen`` rows, ties in feature order and then, where rows share a key, by value."""
    z = robust_z(df, columns).filter(chosen)
    kv = F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.col(f"{c}__z").alias("z")) for i, c in enumerate(columns)]))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("z"), 9)), "ord", "value"))
    return z.select(key, kv).withColumn("place", place).filter(F.col("place") <= top_k).drop("ord")


def batch_percentiles(df: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``percentile`` to (feature, value) rows: the value's average rank in its column over the number of values.

    All columns are ranked at once, in range-partitioned value counts.
    """
    from ..session import materialise

    kv = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(kv).filter("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    placed = materialise(counts.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value").withColumn("part", F.spark_partition_id()), "ranked")
    sums = placed.groupBy("feature", "part").agg(F.sum("c").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("feature", "part", before.alias("before"), F.sum("n").over(Window.partitionBy("feature")).alias("all"))
    till = F.sum("c").over(Window.partitionBy("feature", "part").orderBy("value"))
    ranked = placed.withColumn("till", till).join(F.broadcast(sums), ["feature", "part"])
    rank = (F.col("before") + F.col("till") - F.col("c") + (F.col("c") + 1) / 2) / F.col("all")
    return chosen.join(ranked.select("feature", "value", rank.alias("percentile")), ["feature", "value"], "left")


#: Values in a chunk of the curve.
CHUNK = 1 << 16


def _curve(df: DataFrame, col: str) -> DataFrame:
    """A row for each value of the falling sorted curve: value, rank (from 1), its first and last places, n, x and last_x of both and y in 0..1; a constant curve has a null y.

    Between its first and last places a value's distance to the diagonal only falls, so the rows of equal values need no order.
    """
    from .counts import global_rank

    values = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    ranked = global_rank(values, [F.desc("value")], "rank").withColumn("chunk", F.floor((F.col("rank") - 1) / CHUNK))
    sums = ranked.groupBy("chunk").agg(F.sum("c").alias("k"))  # a row for each chunk
    before = F.coalesce(F.sum("k").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("chunk", before.alias("before"), F.sum("k").over(Window.partitionBy()).alias("n"))
    till = F.sum("c").over(Window.partitionBy("chunk").orderBy("rank"))
    span = ranked.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    wide = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    placed = ranked.withColumn("till", till).join(F.broadcast(sums), "chunk").withColumn("last", F.col("before") + F.col("till")).withColumn("pos", F.col("last") - F.col("c") + 1)
    share = lambda at: (F.col(at) - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return placed.crossJoin(F.broadcast(span)).select("value", "rank", "pos", "last", "n", share("pos").alias("x"), share("last").alias("last_x"), ((F.col("value") - F.col("lo")) / wide).alias("y"))


def geometric_knee(df: DataFrame, col: str, key: str) -> DataFrame:
    """One row, ``threshold``: the sorted score farthest from the falling diagonal, the first on ties."""
    far = lambda x: F.round(F.abs(F.coalesce("y", F.lit(0.0)) - (1 - F.col(x))), 12)
    place = F.when(far("last_x") > far("x"), F.col("last")).otherwise(F.col("pos"))
    return _curve(df, col).orderBy(F.desc(F.greatest(far("x"), far("last_x"))), place).limit(1).select(F.col("value").alias("threshold"))


def kneedle(df: DataFrame, col: str, key: str, sensitivity: float = 1.0) -> DataFrame:
    """One row, ``threshold``, or none: the first elbow of the sorted scores (convex, decreasing), from the Kneedle paper.

    The gap between the diagonal and the curve has an elbow at a local maximum
    after which, before the next one, it falls by ``sensitivity`` mean steps.
    The values are cut into chunks with their neighbours' edges, so no window
    holds the whole curve.
    """
    gap = lambda x: F.round(1 - F.col("y") - F.col(x), 12)
    curve = _curve(df, col).filter("y is not null").select("value", "rank", "pos", "last", "n", gap("x").alias("d"), gap("last_x").alias("end"))
    home = F.floor((F.col("rank") - 1) / CHUNK)
    spread = curve.withColumn("chunk", F.explode(F.array_distinct(F.array(home, F.floor(F.col("rank") / CHUNK), F.floor((F.col("rank") - 2) / CHUNK))))).withColumn("home", home)
    order = Window.partitionBy("chunk").orderBy("rank")
    falls = (F.col("last") > F.col("pos")) | (F.col("d") > F.lead("d").over(order))
    peak = (F.col("d") >= F.lag("end").over(order)) & falls & (F.col("pos") > 1) & (F.col("pos") < F.col("n"))
    marked = spread.withColumn("peak", F.coalesce(peak, F.lit(False)).cast("long")).filter("chunk = home")
    within = marked.withColumn("own", F.sum("peak").over(order))
    sums = marked.groupBy("chunk").agg(F.sum("peak").alias("k"))  # a row for each chunk
    sums = sums.select("chunk", F.coalesce(F.sum("k").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    stretch = within.join(F.broadcast(sums), "chunk").withColumn("stretch", F.col("own") + F.col("before")).filter("stretch > 0")
    each = stretch.groupBy("stretch").agg(F.min_by("value", "pos").alias("threshold"), F.min_by("d", "pos").alias("top"), F.min("end").alias("low"), F.first("n").alias("n"), F.min("pos").alias("pos"))
    return each.filter(F.col("low") < F.col("top") - sensitivity / (F.col("n") - 1)).orderBy("pos").limit(1).select("threshold")


def knee_threshold(df: DataFrame, col: str, key: str) -> tuple[float, str]:
    """The self-tuned threshold of the finite scores, and the method that gave it."""
    finite = df.select(key, F.col(col).cast("double").alias(col)).filter(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf")))
    some = finite.agg(F.count(F.lit(1)).alias("n"), F.max(col).alias("top"), F.approx_count_distinct(col).alias("kinds")).first()
    if not some.n:
        return 0.0, "empty_input"
    if some.n < 10:
        return some.top, "small_input_fallback"
    if some.kinds < 10 and finite.select(col).distinct().limit(3).count() < 3:
        return some.top, "tied_score_fallback"
    found = kneedle(finite, col, key).first()
    if found is not None:
        return found.threshold, "kneedle_descending"
    return geometric_knee(finite, col, key).first().threshold, "max_distance_descending_fallback"

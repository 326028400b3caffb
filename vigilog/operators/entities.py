"""Behaviour of entities: quantile bins, diversity, degree, and the actor graph."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import column_counts, global_rank, placed_rows, rows_of_rank


def quantile_bins(df: DataFrame, col: str, key: list[str], bins: int = 8, out: str = "bin") -> DataFrame:
    """Add the quantile bin of the rank (ties by ``key``); -1 where missing or the only value."""
    some = global_rank(df.filter(F.col(col).isNotNull() & ~F.isnan(col)), [F.col(col), *map(F.col, key)], "_rank")
    n = df.filter(F.col(col).isNotNull() & ~F.isnan(col)).agg(F.count(F.lit(1)).alias("_count"))
    at = F.when(F.col("_count") > 1, F.greatest(F.floor(((F.col("_rank") - 1) * bins + F.col("_count") - 2) / (F.col("_count") - 1)) - 1, F.lit(0))).otherwise(-1)
    some = some.crossJoin(F.broadcast(n)).withColumn(out, at.cast("int")).drop("_rank", "_count")
    none = df.filter(F.col(col).isNull() | F.isnan(col)).withColumn(out, F.lit(-1))
    return some.unionByName(none)


def all_bins(df: DataFrame, columns: list[str], key: str, bins: int = 8) -> tuple[Column, dict[str, float]]:
    """The quantile bins of all numeric columns as one array, and the columns' medians (none for columns without a value).

    The bins are those of ``quantile_bins`` with one ordering ``key``: bin b begins
    at rank b (n - 1) div bins + 2 of the n values, so the rows of these ranks are
    all that the expression needs of the table.
    """
    rows, stretches = placed_rows(df, columns, key)
    size = {c: sum(n for _, _, n in stretches[c]) for c in columns}
    # ranks from 0
    begins = {c: [b * (size[c] - 1) // bins + 1 for b in range(1, bins)] if size[c] > 1 else [] for c in columns}
    middle = {c: [(size[c] - 1) // 2, size[c] // 2] for c in columns if size[c]}
    found = rows_of_rank(rows, stretches, {c: begins[c] + middle.get(c, []) for c in columns})
    kind = df.schema[key].dataType.simpleString()
    bounds = [[(float(found[c, r][0]), found[c, r][1]) for r in begins[c] if (c, r) in found] if size[c] > 1 else None for c in columns]
    known = df.sparkSession.createDataFrame([], f"b array<array<struct<v:double,k:{kind}>>>").schema["b"].dataType
    table = F.from_json(F.lit(_json(bounds)), known.json(), {"allowNonNumericNumbers": "true"}) if kind in ("bigint", "int", "string") else F.array(*[F.array(*[F.struct(F.lit(v).alias("v"), F.lit(k).alias("k")) for v, k in b]) if b else F.lit(None) for b in bounds])
    values = F.array(*[F.col(c).cast("double") for c in columns])
    begun = lambda v, i: F.size(F.filter(F.get(table, i), lambda b: (v > b["v"]) | ((v == b["v"]) & (F.col(key) >= b["k"]))))
    made = F.transform(values, lambda v, i: F.when(v.isNull() | F.isnan(v) | F.get(table, i).isNull(), F.lit(-1)).otherwise(begun(v, i)))
    return made, {c: sum(found[c, r][0] for r in middle[c]) / 2 for c in middle}


def _json(bounds: list) -> str:
    return json.dumps([b if b is None else [{"v": v, "k": k} for v, k in b] for b in bounds])


def normal_entropy(counts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Entropy of the counts ``c`` per key over the log of their sum (0 for one row), and that sum as volume."""
    n = F.sum("c")
    value = F.when(n > 1, (F.log(n) - F.sum(F.col("c") * F.log("c")) / n) / F.log(n)).otherwise(0.0)
    return counts.groupBy(*keys).agg(value.alias(out), n.alias("volume"))


#: Behaviours that a table holds as one array; their names are places in it.
BINS = "_bins"


def diversities(df: DataFrame, columns: list[tuple[str, list[str]]], n_bins: int = 0) -> DataFrame:
    """column, value, diversity (mean normal entropy over the behaviour columns, 1.0 below two rows or without any), volume; a missing value is a value.

    The first ``n_bins`` entries of the array BINS are behaviours of every column.
    """
    bare = [c for c, others in columns if not others and not n_bins]
    some = [(c, others) for c, others in columns if c not in bare]
    parts = []
    if some:
        every = list(dict.fromkeys(b for _, others in some for b in others))
        held = F.array(*[F.col(b).cast("string") for b in every])
        if n_bins:
            held = F.concat(held.cast("array<string>"), F.col(BINS).cast("array<string>"))
        named = F.inline(F.array(*[F.struct(F.lit(i).alias("who"), F.col(c).cast("string").alias("value")) for i, (c, _) in enumerate(some)]))
        rows = df.select(named, held.alias("all")).select("who", "value", F.posexplode("all").alias("of", "v"))
        for i, (_, others) in enumerate(some):
            if left := [k for k, b in enumerate(every) if b not in others]:
                rows = rows.filter(~((F.col("who") == i) & F.col("of").isin(left)))
        counts = rows.groupBy("who", "value", "of", "v").agg(F.count(F.lit(1)).alias("c"))
        each = normal_entropy(counts, ["who", "value", "of"], "d")
        mean = F.when(F.max("volume") < 2, 1.0).otherwise(F.avg("d"))
        per = each.groupBy("who", "value").agg(mean.alias("diversity"), F.max("volume").alias("volume"))
        parts.append(per.select(F.element_at(F.array(*[F.lit(c) for c, _ in some]), F.col("who") + 1).alias("column"), "value", "diversity", "volume"))
    if bare:
        parts.append(column_counts(df, bare).select("column", "value", F.lit(1.0).alias("diversity"), F.col("c").alias("volume")))
    return reduce(DataFrame.union, parts)


def diversity(df: DataFrame, entity: str, behaviour: list[str]) -> DataFrame:
    """The entity column's value, diversity and volume."""
    kind = df.schema[entity].dataType.simpleString()
    return diversities(df, [(entity, behaviour)]).select(F.col("value").cast(kind).alias(entity), "diversity", "volume")


def edges(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, other: distinct links of each column's values with those of the other columns, by one unpivot."""
    pairs = [F.struct(F.lit(a).alias("column"), F.col(a).cast("string").alias("value"), F.col(b).cast("string").alias("other")) for a in columns for b in columns if a != b]
    return df.select(F.inline(F.array(*pairs))).distinct()


def degrees(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, degree: distinct other values, the value itself not counted."""
    linked = edges(df, columns)
    return linked.groupBy("column", "value").agg(F.count(F.when(~F.col("other").eqNullSafe(F.col("value")), F.lit(1))).alias("degree"))


def entity_table(df: DataFrame, columns: list[str], behaviour: list[str], n_bins: int = 0) -> DataFrame:
    """column, value, diversity over the other behaviour columns, volume, degree over the other entity columns (0 without any)."""
    made = diversities(df, [(c, [b for b in behaviour if b != c]) for c in columns], n_bins)
    if len(columns) < 2:
        return made.withColumn("degree", F.lit(0).cast("long"))
    return _same(made, degrees(df, columns), "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on column and value, missing values alike."""
    b = b.withColumnsRenamed({"column": "_column", "value": "_value"})
    return a.join(b, (F.col("column") == F.col("_column")) & F.col("value").eqNullSafe(F.col("_value")), how).drop("_column", "_value")


def actor_graph(df: DataFrame, columns: list[str], context: list[str], n_bins: int = 0) -> DataFrame:
    """column, value, degree, reverse_degree (of the same value in the other columns), volume, diversity over ``context``.

    ``df`` is read twice: pass a written table where it is costly.
    """
    nodes = degrees(df, columns)
    # the best degree of the same value elsewhere: at most one degree a column
    best = nodes.groupBy("value").agg(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("neg"), "column"))).alias("all"))
    elsewhere = F.filter("all", lambda x: x["column"] != F.col("column"))
    nodes = nodes.join(best.withColumnRenamed("value", "value2"), F.col("value").eqNullSafe(F.col("value2")))
    nodes = nodes.select("column", "value", "degree", F.coalesce(-F.get(elsewhere, F.lit(0))["neg"], F.lit(0)).alias("reverse_degree"))
    measured = diversities(df, [(c, context) for c in columns], n_bins)
    return _same(nodes, measured).select("column", "value", "degree", "reverse_degree", "volume", "diversity")


# What makes a column one of entities or of actors.
MIN_ENTITIES, MIN_MEDIAN, MIN_ACTORS, MIN_EVENTS, MIN_BUSY, MIN_REPEAT, MAX_WORDS = 10, 2, 50, 12, 2, 0.30, 200


def column_shapes(counts: DataFrame) -> dict[str, dict]:
    """Per column of ``counts`` (column, value, c): distinct values, median count, busy values and repeat mass (missing included), path and vocabulary shape."""
    from ..functions.text import PATH_SIGNS, is_structured

    real = F.col("value").isNotNull()
    size = F.col("c")
    # the median of the counts comes from their own counts, which are few
    medians = counts.filter(real).groupBy("column", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("column").agg(F.expr("percentile(c, 0.5, k)").alias("median"))
    made = counts.groupBy("column").agg(
        F.count_if(real).alias("distinct"),
        F.count_if(size >= MIN_EVENTS).alias("busy"),
        (F.sum(F.when(size >= MIN_EVENTS, size).otherwise(0)) / F.sum(size)).alias("repeat"),
        F.avg(F.when(real, F.substring("value", 1, 1).isin(PATH_SIGNS).cast("double"))).alias("path"),
        F.avg(F.when(real, is_structured(F.col("value")).cast("double"))).alias("structured"),
    )
    return {r["column"]: r.asDict() for r in made.join(medians, "column", "left").collect()}


def _words_or_paths(shape: dict) -> bool:
    return (shape["distinct"] <= MAX_WORDS and (shape["structured"] or 0.0) < 0.5) or (shape["path"] or 0.0) >= 0.9


def entity_columns(shapes: dict[str, dict], categorical: list[str], content: list[str] = (), forced: list[str] = ()) -> list[str]:
    """Categorical columns of stable, recurring names, in order; forced ones skip all but the volume floors."""
    out = []
    for c in categorical:
        s = shapes.get(c)
        if s and s["distinct"] >= MIN_ENTITIES and s["median"] >= MIN_MEDIAN and (c in forced or not (c in content or _words_or_paths(s))):
            out.append(c)
    return out


def actor_columns(shapes: dict[str, dict], columns: list[str], content: list[str] = (), forced: list[str] = ()) -> list[str]:
    """Categorical and text columns whose values can be endpoints, in order."""
    out = []
    for c in columns:
        s = shapes.get(c)
        if s and s["distinct"] > MIN_ACTORS and s["busy"] >= MIN_BUSY and s["repeat"] >= MIN_REPEAT and (c in forced or not (c in content or _words_or_paths(s))):
            out.append(c)
    return out


def degree_floor(graph: DataFrame) -> DataFrame:
    """One row, ``floor``: 99th percentile of the degrees of at least 3; null if there is none."""
    return graph.filter("degree >= 3").agg(F.expr("percentile(degree, 0.99)").alias("floor"))


def asymmetric(graph: DataFrame, source: str) -> DataFrame:
    """Nodes of the source column that reach widely, one-sidedly and monotonously."""
    joined = graph.filter(F.col("column") == source).crossJoin(F.broadcast(degree_floor(graph)))
    return joined.filter("volume >= 12 and degree >= floor and degree >= 10 * (reverse_degree + 1) and round(diversity, 12) <= 0.2").drop("floor")


def monotony_cut(per_row: DataFrame, floor: int = 12) -> DataFrame:
    """One row, ``cut``: the 10 % quantile over rows of the diversity of busy entities, at most 0.20; 0 if none."""
    busy = per_row.filter(F.col("volume") >= floor)
    return busy.agg(F.least(F.lit(0.2), F.coalesce(F.expr("percentile(round(diversity, 12), 0.1)"), F.lit(0.0))).alias("cut"))

"""Value and context counts, joined back from small count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tables of at most so many rows have their quantiles taken by one aggregation.
SMALL_TABLE = 200_000


def value_counts(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add the number of rows sharing the value; missing counts 0.

    Only values of several rows are joined back, so near-unique columns need a small table.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out)).filter(F.col(out) > 1)
    alone = F.when(F.col(col).isNotNull(), 1).otherwise(0).cast("long")
    return df.join(counts, col, "left").withColumn(out, F.coalesce(out, alone))


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (string, null where missing), c: the value counts of all columns by one aggregation."""
    kv = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(kv).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))


def cuts(counts: DataFrame) -> DataFrame:
    """column, cut: nearest-rank 99th percentile of the distinct sizes of the column's values."""
    sizes = counts.filter("value is not null").select("column", "c").distinct()
    return sizes.groupBy("column").agg(F.expr("percentile_disc(0.99) within group (order by c)").alias("cut"))


def quantiles(df: DataFrame, columns: list[str], fractions: list[float]) -> dict[tuple[str, float], float]:
    """Exact quantiles (linear between ranks) of numeric columns, from their sorted value counts; nulls and NaN don't count.

    The counts are range-partitioned and summed in place, so no task holds a column's distinct values.
    """
    if df.count() <= SMALL_TABLE:
        # few values: one aggregation, whose buffers hold a column's values
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        row = df.agg(*[F.percentile(value(c), fractions).alias(c) for c in columns]).first()
        return {(c, q): x for c in columns if row[c] is not None for q, x in zip(fractions, row[c], strict=True)}
    return sized_quantiles(value_sizes(df, columns), columns, fractions)


def value_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, v, c: the counts of the values of numeric columns; nulls and NaN are left out."""
    kv = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    return df.select(kv).filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))


def sized_quantiles(counts: DataFrame, columns: list[str], fractions: list[float]) -> dict[tuple[str, float], float]:
    """The quantiles of ``quantiles`` from value counts."""
    from ..session import materialise

    placed = counts.repartitionByRange("column", "v").sortWithinPartitions("column", "v")
    placed = materialise(placed.withColumn("part", F.spark_partition_id()), "quantiles")
    sums = placed.groupBy("column", "part").agg(F.sum("c").alias("n"))  # a row for each column and partition
    before = F.coalesce(F.sum("n").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("column", "part", before.alias("before"), F.sum("n").over(Window.partitionBy("column")).alias("all"))
    till = F.sum("c").over(Window.partitionBy("column", "part").orderBy("v"))
    ranked = placed.withColumn("till", till).join(F.broadcast(sums), ["column", "part"])
    ranked = ranked.select("column", "v", (F.col("till") + F.col("before") - F.col("c")).alias("low"), (F.col("till") + F.col("before")).alias("high"), "all")
    places = [f(F.lit(q) * (F.col("all") - 1)) for q in fractions for f in (F.floor, F.ceil)]
    held = F.exists(F.array(*places), lambda p: (p >= F.col("low")) & (p < F.col("high")))
    found = ranked.filter(held).collect()  # two rows at most for each column and fraction
    out = {}
    for c in columns:
        own = [r for r in found if r["column"] == c]
        for q in fractions:
            if own:
                at = q * (own[0]["all"] - 1)
                low, high = (next(r.v for r in own if r.low <= k < r.high) for k in (int(at // 1), int(-(-at // 1))))
                out[c, q] = low + (high - low) * (at - int(at // 1))
    return out


#: Repeated values whose counts are broadcast at most.
BROADCAST_VALUES = 1 << 19
#: Longer values are counted by their digest.
MAX_VALUE = 80


def short(v: Column) -> Column:
    """The text form of a value; a long one as its first character and digest, so equal only where the values are."""
    v = v.cast("string")
    return F.when(F.char_length(v) > MAX_VALUE, F.concat(F.substring(v, 1, 1), F.lit("\0"), F.sha2(v, 256))).otherwise(v)


def joint(columns: list[str]) -> Column:
    """One text for the values of all columns, different for different values; a missing value is a value."""
    return short(F.concat(*[F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]))


def cells(df: DataFrame, keep: list[str], named: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` with (code, value), a row for each named value: twice its place, plus one where it is missing, and its short form.

    Only the cast to text is written out for each column; all else is done once, behind the unpivot.
    """
    long = df.select(*keep, F.posexplode(F.array(*[v.cast("string") for v in named.values()])).alias("_place", "_v"))
    return long.select(*keep, (2 * F.col("_place") + F.col("_v").isNull().cast("int")).alias("code"), F.coalesce(short(F.col("_v")), F.lit("")).alias("value"))


def store(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """code, value, c: the written value counts of all the named values, missing ones apart, by one aggregation."""
    from ..session import materialise

    return materialise(cells(df, [], named).groupBy("code", "value").agg(F.count(F.lit(1)).alias("c")), "counts")


def as_column_counts(stored: DataFrame, names: list[str]) -> DataFrame:
    """The store in the form of ``column_counts`` for its first columns, which are ``names``."""
    name = F.element_at(F.array(*map(F.lit, names)), F.floor(F.col("code") / 2).cast("int") + 1)
    return stored.filter(F.col("code") < 2 * len(names)).select(name.alias("column"), F.when(F.col("code") % 2 == 0, F.col("value")).alias("value"), "c")


def coded(table: DataFrame, place: dict[str, int]) -> DataFrame:
    """A table of (column, value, measures) with the store's code in place of the column's name."""
    code = F.element_at(F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.lit(2 * i))]), F.col("column")) + F.col("value").isNull().cast("int")
    return table.select(code.alias("code"), F.coalesce(short(F.col("value")), F.lit("")).alias("value"), *[c for c in table.columns if c not in ("column", "value")])


def matched(long: DataFrame, found: DataFrame, at: list[str]) -> DataFrame:
    """The rows of ``long`` whose value ``found`` (unique by ``at``, with a count ``c``) holds.

    If ``found`` is more than can be broadcast, its most frequent values are
    broadcast all the same, by a count that so many values can't have, and the rest
    are joined by a shuffle in which no value is frequent.
    """
    if found.count() <= BROADCAST_VALUES:
        return long.join(F.broadcast(found), at)
    least = found.agg(F.sum("c")).first()[0] // BROADCAST_VALUES + 1  # of at least so many rows there are no more than BROADCAST_VALUES values
    many, few = F.broadcast(found.filter(F.col("c") >= least)), found.filter(F.col("c") < least)
    return long.join(many, at).unionByName(long.join(F.broadcast(many.select(*at)), at, "left_anti").join(few, at))


def look_up(df: DataFrame, key: str, named: dict[str, Column], found: DataFrame, wanted: dict[str, tuple[int, str]]) -> DataFrame:
    """key and the ``wanted`` columns (name: place of the value and measure), from ``found`` (code, value, measures), null where it has none.

    All values are looked up together: rows are dealt out by key once, unpivoted,
    joined, and put together again in the same task.
    """
    joined = matched(cells(df.repartition(key), [key], named), found, ["code", "value"])
    picked = [F.expr(f"max(CASE WHEN _place = {i} THEN `{m}` END) AS `{name}`") for name, (i, m) in wanted.items()]
    return joined.withColumn("_place", F.floor(F.col("code") / 2)).groupBy(key).agg(*picked)


#: Up to so many columns each value is joined to its row; more are unpivoted and looked up together.
NARROW = 16
#: Values that hold more than this share of a column's rows don't travel to a shuffled join.
HOT_SHARE = 1 / (1 << 13)


def attach(df: DataFrame, key: str, named: dict[str, Column], place: dict[str, int], found: DataFrame, wanted: dict[str, tuple[int, str]]) -> DataFrame:
    """``df`` with the ``wanted`` columns of ``look_up``, joined column by column, so that the rows are neither unpivoted nor grouped.

    The columns of fewest values are broadcast, BROADCAST_VALUES values in all; for
    another its frequent values are, and the rest are joined by a shuffle.
    """
    at = F.floor(F.col("code") / 2).cast("int")
    sizes = {r["i"]: (r["n"], r["c"]) for r in found.groupBy(at.alias("i")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()}
    held = 0
    for name in sorted(named, key=lambda c: sizes.get(place[c], (0, 0))):
        i = place[name]
        n, rows = sizes.get(i, (0, 0))
        measures = {out: m for out, (p, m) in wanted.items() if p == i}
        text = named[name].cast("string")
        df = df.withColumns({"_code": 2 * F.lit(i) + text.isNull().cast("int"), "_value": F.coalesce(short(text), F.lit(""))})
        own = found.filter(at == i).select(F.col("code").alias("_code"), F.col("value").alias("_value"), "c", *[F.col(m).alias(out) for out, m in measures.items()])
        held += n
        if held <= BROADCAST_VALUES:
            df = df.join(F.broadcast(own.drop("c")), ["_code", "_value"], "left").drop("_code", "_value")
            continue
        held -= n
        hot = F.col("c") > rows * HOT_SHARE  # of fewer than 1 / HOT_SHARE values
        few = own.filter(~hot).drop("c").withColumn("_deal", F.lit(-1).cast("long")).withColumnsRenamed({out: f"_few_{out}" for out in measures})
        df = df.join(F.broadcast(own.filter(hot).drop("c").withColumn("_hot", F.lit(True))), ["_code", "_value"], "left")
        # rows that have their measures are dealt out by key and meet nothing
        df = df.withColumn("_deal", F.when(F.col("_hot"), F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1))).otherwise(F.lit(-1).cast("long")))
        df = df.join(few, ["_code", "_value", "_deal"], "left").withColumns({out: F.coalesce(out, f"_few_{out}") for out in measures})
        df = df.drop("_code", "_value", "_deal", "_hot", *[f"_few_{out}" for out in measures])
    return df


def map_concentration(df: DataFrame, key: str, column: str, out: str) -> DataFrame:
    """key and ``out``: the mean of log1p of the counts of a map's entries (those of one row count 1); rows without entries are left out."""
    from ..session import materialise

    entry = lambda e: short(F.concat(F.char_length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    entries = F.transform(F.map_entries(F.col(column)), entry)
    stored = materialise(df.select(F.explode(entries).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "entries")
    long = df.repartition(key).select(key, F.explode(entries).alias("value"))
    sums = matched(long, stored, ["value"]).groupBy(key).agg(F.sum(F.log1p("c")).alias("_sum"), F.count(F.lit(1)).alias("_held"))
    size = F.size(column)
    held = df.filter(size > 0).select(key, size.alias("_size")).join(sums, key, "left")
    return held.select(key, ((F.coalesce("_sum", F.lit(0.0)) + (F.col("_size") - F.coalesce("_held", F.lit(0))) * F.log1p(F.lit(1.0))) / F.col("_size")).alias(out))


def placed_rows(df: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, dict[str, list]]:
    """All values of the numeric ``columns``, sorted by column, value and key over range partitions and written once.

    Returns the table (column, v, key, at) and for each column its stretches
    (first ``at``, rows before it, rows), of which there are as many as partitions
    and columns together; the row of any rank is so found by its ``at``.
    """
    from ..session import materialise

    kv = F.inline(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    rows = df.select(F.col(key).alias("key"), kv).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = materialise(rows.repartitionByRange("column", "v", "key").sortWithinPartitions("column", "v", "key").withColumn("at", F.monotonically_increasing_id()), "placed")
    sizes = rows.groupBy("column", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("column", "part").collect()
    stretches: dict[str, list] = {c: [] for c in columns}
    for r in sizes:
        own = stretches[columns[r["column"]]]
        own.append((r["first"], own[-1][1] + own[-1][2] if own else 0, r["n"]))
    return rows, stretches


def rows_of_rank(rows: DataFrame, stretches: dict[str, list], ranks: dict[str, list[int]]) -> dict[tuple[str, int], tuple]:
    """(value, key) of the rows of the given ranks (from 0) of each column of ``placed_rows``."""
    wanted = {}
    for c, some in ranks.items():
        for rank in some:
            for first, before, n in stretches[c]:
                if before <= rank < before + n:
                    wanted[first + rank - before] = wanted.get(first + rank - before, []) + [(c, rank)]
    found = rows.filter(F.col("at").isin(list(wanted))).select("at", "v", "key").collect() if wanted else []
    return {who: (r["v"], r["key"]) for r in found for who in wanted[r["at"]]}


def joint_counts(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """Add the number of rows sharing all values; a missing value is a value."""
    counts = df.groupBy(*[F.col(c).alias(f"_{c}") for c in cols]).agg(F.count(F.lit(1)).alias(out))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(counts, same).drop(*[f"_{c}" for c in cols])


def adaptive_cut(df: DataFrame, cols: list[str], floor: int) -> DataFrame:
    """One row, ``cut``: nearest-rank 99th percentile of the distinct group sizes, at least ``floor``."""
    sizes = df.filter(F.col(cols[0]).isNotNull() if len(cols) == 1 else F.lit(True)).groupBy(*cols).count().select("count").distinct()
    return sizes.agg(F.greatest(F.lit(floor).cast("double"), F.expr("percentile_disc(0.99) within group (order by count)")).alias("cut"))


def global_rank(df: DataFrame, order: list, out: str) -> DataFrame:
    """Add the 1-based position in the total ``order`` without a single-task sort.

    Rows are range-partitioned and sorted in place; the partitions' sizes (one
    number each) give the offsets.
    """
    from ..session import materialise

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row for each partition
    return placed.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")

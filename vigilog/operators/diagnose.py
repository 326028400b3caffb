"""Diagnostics of columns that might name actors: how selective their values are, what their values look like, and whether they would pass as endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import BROADCAST_VALUES
from .entities import MAX_WORDS, MIN_ACTORS, MIN_BUSY, MIN_EVENTS, MIN_REPEAT

# Fixed value: the signs that separate the parts of a name.
SEPARATORS = ".:_-/"


def as_text(df: DataFrame, column: str) -> Column:
    """The column's values as text, whole numbers without a fraction, as integers were written before missing ones made them fractions."""
    v = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() in ("double", "float"):
        v = F.when(~F.isnan(v), v)
        return F.when((F.abs(v) < 2**53) & (v == F.floor(v)), v.cast("long").cast("string")).otherwise(v.cast("string"))
    return v.cast("string")


def selectivity(df: DataFrame, pairs: list[tuple[str, str]], min_events: int = MIN_EVENTS) -> DataFrame:
    """column, other, recurring_values, selectivity: how far the recurring values of a column keep to values of their own in the other column.

    A value of n rows meets a share of the other column's values; independent
    draws from that column would meet ``sum(1 - (1 - p)^n)`` of them.  The ratio,
    weighted by n, is near 1 for words that mix freely and far below for actors.
    Expected values depend on n and on the counts in the other column alone, so
    they are taken between the two tables of distinct sizes, each of which has at
    most a square root of the rows' number of rows.  Pairs without a recurring
    value give no row; rows with either value missing don't count.
    """
    which = F.inline(F.array(*[F.struct(F.lit(i).alias("pair"), as_text(df, a).alias("a"), as_text(df, b).alias("b")) for i, (a, b) in enumerate(pairs)]))
    both = df.select(which).filter("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    from ..session import materialise

    both = materialise(both, "pairs")
    marginal = both.groupBy("pair", "b").agg(F.sum("c").alias("c"))
    sizes = materialise(marginal.groupBy("pair", "c").agg(F.count(F.lit(1)).alias("k")), "sizes")
    totals = sizes.groupBy("pair").agg(F.sum(F.col("c") * F.col("k")).alias("rows"), F.sum("k").alias("others"))  # a row for each pair
    values = both.groupBy("pair", "a").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("met")).filter(F.col("n") >= min_events)
    observed = materialise(values.groupBy("pair", "n").agg(F.count(F.lit(1)).alias("values"), F.sum("met").alias("met")), "observed")
    small = F.broadcast(sizes) if sizes.count() <= BROADCAST_VALUES else sizes
    drawn = observed.select("pair", "n").join(small, "pair").join(F.broadcast(totals.drop("others")), "pair")
    expected = drawn.groupBy("pair", "n").agg(F.sum(F.col("k") * (1 - F.pow(1 - F.col("c") / F.col("rows"), F.col("n")))).alias("expected"))
    ratio = F.sum(F.col("n") * F.col("met") / F.col("expected")) / F.sum(F.col("n") * F.col("values"))
    found = observed.join(expected, ["pair", "n"]).groupBy("pair").agg(F.sum("values").alias("recurring_values"), ratio.alias("selectivity"))
    name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("pair") + 1)
    return found.select(name(0).alias("column"), name(1).alias("other"), "recurring_values", "selectivity")


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, c: counts of the non-missing values as text."""
    kv = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), as_text(df, c).alias("value")) for c in columns]))
    return df.select(kv).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))


def grammar(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and the shares of its distinct values that are structured, begin with a separator, are all digits; the mean number of separators, and the share of the most frequent length among all-digit values (null without any)."""
    from ..functions.text import is_structured

    v = F.col("value")
    separators = F.char_length(v) - F.char_length(F.translate(v, SEPARATORS, ""))
    digits = v.rlike(r"^\p{Nd}+$")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    each = _values(df, columns).groupBy("column", F.when(digits, F.char_length(v)).alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_structured(v).cast("long")).alias("structured"), F.sum(F.substring(v, 1, 1).isin(*SEPARATORS).cast("long")).alias("leading"), F.sum(separators).alias("separators")
    )
    n = F.sum("n")
    all_digits = F.sum(F.when(F.col("length").isNotNull(), F.col("n")))
    return each.groupBy("column").agg(
        (F.sum("structured") / n).alias("structured_fraction"), (F.sum("leading") / n).alias("leading_separator_fraction"), (F.sum("separators") / n).alias("mean_separator_count"),
        (F.coalesce(all_digits, F.lit(0)) / n).alias("pure_digit_fraction"), (F.max(F.when(F.col("length").isNotNull(), F.col("n"))) / all_digits).alias("dominant_digit_length_share"),
    )


def actor_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct, recurring, repeat_mass, is_vocabulary, would_qualify: the tests of an actor column on any column, its values taken as text."""
    from ..functions.text import is_structured

    big = F.col("c") >= MIN_EVENTS
    made = _values(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.count_if(big).alias("recurring"), (F.sum(F.when(big, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeat_mass"), F.avg(is_structured(F.col("value")).cast("double")).alias("structured")
    )
    vocabulary = (F.col("n_distinct") <= MAX_WORDS) & (F.col("structured") < 0.5)
    qualifies = (F.col("n_distinct") > MIN_ACTORS) & (F.col("recurring") >= MIN_BUSY) & (F.col("repeat_mass") >= MIN_REPEAT) & ~F.col("is_vocabulary")
    return made.withColumn("is_vocabulary", vocabulary).withColumn("would_qualify", qualifies).drop("structured")

"""Text measures and shape tests over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that count as missing, signs a path-like value starts with, and separators of a structured one.
MISSING = ["", "na", "n/a", "null", "none", "nan", "-"]
PATH_SIGNS = [".", ":", "_", "-", "/"]
SEPARATOR = r"[.:_\-/]"


def is_missing(col: Column) -> Column:
    return col.isNull() | F.lower(F.trim(col.cast("string"))).isin(MISSING)


def characters(v: Column) -> Column:
    """entropy (bits) and unique_ratio of a text's characters, from one pass over them in order; 0 for an empty or missing text."""
    sorted_ = F.array_sort(F.split(F.coalesce(v, F.lit("")), ""))
    n = F.char_length(F.coalesce(v, F.lit(""))).cast("double")
    start = F.struct(F.lit("").alias("ch"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("kinds"))
    ended = lambda a: a["sum"] + F.when(a["run"] > 1, a["run"] * F.log2(a["run"])).otherwise(0.0)
    same = lambda a, ch: a["ch"] == ch

    def step(a, ch):
        return F.struct(
            ch.alias("ch"),
            F.when(same(a, ch), a["run"] + 1).otherwise(1.0).alias("run"),
            F.when(same(a, ch), a["sum"]).otherwise(ended(a)).alias("sum"),
            F.when(same(a, ch), a["kinds"]).otherwise(a["kinds"] + 1).alias("kinds"),
        )

    measured = lambda a: F.struct((F.log2(n) - ended(a) / n).alias("entropy"), (a["kinds"] / n).alias("unique_ratio"))
    none = F.struct(F.lit(0.0).alias("entropy"), F.lit(0.0).alias("unique_ratio"))
    return F.when(n > 0, F.aggregate(sorted_, start, step, measured)).otherwise(none)


def text_measures(df: DataFrame, col: str) -> DataFrame:
    """One row per distinct non-null value: its character entropy (bits) and share of unique characters."""
    values = df.select(F.col(col).alias("v")).filter(F.col("v").isNotNull()).distinct().withColumn("m", characters(F.col("v")))
    return values.select(F.col("v").alias(col), "m.entropy", "m.unique_ratio")


def is_structured(v: Column) -> Column:
    """A digit together with a separator, or seven characters and more."""
    return (v.rlike(r"\d") & v.rlike(SEPARATOR)) | (F.char_length(v) >= 7)


def shape(df: DataFrame, columns: list[str], floor: int = 12) -> DataFrame:
    """One row per column: distinct values, mass in values of at least ``floor`` rows, path-shaped and structured shares."""
    kv = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = df.select(F.inline(kv)).filter("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
    out = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        (F.sum(F.when(F.col("c") >= floor, F.col("c")).otherwise(0)) / F.sum("c")).alias("repeat_mass"),
        F.avg(F.substring("v", 1, 1).isin(PATH_SIGNS).cast("double")).alias("path_share"),
        F.avg(is_structured(F.col("v")).cast("double")).alias("structured"),
        F.median("c").alias("median_count"),
        F.sum((F.col("c") >= floor).cast("long")).alias("n_repeated"),
    )
    vocabulary = (F.col("n_distinct") <= 200) & (F.col("structured") < 0.5)
    return out.withColumn("is_path", F.col("path_share") >= 0.9).withColumn("is_vocabulary", vocabulary)

"""Mixes with held-out truth, planted-truth metrics and per-rule attribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import rules


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """Exactly ``n`` rows by keyed hash, whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def sample_groups(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """All rows of whole groups, taken in hash order while they sum up to at most ``n`` rows; the first group always, null keys never.

    Groups hold a row or more, so ``n`` of them are all that the running sum can reach: one task sums up no more than these sizes.
    """
    sizes = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("group")).agg(F.count(F.lit(1)).alias("size"))
    order = [F.xxhash64("group", F.lit(seed)), F.col("group")]
    placed = Window.orderBy(*order)
    first = sizes.orderBy(*order).limit(max(n, 1)).select("group", F.sum("size").over(placed.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.row_number().over(placed).alias("place"))
    kept = first.filter((F.col("total") <= n) | (F.col("place") == 1))
    return df.join(kept, df[key] == kept["group"], "left_semi")


def labelled(df: DataFrame, column: str, positive: tuple[str, ...] = (), negative: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """Rows whose trimmed label begins with (or, if ``exact``, is) one of the given texts, with ``planted`` 1 or 0; all other rows and null labels go."""
    label = F.trim(F.col(column).cast("string"))

    def any_of(texts: tuple[str, ...]) -> Column:
        if exact:
            return label.isin(*texts) if texts else F.lit(False)
        return reduce(lambda a, b: a | b, [label.startswith(t) for t in texts], F.lit(False))

    return df.withColumn("planted", F.when(any_of(positive), 1).when(any_of(negative), 0)).filter("planted is not null")


def earliest(df: DataFrame, ts: str, n: int, key: str) -> DataFrame:
    """The first ``n`` rows by time, then by key, so that their pace stays; rows without a time come last."""
    return df.orderBy(F.asc_nulls_last(ts), key).limit(n)


def held_out(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The table without the columns that tell the truth, and all of it for the evaluation afterwards."""
    return df.drop(*columns), df


def slice_mix(df: DataFrame, label: str, ts: str, key: str, positive: tuple[str, ...], negative: tuple[str, ...], n_attack: int, n_benign: int | None = None, seed: int = 7) -> DataFrame:
    """The earliest ``n_attack`` positive rows among all negative ones, or ``n_benign`` of them by keyed hash, with ``planted`` and without the label."""
    both = labelled(df, label, positive, negative)
    benign = both.filter("planted = 0")
    benign = benign if n_benign is None else sample_exact(benign, key, n_benign, seed)
    return earliest(both.filter("planted = 1"), ts, n_attack, key).unionByName(benign).drop(label)


def mix(benign: DataFrame, attack: DataFrame, key: str, n: int, seed: int = 7, label: str = "planted") -> DataFrame:
    """All benign rows and whole attack groups of about ``n`` rows, by column name, with the truth in ``label`` (0 or 1)."""
    taken = sample_groups(attack, key, n, seed)
    return benign.withColumn(label, F.lit(0)).unionByName(taken.withColumn(label, F.lit(1)), allowMissingColumns=True)


def metrics(decided: DataFrame, planted: str = "planted", archetype: str = "archetype") -> DataFrame:
    """A row per archetype of the planted rows, and one for all (archetype null): planted, flagged, recovered, recall, precision."""
    truth, flag = F.col(planted).cast("long"), F.col("is_bot").cast("long")
    base = decided.withColumn("_t", truth).withColumn("_f", flag)
    hit = F.sum(F.col("_t") * F.col("_f"))
    all_rows = base.agg(F.lit(None).cast("string").alias("archetype"), F.sum("_t").alias("planted"), F.sum("_f").alias("flagged"), hit.alias("recovered"))
    each = base.filter("_t = 1").groupBy(F.col(archetype).alias("archetype")).agg(F.sum("_t").alias("planted"), F.sum("_f").alias("flagged"), hit.alias("recovered"))
    both = all_rows.unionByName(each)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.withColumn("recall", ratio("recovered", "planted")).withColumn("precision", ratio("recovered", "flagged"))


def attribution(decided: DataFrame, planted: str = "planted", cutoff: float = 0.70) -> DataFrame:
    """rule_id, fires, true_fires, lost (rows that are flagged only with this rule)."""
    fired = decided.select(planted, "heuristic", "ml_score", "threshold", "hits", F.explode(F.array_distinct(F.transform("hits", lambda h: h["rule_id"]))).alias("rule_id"))
    rest = rules.capped_sum(rules.without(F.col("hits"), F.col("rule_id")))
    lost = (F.col("heuristic") >= cutoff) & (rest < cutoff) & (F.col("ml_score") <= F.col("threshold"))
    return fired.groupBy("rule_id").agg(F.count(F.lit(1)).alias("fires"), F.sum(F.col(planted).cast("long")).alias("true_fires"), F.sum(lost.cast("long")).alias("lost"))

"""Training-corpus pipeline: toxicity, near copies, benchmark leaks, secrets, encoding.

Each stage gets all that its predecessor kept.  Stages are written as Parquet
into the shared folder and read again by the next one.

Every stage decides row by row, so null and repeated doc_ids are as good as any:
null texts are kept by all but the copies stage, which takes null and blank texts
as copies of each other; null ids lose against others there.  Empty tables give
empty results, further columns pass through, and no text is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm import bpe, copies, decontaminate, secrets, toxicity
from vigilog.llm.common import free_name, materialise, small_side, table
from vigilog.llm.queries import TOXIC_FROM, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below the toxic threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = free_name(docs, "_toxicity")
    return toxicity.score(docs, model, out=out).filter(F.col(out) < TOXIC_FROM).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity of 0.8 or more): that of the smallest doc_id, rows without an id last."""
    key = free_name(docs, "_row")
    numbered = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    groups = materialise(copies.near_copies(numbered, key), "groups").withColumnRenamed("_row", key)
    groups = numbered.select(key, "doc_id").join(groups, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("at")))
    kept = groups.groupBy("component").agg(first.alias("first")).select(F.col("first.at").alias(key))
    dropped = materialise(groups.select(key).join(kept, key, "left_anti"), "dropped")
    return numbered.join(small_side(dropped), key, "left_anti").select(*docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced, n_chars counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and decoded bytes."""
    ranks, pattern = tokenizer()
    return bpe.encode(docs, ranks, pattern)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", keep_one_of_each),
    ("decontamination", drop_leaked),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

#: The stages learn models and hash shingles, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

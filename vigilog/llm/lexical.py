"""Ranked lexical search over an inverted index held as a term-bucketed DataFrame.

``index`` turns documents into posting blocks: one row for each term of a batch of
documents, with the documents' places in the batch and their counts of the term in
parallel arrays, shuffled into buckets by term; the batch itself is a row with the
ids and lengths of its documents.  A frequent term has many blocks of bounded size,
which a slot number spreads over several partitions.  ``search`` joins the terms of
the items, weights them by document frequency, deals the found blocks out by batch,
scores each match in integers, sums by item and document (those of a batch are
together, so no second shuffle) and keeps each item's best by a window, which Spark
limits before it shuffles.

Defined results: null and empty texts have no terms and count as no document;
items without a term find nothing.  Each row is a document of its own, also where
a doc_id is null or repeated; equal scores go by doc_id (null last), then by row.
Each row of the items likewise has ranks of its own.  Texts of any length are
indexed whole, terms of any length are kept; other columns are ignored; an empty
table or an empty benchmark gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, small_side, texts

#: ASCII letters lower-cased and digits kept, all other ASCII to spaces; other bytes stay.
TERM_BYTES = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
#: Slots over which the blocks of one term are spread.
SPREAD = 16
#: A posting block has a term, places in its batch and counts; a batch's own row has no term but the ids and lengths of its documents.
BLOCK = "block bigint, slot int, term string, places array<smallint>, tf array<int>, docs array<bigint>, n array<bigint>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _blocks(batches):
    """Invert each batch of documents: a row for each of its terms, and one for the batch."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        known: dict[bytes, int] = {}
        ids, counts, sizes, lengths = [], [], [], []
        for text in texts(batch, "text"):
            count = Counter(terms(text))
            ids += [known.setdefault(t, len(known)) for t in count]
            counts += count.values()
            sizes.append(len(count))
            lengths.append(count.total())
        ids = np.array(ids, np.int32)
        order = np.argsort(ids, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(known)))]).astype(np.int32)
        places = np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)[order]
        # the batch's own row comes last: its lists of places and counts are empty, and so are the lists of documents of the others
        rows = len(known) + 1
        ends = pa.array(np.append(ends, ends[-1]), pa.int32())
        lists = pa.array(np.append(np.zeros(rows, np.int32), len(sizes)).astype(np.int32))
        slot = (block + (block >> 32) * 7) % SPREAD
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(rows, block)), pa.array(np.full(rows, slot, np.int32)), pa.array([*known, None], pa.binary()).cast(pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(np.array(counts, np.int32)[order])),
                pa.ListArray.from_arrays(lists, batch.column("doc_id").cast(pa.int64())), pa.ListArray.from_arrays(lists, pa.array(lengths, pa.int64())),
            ],
            names=["block", "slot", "term", "places", "tf", "docs", "n"],
        )
        block += 1


def index(docs: DataFrame) -> DataFrame:
    """The written posting blocks of ``docs`` (doc_id, text), in buckets by term."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = rows.mapInArrow(_blocks, BLOCK)
    return materialise(blocks.repartition("term", "slot").sortWithinPartitions("term"), "postings")


def _item_terms(items: DataFrame) -> DataFrame:
    """item, item_id, term, times: the distinct terms of each item."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", found.alias("terms"))
    rows = rows.select("item", "item_id", F.explode("terms").alias("term"))
    return rows.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def search(blocks: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item (item_id, text) above a score of 0."""
    zero = F.lit(0).cast("long")
    batches, postings = blocks.filter("term is null").select("block", "docs", "n"), blocks.filter("term is not null")
    total = batches.agg(F.coalesce(F.sum(F.size(F.filter("n", lambda x: x > 0)).cast("long")), zero).alias("documents"), F.coalesce(F.sum(F.aggregate("n", zero, lambda a, x: a + x)), zero).alias("terms")).first()
    asked = materialise(_item_terms(items), "item-terms")
    named = small_side(materialise(asked.select("term").distinct(), "asked"))
    found = postings.join(named, "term")
    weight = F.floor(1000 * F.log((2 * F.lit(total.documents) + 2).cast("double") / (2 * F.sum(F.size("places").cast("long")) + 1).cast("double")))
    weights = found.groupBy("term").agg(weight.alias("w")).filter("w > 0").withColumn("t", F.monotonically_increasing_id())
    weights = small_side(materialise(weights, "weights"))
    asked = small_side(materialise(asked.join(weights, "term").select("item", "item_id", "t", (F.col("w") * F.col("times")).alias("w")), "asked-weights"))
    # blocks travel to their documents whole, and once, however many items ask for their term
    dealt = found.join(weights.select("term", "t"), "term").select("t", "block", "places", "tf").repartition("block").join(batches, "block")
    named_postings = F.transform(F.arrays_zip("places", "tf"), lambda p: F.struct(p["places"].alias("place"), F.get("docs", p["places"]).alias("doc_id"), p["tf"].cast("long").alias("tf"), F.get("n", p["places"]).alias("n")))
    each = dealt.select("t", "block", F.explode(named_postings).alias("p")).select("t", "block", "p.*")
    each = each.withColumn("m", F.expr(f"25L + (75L * n * {total.documents}L) div {max(1, total.terms)}L"))
    gains = each.select("t", "block", "place", "doc_id", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)").alias("gain"))
    scored = gains.join(asked, "t").groupBy("block", "place", "doc_id", "item", "item_id").agg(F.sum(F.col("w") * F.col("gain")).alias("score")).filter("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")

"""Audit of how corpus filters interact, over all orders in which they can be applied.

Each document gets a mask of the filters it fails.  Copies are found by sorting:
rows are range-partitioned by text fingerprint and doc_id (the texts themselves
stay out of the partitioner's sample, and a text of many copies is spread over
several partitions), sorted within them by fingerprint, full text and doc_id, and
compared with their predecessors.  Only a partition's first fingerprint can have
rows in an earlier one; its texts meet the texts that end earlier partitions in a
small join.  The masks then become additive counters: for each part and each set
of filters the number of documents that pass all of the set, from which every
order, step and Shapley sum is a difference.

Defined results: null texts are empty texts, null sources the part ``''``.  A
document is a copy if a smaller doc_id has the same text, so of rows of equal id
and text none is a copy of the other, and rows without an id neither are copies
nor make any.  Repeated rows count once each.  Labels count if any label row of
the doc_id has them; null labels don't.  Texts of any length are taken whole.
Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, small_side, texts

#: The filters; the place of a letter is its bit in a mask.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
# Limits of the filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
INNER_BYTES = bytes(range(0x80, 0xC0))


def failed(text: bytes) -> int:
    """Mask of the filters A to D that a text fails: few words, repeated words, capitals, symbols."""
    words = text.split()  # at the ASCII white space, as bytes split
    points = len(text.translate(None, INNER_BYTES))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    tests = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * capitals > MAX_CAPITAL_PERCENT * points,
        len(text) > len(text.translate(None, SYMBOLS)),
    )
    return sum(1 << k for k, fails in enumerate(tests) if fails)


def _compare(kind):
    """Over a partition's sorted rows: a row for each document, and one for each text of its first and its last fingerprint."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        fp = text = smallest = None
        mask = number = 0
        first_group, group = True, {}

        def rows(part, doc, mask, smallest, run, edge, fp, text):
            n = len(part)
            return pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array(doc, kind), pa.array(mask, pa.int32()), pa.array(smallest, kind), pa.array([block] * n, pa.int32()), pa.array(run, pa.int32()), pa.array(edge, pa.string()), pa.array(fp, pa.int64()), pa.array(text, pa.binary())],
                names=["part", "doc_id", "mask", "smallest", "block", "run", "edge", "fp", "text"],
            )

        def edges(name):
            none = [None] * len(group)
            return rows(none, none, none, [s for _, s in group.values()], [r for r, _ in group.values()], [name] * len(group), [fp] * len(group), list(group))

        for batch in batches:
            docs, lows, masks, runs = batch.column("doc_id").to_pylist(), [], [], []
            for f, t, i in zip(batch.column("fp").to_pylist(), texts(batch, "text"), docs, strict=True):
                if f != fp:
                    if fp is not None and first_group:
                        yield edges("first")
                        first_group = False
                    fp, text, group = f, None, {}
                if t != text:
                    text, smallest, mask = t, None, failed(t)
                    number += 1
                if smallest is None and i is not None:
                    smallest = i  # ids are sorted, nulls first
                group[text] = (number, smallest)
                lows.append(smallest)
                masks.append(mask)
                runs.append(number if first_group else None)
            n = len(docs)
            yield rows(batch.column("part").to_pylist(), docs, masks, lows, runs, [None] * n, [None] * n, [None] * n)
        if fp is not None:
            if first_group:
                yield edges("first")
            yield edges("last")

    return run


def failure_masks(docs: DataFrame) -> DataFrame:
    """part, doc_id, mask: for each row of ``docs`` (doc_id, text, source) the filters it fails."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("source"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"), F.monotonically_increasing_id().alias("at"))
    placed = rows.repartitionByRange("fp", "doc_id", "at").sortWithinPartitions("fp", "text", "doc_id").select("fp", "text", "doc_id", "part")
    kind = "part string, doc_id long, mask int, smallest long, block int, run int, edge string, fp long, text binary"
    seen = materialise(placed.mapInArrow(_compare(pa.int64()), kind), "copies")
    # one text for each partition, but for texts of equal fingerprints
    ends = seen.filter("edge = 'last'").groupBy("fp", "text").agg(F.min("smallest").alias("before"))
    opens = seen.filter("edge = 'first'").join(ends, ["fp", "text"]).filter("before < smallest").select("block", "run", "before")
    rows = seen.filter("edge is null").join(small_side(opens), ["block", "run"], "left")
    copy = F.coalesce(F.col("doc_id") > F.least("smallest", "before"), F.lit(False))
    return rows.select("part", "doc_id", (F.col("mask") + F.when(copy, COPY).otherwise(0)).alias("mask"))


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, sets: for each set of filters (by its mask) the documents passing all of it: their number n, of them good, of them toxic."""
    said = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0))
    known = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    known = small_side(materialise(known, "labels"))
    # counted before the join, so that an id of many rows is few rows there
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(known, "doc_id", "left")
    times = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), times("good"), times("toxic"))
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most

    def total(which: Column, name: str) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(which) == 0, x[name]).otherwise(F.lit(0).cast("long")))

    every = F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))
    return held.select("part", F.transform(every, lambda s: F.struct(*[total(s, c).alias(c) for c in ("n", "good", "toxic")])).alias("sets"))


def _steps() -> Column:
    """All orders and their steps as one constant array."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            out.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {k + 1}, 'bit', {bit}, 'before', {before})")
            before |= bit
    return F.expr(f"array({', '.join(out)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the step's counts: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sets = part_counters(failure_masks(docs), labels)
    steps = sets.select("part", "sets", F.explode(_steps()).alias("s")).select("part", "sets", "s.*")
    whole = 2 ** len(FILTERS) - 1
    at = lambda mask, c="n": F.get("sets", mask)[c]
    bit, before = F.col("bit"), F.col("before")
    after = before.bitwiseOR(bit)
    removed = at(before) - at(after)
    fails = at(F.lit(0)) - at(bit)

    def weighted(s: int) -> Column:
        # orders that put exactly the set s before the filter
        first = bin(s).count("1")
        orders = [1, 1, 2, 6, 24][first] * [1, 1, 2, 6, 24][len(FILTERS) - 1 - first]
        return F.when(bit.bitwiseAND(F.lit(s)) == 0, F.lit(orders) * (at(F.lit(s)) - at(F.lit(s).bitwiseOR(bit)))).otherwise(F.lit(0).cast("long"))

    shapley = sum((weighted(s) for s in range(whole)), F.lit(0).cast("long"))
    return steps.select(
        "part", "filter_order", "step", at(after).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"), (at(F.lit(whole).bitwiseXOR(bit)) - at(F.lit(whole))).alias("unique_fails"),
        (at(before, "good") - at(after, "good")).alias("good_lost"), (at(before, "toxic") - at(after, "toxic")).alias("toxic_lost"), shapley.alias("shapley"),
    )

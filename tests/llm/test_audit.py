"""The filter audit against a plain count over all orders."""

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from vigilog.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """The rows of audit() by applying each order to each document."""
    texts = [(i, t or "", s or "") for i, t, s in rows]
    fails = []
    for i, t, _ in texts:
        words = WORD.findall(t)
        tests = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t))]
        tests.append(i is not None and any(j is not None and j < i and u == t for j, u, _ in texts))
        fails.append({f for f, x in zip("ABCDE", tests, strict=True) if x})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {s for _, _, s in texts}:
        own = [(i, f) for (i, _, s), f in zip(texts, fails, strict=True) if s == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                redundant = sum(letter in f for _, f in own) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def check(spark, rows, labels, slices=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(slices)
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("part", "fp", "mask", "n", "sets", "step")])
    made = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in made.collect()}
    assert made.columns[3:] == ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(found) == 600 * len({s or "" for _, _, s in rows}) and found == plain(rows, labels)


def test_filters_in_all_orders(spark):
    long = " ".join(f"w{k}" for k in range(60))
    same = "the same words " * 20
    rows = [(k, t, s) for k, (t, s) in enumerate([(long, "a"), (long, "b"), (same, "a"), (same + "#", "a"), (long.upper(), "b"), ("$ SHORT", None), (None, ""), ("", "a"), (long + " é" * 9 + " €|", "b"), ("x y z " * 30, "a"), (long, "a")])]
    rows += [(3, same + "#", "a"), (None, long, "a"), (None, "only here", "b"), (20, "only here", "b"), (30, "A\x00B " * 70, "c"), (31, "word " * 50_000, "c"), (32, "word " * 50_000, "a")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, None, 1), (None, 1, 1), (31, 1, 1), (99, 1, 1)]
    check(spark, rows, labels)


def test_one_text_over_many_partitions(spark):
    # a third of all rows share a text, also under one id, and are spread over partitions
    rows = [(k % 300, "copy", f"s{k % 2}") for k in range(900)] + [(7, "copy", "s0")] * 300 + [(k, f"text {k % 700}", "s1") for k in range(1500)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        masks = audit.failure_masks(docs)
        found = Counter((r.doc_id, r["mask"] >= audit.COPY, r.part) for r in masks.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = {}
    for i, t, _ in rows:
        least[t] = min(i, least.get(t, i))
    assert found == Counter((i, i > least[t], s) for i, t, s in rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    check(spark, [(1, "x", "a")], [])

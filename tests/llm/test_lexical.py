"""Ranked search against scoring every document for every item."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from vigilog.llm import common, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, _), c in zip(docs, counts, strict=True):
            m = 25 + (75 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


DOCS = [(1, "The quick brown fox. The fox!"), (2, "quick quick QUICK"), (3, None), (4, ""), (5, "ÄÖ äö straße №5 日本語 x y"), (6, "The quick brown fox. The fox!"), (6, "The quick brown fox. The fox!"), (None, "brown fox"), (7, "filler " * 60_000 + "fox"), (8, "z" * 100_000), (9, "a-b_c\x00d\x7fe {f}~g")]
DOCS += [(100 + k, f"common word{k % 5} fox{k % 11}") for k in range(60)]
ITEMS = [(1, "Quick fox quick"), (2, None), (3, "absent"), (4, "ÄÖ straße 5 x y"), (5, "common"), (1, "d e f g"), (None, "z" * 100_000), (6, "filler the word1 word2 fox3")]


def frames(spark, docs, items):
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select("*", *[F.lit(1).alias(c) for c in ("row", "term", "rows", "n", "tf")])
    return made, spark.createDataFrame(items, "item_id long, text string").select("*", *[F.lit(1).alias(c) for c in ("item", "term", "w", "doc_id")])


def run(spark, docs, items, k=10):
    docs, items = frames(spark, docs, items)
    return sorted((tuple(r) for r in lexical.search(lexical.index(docs), items, k).collect()), key=str)


def test_ranks_and_scores(spark):
    assert run(spark, DOCS, ITEMS) == plain(DOCS, ITEMS)
    assert run(spark, DOCS, ITEMS, 3) == plain(DOCS, ITEMS, 3)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert run(spark, DOCS, ITEMS) == plain(DOCS, ITEMS)


def test_blocks_hold_every_posting(spark):
    docs, _ = frames(spark, DOCS, ITEMS)
    rows = lexical.index(docs).collect()
    batches = {r.block: r for r in rows if r.term is None}
    held = [(r.term, batches[r.block].docs[k], n, batches[r.block].n[k]) for r in rows if r.term is not None for k, n in zip(r.places, r.tf, strict=True)]
    expected = [(t, i, n, sum(c.values())) for i, c in ((i, Counter(terms(t))) for i, t in DOCS) for t, n in c.items()]
    assert sorted(held, key=str) == sorted(expected, key=str)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, DOCS, []) == [] and run(spark, [(1, "!"), (2, None)], ITEMS) == []

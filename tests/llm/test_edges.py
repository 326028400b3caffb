"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator."""

import pytest
from pyspark.sql import functions as F

from vigilog.llm import ann, bpe, chat, decontaminate, html, lm, pii, secrets, simhash, toxicity
from vigilog.llm.queries import tokenizer

ROWS = [(1, None), (None, "a text without an id"), (2, ""), (2, ""), (3, "word " * 20_000), (4, "Mail a.b@host.org, password = hunter2hunter2"), (4, "Mail a.b@host.org, password = hunter2hunter2"), (5, " \t\n")]
CLASHING = ["score", "held_out", "id", "kind", "spans", "fp", "n", "h", "row", "n_entities", "_ents", "_row", "item_id", "page_id", "url", "lang"]


def documents(spark, rows=ROWS):
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def items(spark):
    return spark.createDataFrame([(1, "What is the answer to it all? The answer is forty two."), (2, None), (3, "")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 0), (3, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")


OPERATORS = {
    "lm": lambda s, d: lm.score(d, F.col("doc_id") == 2),
    "bpe": lambda s, d: bpe.encode(d, *tokenizer()),
    "pii": lambda s, d: pii.replace_entities(d, "key"),
    "secrets": lambda s, d: secrets.scan(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    made = OPERATORS[name](spark, documents(spark))
    assert sorted(str(r.doc_id) for r in made.collect()) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


def test_decontamination_edges(spark):
    leaked = [(7, "Before. What is the answer to it all? The answer is forty two. After."), *ROWS]
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(documents(spark, leaked), items(spark)).collect()} == {(7, 1)}
    assert decontaminate.find(documents(spark, []), items(spark)).collect() == []
    assert decontaminate.find(documents(spark), items(spark).limit(0)).collect() == []


def test_chat_edges(spark):
    kind = "conv_id long, turn long, role string, text string, size string"
    rows = [(1, 0, "user", "<|im_end|>\\"), (1, 1, None, None), (None, None, "assistant", "yes"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    made = chat.windows(spark.createDataFrame([(*r, "x") for r in rows], kind)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert sum(r.n_turns for r in made) == len(rows)
    assert [t.text for r in made if r.conv_id == 1 for t in r.turns] == ["<|im_end|>\\", ""]
    assert chat.windows(spark.createDataFrame([], kind)).collect() == []


def test_page_edges(spark):
    body = "<nav>Menu</nav><article><p>One &amp; two.</p><p>Three</p></article><footer>End</footer><script>x</script>"
    rows = [(1, "https://h/a", body), (1, "https://h/a", body), (2, None, None), (None, "https://h/b", ""), (3, "x", "<p>open")]
    made = html.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")).collect()
    assert sorted(r.text for r in made) == sorted(["One & two. Three"] * 2 + ["", "", "open"])
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (3, [None, 1.0])]
    kind = "vec_id long, embedding array<double>, cls string, id string"
    found = ann.search(spark.createDataFrame([(*r, "x", "x") for r in rows], kind), F.col("id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert ann.search(spark.createDataFrame([], kind), F.col("id") % 20 == 0).collect() == []


def test_filter_counts_are_never_below_their_level():
    import numpy as np

    keys = np.arange(1, 5000, dtype=np.uint64)
    counts = (keys.astype(np.int64) % 50) + 1
    f = lm.LogFrequencyFilter.of([lm.LogFrequencyFilter.build(keys, counts)])
    levels = np.array(lm.LEVELS)
    assert (f.value(f.levels(keys)) >= levels[np.searchsorted(levels, counts, "right") - 1]).all()
    assert (f.levels(keys + np.uint64(1 << 40)) > 0).mean() < 0.02


def test_prefix_tables_append_and_edit():
    ranks, _ = tokenizer()
    b = bpe.PrefixBpe(ranks)
    data = b" the quick brown fox" * 30
    last = b.table(data)
    for start, end, new in [(len(data), len(data), b"es"), (5, 9, b"slow"), (0, 0, b"x"), (100, 160, b"")]:
        whole, table = b.edit(data, last, start, end, new)
        assert whole == data[:start] + new + data[end:] and table == b.table(whole)


def test_frequent_pieces_are_encoded_once():
    ranks, _ = tokenizer()
    b = bpe.PrefixBpe(ranks)
    encoded, plain = [], b.encode_sorted
    b.encode_sorted = lambda pieces: encoded.extend(pieces) or plain(pieces)
    cache = bpe.Remembered(b, 20)
    for k in range(12):
        own = {f" rare{k}word{i}" for i in range(6)}
        cache.learn({" oftenmet"} | own)
        assert all(cache.young[p] == " ".join(map(str, b.encode_piece(p.encode()))) for p in {" oftenmet"} | own)
        assert len(cache.young) <= 20 and len(cache.old) <= 20
    assert encoded.count(b" oftenmet") == 1 and len(encoded) == 73

"""Former limits: both sides of each give the same rows; and the methods' own effects."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.llm import ann, decontaminate, html, secrets, simhash, toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_items_in_blocks_score_alike(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, f"{text(20)}. {text(8)}.") for i in range(40)] + [(40, text(700) + ". end here."), (0, "w1")]
    docs = [(i, f"{text(100)} {items[i][1]} {text(100)}" if i < 20 else text(300)) for i in range(40)] + [(7, None), (None, items[40][1])]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, decontaminate.find(d, b).collect()), key=str)
    assert sorted(map(tuple, decontaminate.find(d, b, items_per_block=11).collect()), key=str) == whole
    assert {(i, i) for i in range(20)} | {(None, 40)} <= {r[:2] for r in whole}
    kept = decontaminate.drop_leaked(d, b).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None and r.doc_id < 7) == []
    assert sorted(r.doc_id for r in kept if r.doc_id is not None and r.doc_id >= 20) == sorted(set(range(20, 40)) - {r[0] for r in whole})
    assert [r.doc_id for r in kept if r.text is None] == [7] and all(r.doc_id is not None for r in kept)


def test_grammar_finds_unseen_formats_and_leaves_others(spark):
    draw = random.Random(3)
    some = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    live = lambda: "sk_live_" + some(letters, 24)
    word = lambda: "".join(draw.choice(["tion", "the", "er", "ing", "ou", "ver", "heit"]) for _ in range(draw.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    uuid = lambda: "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
    rows = [(i, f"{prose(60)} token = {live()} {some('0123456789', 9)} {prose(60)}") for i in range(80)]
    planted = [(1000 + i, f"{prose(30)} {live()} {prose(30)}") for i in range(50)]
    others = [(2000 + i, f"{prose(30)} {x} {prose(30)}") for i, x in enumerate([uuid() for _ in range(20)] + [some("0123456789", 21) for _ in range(20)] + ["".join(word() for _ in range(9)) for _ in range(20)] + ["/usr/local/lib/python3/site-packages"])]
    df = spark.createDataFrame(rows + planted + others, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    hit = {i for i, spans in found.items() if any(s.kind == "grammar" for s in spans)}
    assert len(hit & {i for i, _ in planted}) >= 38 and not hit - {i for i, _ in planted}
    model = secrets.learn(secrets.extract(df))
    assert len(model.automata["assign"].states) > 10
    brute = {i: model.spans(t) for i, t in planted}
    assert all([(s.start, s.end, s.kind) for s in found[i]] == [x[:3] for x in spans] for i, spans in brute.items())
    clean = {r.doc_id: r.text for r in secrets.redact(df.withColumn("_row", F.lit(5)).withColumn("spans", F.lit("x"))).collect()}
    assert all("sk_live" not in clean[i] for i in hit) and all(clean[i] == t for i, t in others)


def test_differencing_decides_where_markup_does_not(spark):
    draw = random.Random(4)
    line = lambda n: " ".join(f"v{draw.randrange(900)}" for _ in range(n))
    shared = [line(6) for _ in range(7)]
    rows, expected = [], {}
    for host in ("a.example", "b.example"):
        for k in range(12):
            own = [line(30) for _ in range(3)]
            blocks = [*shared[:4], *own, *shared[4:]]
            rows.append((len(rows), f"https://{host}/n/{k:02}", "".join(f"<div>{x}</div>" for x in blocks)))
            expected[len(rows) - 1] = " ".join(own)
    rows += [(100, None, None), (101, "https://c.example/x", "<a \"" * 20000), (102, "https://c.example/y", "<p title=it's>text &amp; more</p>")]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert {k: v for k, v in found.items() if k < 100} == expected
    assert found[100] == "" and found[102] == "text & more"


def test_markup_traps():
    read = lambda x: [t for t, mark in html.lines_of(x) if mark != html.DROP]
    assert read('<div class="layout has-sidebar"><article><p>Hi there</p></article></div>') == ["Hi there"]
    assert read('<article><h2 id="related-work">Rel</h2><section id="search-trees"><p>t</p></section></article>') == ["Rel", "t"]
    assert read('<div class="cookie-notice">c</div><div id="comments">x</div><p>ok') == ["ok"]
    assert read("<article><p>teaser</p></article><div><p>" + "long " * 20 + "</p></div>") == ["teaser", ("long " * 20).strip()]


def neighbours(vectors, queries, k):
    out = {}
    for i in queries:
        s = vectors @ vectors[i]
        s[i] = -np.inf
        out[i] = set(np.argsort(-s, kind="stable")[:k].tolist())
    return out


@pytest.mark.parametrize("kind", ["clustered", "long"])
def test_recall_on_many_lists(spark, kind):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 16))
    v = centres[rng.integers(0, 200, 12_000)] + 0.3 * rng.normal(size=(12_000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if kind == "long":
        v[77] *= 1000
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(3, [9.0] * 16)], "vec_id long, embedding array<double>")
    v[3] = min(v[3].tolist(), [9.0] * 16)
    asked = [i for i in range(12_000) if i % 100 == 0]
    found = {}
    for r in ann.search(df, F.col("id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(found) == asked and all([n for n, _ in sorted(x)] == list(range(1, 21)) for x in found.values())
    wanted = neighbours(v, asked, 20)
    assert np.mean([len({i for _, i in found[q]} & wanted[q]) / 20 for q in asked]) >= 0.9


def test_ties_go_to_smaller_ids(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, float(i)]) for i in range(1, 300)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 21))


def test_components_say_when_they_have_not_settled(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(chain, max_rounds=1)


def test_repeated_ids_do_not_widen_the_sample(spark, monkeypatch):
    seen = {}
    fit = toxicity.fit_nnpu
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda p, u, *a, **k: seen.update(p=len(p), u=len(u)) or fit(p, u, *a, **k))
    rows = [(i, f"bad{i % 3} word{k}") for i in range(20) for k in range(100)]
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, toxic int")
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_positive=2, max_unlabelled=4, min_df=1, min_z=0.0)
    assert seen == {"p": 2, "u": 4}


def test_stages_take_nulls_empty_tables_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "what is the colour of the sky over the sea at noon. it is blue as ever.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "what is the colour of the sky over the sea at noon. it is blue as ever.", "en", "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0), (5, "plain text of its own", "en", "s", 0), (5, "x" * 200_000, "en", "s", 0), (5, "plain text of its own", "en", "s", 0)]
    for extra in ({}, {"_row": 1, "spans": "s", "_toxicity": 2.0, "component": 3, "digest": 4}):
        docs = spark.createDataFrame(rows, KIND).withColumns({k: F.lit(v) for k, v in extra.items()})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, str(tmp_path))
            assert made.columns == docs.columns
            docs = spark.createDataFrame(made.collect(), made.schema)
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert sorted((r.doc_id, len(r.text or "")) for r in docs.collect()) == [(5, 0), (5, 21), (5, 200_000)]
        assert corpus_pipeline.encode(spark, docs, "").count() == 3

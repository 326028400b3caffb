"""The registered queries of the training-data operators against plain brute force on the given tables."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from vigilog.llm import decontaminate

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(x, mod):
    return zlib.crc32(str(x).encode()) % mod


def words(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def run(spark):
    done = {}

    def of(name):
        if name not in done:
            done[name] = entry.queries()[name](spark, DATA).collect()
        return done[name]

    return of


def test_op1_counts_and_base(docs, run):
    tokens = {i: [*words(t), b"\n"] for i, t in docs}
    count = Counter(w for i, ws in tokens.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    rows = run("op1_lm_filter")
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc(r.doc_id, 7) == 2, len(ws), n)
        assert r.n_known == sum(count[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score <= 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op2_turns_come_back(spark, run):
    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", said), (1, "assistant", said)]
    rows = {r.conv_id: r for r in run("op2_chat_windows")}
    assert rows.keys() == turns.keys()
    for c, ts in turns.items():
        ts.sort()
        loss = "".join(t for _, role, t in ts if role == "assistant")
        r = rows[c]
        assert (r.n_turns, r.turns_sha256) == (len(ts), sha("".join(f"{role}\n{t}\n" for _, role, t in ts)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars >= sum(len(t) for *_, t in ts)


def test_op3_lengths(spark, run):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = run("op3_page_text")
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        assert r.text == " ".join(r.text.split()) and not re.search(r"</?(p|div|script|nav)\b", r.text)
    assert sum(r.n_chars > 0 for r in rows) > 0.8 * len(rows)


def test_op4_equals_tiktoken(docs, run):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in run("op4_byte_bpe")}
    for i, t in docs:
        ids = plain.encode_ordinary(t or "")
        r = rows[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))


def test_op5_entities_go_and_stay_distinct(spark, docs, run):
    from vigilog.llm import pii

    rows = {r.doc_id: r for r in run("op5_pii_surrogates")}
    assert rows.keys() == {i for i, _ in docs}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    new_of = {}
    for i, t in docs:
        old, new = mail.findall(t or ""), mail.findall(rows[i].text or "")
        assert len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            assert a.lower() != b.lower()
            assert new_of.setdefault(a.lower(), b) == b
    assert len(set(new_of.values())) == len(new_of)
    assert {r.n_entities > 0 for r in rows.values()} == {True, False}
    assert set(pii.PATTERNS) == {"email", "iban", "card", "phone", "ssn", "ip", "ipv6", "name"}


def test_op6_base_spans(docs, run):
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rows = {r.doc_id: r for r in run("op6_secret_grammar")}
    for i, t in docs:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = ("assign", "access", "hex")
        base = [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found)]
        r = rows[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[1] == k for f in found) for k in range(3))
        assert r.base_sha256 == sha(",".join(base))
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("grammar")] == base


def test_op7_recall_and_scores(spark, run):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r.embedding}
    vectors = {i: v for i, v in vectors.items() if np.isfinite(v).all() and v.any()}
    found = defaultdict(list)
    for r in run("op7_posting_lists"):
        found[r.query_id].append(r)
    queries = [i for i in vectors if i % 20 == 0]
    assert sorted(found) == sorted(queries)
    hits = 0
    for q in queries:
        rows = sorted(found[q], key=lambda r: r["rank"])
        best = sorted((-float((v * vectors[q]).sum()), i) for i, v in vectors.items() if i != q)[:20]
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1))
        assert all(r.score == pytest.approx(float((vectors[r.vec_id] * vectors[q]).sum()), abs=1e-12) for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r.score, r.vec_id))
        hits += len({r.vec_id for r in rows} & {i for _, i in best})
    assert hits >= 0.9 * sum(len(found[q]) for q in queries)


def test_op8_fingerprints_and_components(docs, run):
    from xxhash import xxh64_intdigest

    def print_of(text):
        ws = words(text)
        grams = [b" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [b" ".join(ws)] if ws else []
        ones = [0] * 64
        for g in grams:
            h = xxh64_intdigest(g, 42)
            for b in range(64):
                ones[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))

    prints = {i: print_of(t) for i, t in docs}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    rows = {r.doc_id: r for r in run("op8_simhash")}
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{p:016x}", top(i)) for i, p in prints.items()}


def test_op9_equals_scoring_every_pair(spark, docs, run):
    items = sorted(((r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()), key=str)
    split = [(i, *decontaminate.Index.split(t)) for i, t in items]
    bags = [Counter(q + a) for _, q, a in split]
    df = Counter(w for bag in bags for w in bag)
    mean = sum(sum(bag.values()) for bag in bags) / len(bags)
    idf = {w: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    weigh = lambda bag: {w: idf[w] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean)) for w, c in bag.items()}
    weights = [weigh(bag) for bag in bags]
    expected = set()
    for i, t in docs:
        ws = decontaminate.tokens((t or "").encode())
        for item, bag, weight in zip(split, bags, weights, strict=True):
            stride = max(32, 1 << (sum(bag.values()) - 1).bit_length())
            for s in range(0, max(1, len(ws) - stride), stride) if ws else ():
                held = set(ws[s : s + 2 * stride])
                if sum(x for w, x in weight.items() if w in held) >= (0.5 - 1e-9) * sum(weight.values()):
                    q, a = decontaminate.overlaps(item, ws[max(0, s - stride) : s + 3 * stride])
                    if q >= 0.6 and a >= 0.6:
                        expected.add((i, item[0]))
    assert {(r.doc_id, r.item_id) for r in run("op9_decontaminate")} == expected


def test_op10_held_out_and_quality(spark, run):
    rows = {r.doc_id: r for r in run("op10_toxicity")}
    assert all(r.held_out == (crc(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    where = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    scored = [(r.score, labels[r.doc_id]) for r in entry.queries()["op10_toxicity"](spark, where).filter("held_out").collect() if labels.get(r.doc_id) is not None]
    good, bad = [s for s, y in scored if y], [s for s, y in scored if not y]
    assert np.mean([s >= 0.3 for s in good]) >= 0.9
    assert np.mean([s >= 0.3 for s in bad]) <= 0.02


def test_pipeline_equals_its_stages_by_brute_force(spark, docs):
    """Who stays is rebuilt from the operators' own rows; the encoding is checked against the redacted texts."""
    import corpus_pipeline
    from vigilog.llm import secrets

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, table, DATA)
    scored = {r.doc_id: r.score for r in entry.queries()["op10_toxicity"](spark, DATA).collect()}
    left = {r.doc_id: r.text for r in clean.collect()}
    assert left.keys() == {i for i, s in scored.items() if s < 0.3}
    assert clean.columns == table.columns
    one = corpus_pipeline.keep_one_of_each(spark, clean, DATA)
    from test_copies import kept_by_brute_force

    stay = set(kept_by_brute_force(list(left.items())))
    assert sorted(r.doc_id for r in one.collect()) == sorted(stay)
    unleaked = corpus_pipeline.drop_leaked(spark, one, DATA)
    leaked = {r.doc_id for r in decontaminate.find(one, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    kept = {r.doc_id: r.text for r in unleaked.collect()}
    assert kept.keys() == stay - leaked
    redacted = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, unleaked, DATA).collect()}
    assert redacted.keys() == kept.keys()
    for r in redacted.values():
        assert not secrets.base_spans(r.text or "") and r.n_chars == len(r.text or "")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert {i: r.decoded_sha256 for i, r in out.items()} == {i: sha(r.text or "") for i, r in redacted.items()}

"""The pipeline's near copies: planted edited copies go, and the groups equal brute force over exact similarities."""

import random

import corpus_pipeline
import pytest
from vigilog.llm import copies

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) > 5 else {" ".join(ws)} - {""}


def kept_by_brute_force(rows):
    sets, left = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= 0.8 * either - 1e-9:
                left = [left[j] if k == left[i] else k for k in left]
    groups = {}
    for (doc, _), k in zip(rows, left, strict=True):
        groups.setdefault(k, []).append(doc)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)


def test_edited_copies_go(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    line = text(12)
    rows = [(1000 + i, " ".join(text(60) + line)) for i in range(30)]
    for base in range(8):  # each copy of some hundred words has a few words changed
        words = text(200)
        rows.append((base, " ".join(words)))
        for k in range(6):
            edited = list(words)
            for _ in range(1 + k):
                edited[draw.randrange(len(edited))] = "edited"
            rows.append((100 + 10 * base + k, " ".join(edited)))
    hot = text(150)
    for k in range(60):  # one group larger than SMALL, its members up to four words apart
        edited = list(hot)
        for _ in range(k % 5):
            edited[draw.randrange(len(edited))] = f"x{k}"
        rows.append((2000 + k, " ".join(edited)))
    rows += [(3000, None), (3001, " "), (None, "short text"), (None, "short text"), (None, rows[0][1]), (4000, "short text")]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KIND)
    made = corpus_pipeline.keep_one_of_each(spark, docs, "")
    kept = sorted((r.doc_id for r in made.collect()), key=str)
    assert kept == kept_by_brute_force(rows)
    assert not {100 + 10 * base + k for base in range(8) for k in range(4)} & set(kept)


def test_no_documents(spark):
    assert corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame([], KIND), "").collect() == []


@pytest.mark.parametrize("tile", [copies.TILE, 4])
def test_chains_in_large_buckets(spark, monkeypatch, tile):
    """Texts linked to their neighbours only, in buckets of more than SMALL classes, with bounds for connected buckets that hold and don't."""
    monkeypatch.setattr(copies, "TILE", tile)
    draw = random.Random(9)
    rows = []
    for chain, step in ((0, 5), (1, 6), (2, 30)):  # the last one's neighbours share too little
        words = [f"c{chain}w{draw.randrange(10**6)}" for _ in range(1700)]
        rows += [(100 * chain + k, " ".join(words[k * step : k * step + 200])) for k in range(45)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], KIND)
    kept = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect())
    assert sorted(kept, key=str) == kept_by_brute_force(rows)
    assert len(kept) == 2 + 45

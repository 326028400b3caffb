"""Selectivity, grammar and audit of columns against plain counts, and on pools with a known answer."""

import random
from collections import Counter, defaultdict

import pytest

from vigilog.operators import diagnose


def pools(seed=11):
    """Sixty users of twelve rows that keep to three of twelve servers, and sixty words of as many rows dealt out freely."""
    draw = random.Random(seed)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60) for _ in range(12)]
    draw.shuffle(words)
    own = {u: draw.sample(range(12), 3) for u in range(60)}
    return [(f"u{u}", f"10.2.0.{draw.choice(own[u])}", words[u * 12 + k], float(draw.randint(40, 4000))) for u in range(60) for k in range(12)]


def plain(rows, a, b):
    rows = [r for r in rows if r[a] is not None and r[b] is not None]
    marginal, seen, n = Counter(r[b] for r in rows), defaultdict(set), Counter(r[a] for r in rows)
    for r in rows:
        seen[r[a]].add(r[b])
    some = {v: k for v, k in n.items() if k >= 12}
    expected = {v: sum(1 - (1 - c / len(rows)) ** k for c in marginal.values()) for v, k in some.items()}
    return (len(some), sum(k * len(seen[v]) / expected[v] for v, k in some.items()) / sum(some.values())) if some else None


@pytest.mark.parametrize("limit", [10**6, 0])
def test_actors_are_selective_and_words_are_not(spark, monkeypatch, limit):
    monkeypatch.setattr(diagnose, "BROADCAST_VALUES", limit)
    rows = pools() + [(None, "10.2.0.1", "wzz", 1.0), ("u1", None, None, None)] * 15
    df = spark.createDataFrame(rows, "user string, server string, cmd string, bytes double")
    pairs = [("user", "server"), ("cmd", "server"), ("bytes", "server"), ("server", "cmd")]
    found = {(r["column"], r.other): (r.recurring_values, r.selectivity) for r in diagnose.selectivity(df, pairs).collect()}
    names = df.columns
    for a, b in pairs:
        want = plain(rows, names.index(a), names.index(b))
        assert found.get((a, b)) == (None if want is None else (want[0], pytest.approx(want[1], rel=1e-9)))
    assert 0.33 < found["user", "server"][1] < 0.45 and 0.95 < found["cmd", "server"][1] < 1.08
    assert diagnose.selectivity(df.limit(0), pairs).collect() == []


def test_grammar_of_values(spark):
    rows = [("10.0.0.1", 1001.0, "/a/b"), ("host", 1002.0, "-x"), ("x-1", 7.0, "plain text"), (None, None, "/a/b"), ("host", 7.5, "")]
    df = spark.createDataFrame(rows, "a string, b double, c string")
    found = {r["column"]: tuple(r)[1:] for r in diagnose.grammar(df, ["a", "b", "c"]).collect()}
    assert found["a"] == pytest.approx((2 / 3, 0, 4 / 3, 0, None), nan_ok=True)
    assert found["b"] == pytest.approx((1 / 4, 0, 1 / 4, 3 / 4, 2 / 3))
    assert found["c"][:4] == pytest.approx((1 / 4, 1 / 2, 3 / 4, 0))


def test_audit_takes_numbers_as_names(spark):
    rows = [(float(1001 + k % 60), k % 3, f"word{k % 60}"[:5]) for k in range(60 * 14)] + [(None, None, None)] * 9
    df = spark.createDataFrame(rows, "session double, kind int, word string")
    found = {r["column"]: tuple(r)[1:] for r in diagnose.actor_audit(df, ["session", "kind", "word"]).collect()}
    assert found["session"] == (60, 60, 1.0, True, False)  # short and without separators: a vocabulary
    assert found["kind"] == (3, 3, 1.0, True, False)
    ids = spark.createDataFrame([(f"sess-{k % 60}", ) for k in range(60 * 14)], "id string")
    assert tuple(diagnose.actor_audit(ids, ["id"]).first())[1:] == (60, 60, 1.0, False, True)

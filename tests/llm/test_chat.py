"""Windows keep every turn once, in order, within the budget, the same however a conversation is cut into chunks."""

from pyspark.sql import functions as F

from vigilog.llm import chat

KIND = "conv_id long, turn long, role string, text string"


def words(n, w="w"):
    return " ".join([w] * n)


def read(df, **how):
    made = chat.windows(df, **how)
    rows = made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).orderBy("conv_id", "window").collect()
    return [(r.conv_id, r.n_repeated, [(t.role, t.text) for t in r.turns], r.loss) for r in rows]


def tokens(turns):
    return sum(len(t.split()) + len(r.split()) + chat.TURN_OVERHEAD for r, t in turns)


def test_budget_covers_system_and_history(spark):
    rows = [(1, 0, "system", words(100, "s"))] + [(1, k, ("user", "assistant")[k % 2], words(90, "t" * (k % 9 + 1))) for k in range(1, 60)]
    rows += [(2, k, ("user", "assistant")[k % 2], words(20 + 37 * k % 300, "u" * (k % 9 + 1))) for k in range(40)] + [(3, 0, "user", words(3000, "x")), (3, 1, "assistant", "ok")]
    found = read(spark.createDataFrame(rows, KIND), budget=1024, history_tokens=256)
    for conv in (1, 2, 3):
        own = [t for c, n, turns, _ in found if c == conv for t in turns[n:]]
        assert own == [(r, t) for c, _, r, t in rows if c == conv]
        assert "".join(x for c, *_, x in found if c == conv) == "".join(t for c, _, r, t in rows if c == conv and r == "assistant")
    assert all(tokens(turns) <= 1024 for c, _, turns, _ in found if c < 3)
    assert all(turns[0] == ("system", words(100, "s")) for c, _, turns, _ in found if c == 1)
    assert len([1 for c, *_ in found if c == 1]) <= 12  # 59 turns of 95 tokens, 7 or so to a window
    assert any(n > 1 for c, n, *_ in found if c == 1)


def test_chunks_keep_order_and_history(spark, monkeypatch):
    rows = [(None, k if k > 5 else None, ("user", "assistant")[k % 2], words(5 + 13 * k % 30, "a" * (k % 9 + 1))) for k in range(50)]
    rows += [(5, 10 * k, "system" if not k else ("user", "assistant")[k % 2], words(5 + 29 * k % 200, "b" * (k % 9 + 1))) for k in range(70)] + [(5, 30, "user", "same")] * 3
    df = spark.createDataFrame(rows, KIND)
    for size in (7, 40, 1024):
        monkeypatch.setattr(chat, "CHUNK", size)
        found = read(df, budget=400, history_tokens=100)
        for conv in (None, 5):
            order = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, *r[2:]))
            turns = [(r, t) for _, _, r, t in order]
            own = [(n, x) for c, n, x, _ in found if c == conv]
            assert [t for n, x in own for t in x[n:]] == turns
            at = 0
            for n, x in own:
                wanted, left = [], 100
                for t in reversed(turns[max(0, at - 2) : at]):
                    left -= tokens([t])
                    if left < 0:
                        break
                    if t[0] != "system":
                        wanted.insert(0, t)
                assert x[:n] == ([turns[0]] if conv == 5 and at else []) + wanted
                at += len(x) - n
    assert chat.windows(spark.createDataFrame([], KIND)).collect() == []


def test_long_turns_drop_history_before_they_break_the_budget(spark):
    sizes = {1: [100, 200, 905, 30, 900, 10], 2: [705, *[60] * 20], 3: [950, *[40] * 12, 300], 4: [1200, 5, 5, 5]}
    rows = [(c, k, "system" if not k else ("user", "assistant")[k % 2], words(n - 1 - chat.TURN_OVERHEAD, "s" if not k else f"t{chr(97 + k)}")) for c, some in sizes.items() for k, n in enumerate(some)]
    found = read(spark.createDataFrame(rows, KIND), budget=1024, history_tokens=256)
    dropped = 0
    for c, n, turns, _ in found:
        own, system = turns[n:], sizes[c][0]
        assert tokens(turns) <= 1024 or (len(own) == 1 and tokens(own) + system > 1024)
        assert turns[0][0] == "system"
        dropped += tokens(own) > 800 and n == 1
    assert dropped >= 2  # the long turns of the first conversation keep the system turn alone
    for c in sizes:
        assert [t for x, n, turns, _ in found if x == c for t in turns[n:]] == [(r, t) for x, _, r, t in rows if x == c]

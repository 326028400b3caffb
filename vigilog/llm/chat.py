"""Chat formatting in budgeted windows; DataFrame functions only.

Turn tokens are counted, and prefix sums place turns into spans.  What a window
repeats is charged first: the leading system turn and up to ``history_tokens`` of
the previous turns leave a capacity C (an eighth of the budget at least, or what
the system turn leaves of it).  A turn of more than C / 2 tokens is a span of its
own; the others are cut where their running sum passes multiples of C less the
largest of them, so no span of several turns exceeds C and every window is
turn-aligned.  History is repeated as far as the budget allows beside the system
turn and the span, newest first.  So a window exceeds the budget only where the
system turn and a single turn do.  Each window starts with the system turn and
repeats up to ``history_turns`` previous turns within ``history_tokens``; the loss
mask covers the new assistant texts only, repeated ones are masked.

A conversation is read in chunks of CHUNK turn numbers, whose ends also end a
span: places, the system turn and the turns before a chunk come from a small
table of its chunks, so a conversation with a third of all rows spreads over many
tasks, and the texts are shuffled once.

Template: START role SEP text END per turn.  Control strings inside roles and
texts are escaped by a backslash after their first character, backslashes are
doubled; ``unescape`` reverses both.

Null roles and texts count as empty, null turns sort first, equal turns by role
and text, repeated rows are turns of their own, a null conv_id is one
conversation; very long texts stay whole; further columns are ignored.  An empty
table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's marks and the other strings tokenizers treat as control.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"<(?=\|(?:im_start|im_sep|im_end|endoftext)\|>|/?s>|</?SYS>>|/SYS>>)|\[(?=/?INST\])"
#: Tokens added by the marks of a turn.
TURN_OVERHEAD = 4
#: Turn numbers read by one task.
CHUNK = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def count_tokens(text: Column) -> Column:
    """Words, numbers of up to three digits and runs of other marks."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"))


def _chunks(turns: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """conv, chunk, the turns before it, their number, and of its conversation the system turn, capacity C and step."""
    room = budget - history_tokens
    whole = F.struct("turn", "role", "text")
    small = F.when(F.col("size") <= room / 2, F.col("size"))
    sums = turns.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max(small).alias("largest"), F.min(F.struct(whole.alias("t"), F.col("size").alias("size"))).alias("head"))
    by_conv = Window.partitionBy("conv").orderBy(F.col("chunk").asc_nulls_first())
    all_of = Window.partitionBy("conv")
    head = F.first("head").over(by_conv)
    sums = sums.withColumn("system", F.when(head["t"]["role"] == "system", head)).withColumn("chunks", F.count(F.lit(1)).over(all_of))
    left = F.lit(budget) - F.coalesce(F.col("system.size"), F.lit(0))
    capacity = F.greatest(left - history_tokens, F.least(F.lit(budget // 8), left), F.lit(1))
    largest = F.coalesce(F.max("largest").over(all_of), F.lit(0))
    sums = sums.withColumn("capacity", capacity).withColumn("step", F.greatest(F.col("capacity") - largest, F.floor(F.col("capacity") / 2), F.lit(1)))
    sums = sums.withColumn("at", F.coalesce(F.sum("n").over(by_conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # conversations of several chunks: the last turns of those before
    last = F.row_number().over(Window.partitionBy("conv", "chunk").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    split = turns.join(sums.filter("chunks > 1").select("conv", "chunk"), ["conv", "chunk"])
    tails = split.withColumn("last", last).filter(F.col("last") <= history_turns).groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "size"))).alias("tail"))
    near = F.flatten(F.collect_list("tail").over(by_conv.rowsBetween(-max(history_turns, 1), -1)))
    tails = sums.filter("chunks > 1").select("conv", "chunk").join(tails, ["conv", "chunk"], "left").select("conv", "chunk", near.alias("prior"))
    return sums.select("conv", "chunk", "at", "capacity", "step", F.col("system.t").alias("system"), F.coalesce("system.size", F.lit(0)).alias("system_size")).join(tails, ["conv", "chunk"], "left")


def windows(df: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256) -> DataFrame:
    """conv_id, window (the place of its first new turn), n_repeated, n_turns, formatted, loss_spans (code points: start from 0, length)."""
    turns = df.select(F.struct("conv_id").alias("conv"), F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 40))).alias("chunk"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("size", count_tokens("text") + count_tokens("role") + TURN_OVERHEAD)
    turns = turns.join(_chunks(turns, budget, history_turns, history_tokens), ["conv", "chunk"])
    order = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    big = F.col("size") > F.col("capacity") / 2
    turns = turns.withColumn("pos", F.row_number().over(order) + F.col("at"))
    turns = turns.withColumn("bigs", F.sum(big.cast("int")).over(running))
    turns = turns.withColumn("cut", F.floor((F.sum(F.when(~big, F.col("size")).otherwise(0)).over(running) - 1) / F.col("step")))
    turns = turns.withColumn("span", F.struct("bigs", big.alias("big"), F.when(~big, F.col("cut")).alias("cut")))
    turn = F.struct("role", "text", "size", ((F.col("pos") == 1) & (F.col("role") == "system")).alias("leads"))
    here = F.collect_list(turn).over(order.rowsBetween(-max(history_turns, 1), -1))
    # before a conversation's later chunks: the turns of those before; a leading system turn isn't history
    prior = F.transform(F.coalesce("prior", F.array()), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["size"].alias("size"), ((F.col("at") == F.size("prior")) & (t["role"] == "system") & (F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")) == F.col("system"))).alias("leads")))
    first_here = F.row_number().over(order) <= history_turns
    recent = F.when(first_here & (F.col("at") > 0), F.concat(prior, here)).otherwise(here)
    fresh = F.coalesce(F.lag("span").over(order) != F.col("span"), F.lit(True))
    turns = turns.withColumn("fresh", fresh).withColumn("recent", F.when(F.col("fresh"), F.slice(F.reverse(recent), 1, history_turns) if history_turns else F.array().cast("array<struct<role:string,text:string,size:int,leads:boolean>>")))
    # newest first: those whose tokens, with all newer ones, fit
    held = F.transform("recent", lambda t, i: F.struct(t.alias("t"), F.aggregate(F.slice("recent", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x["size"]).alias("sum")))
    near = F.transform(F.filter(held, lambda x: (x["sum"] <= history_tokens) & ~x["t"]["leads"]), lambda x: F.struct(x["sum"].alias("sum"), x["t"]["role"].alias("role"), x["t"]["text"].alias("text")))
    system = F.struct(F.col("system.role").alias("role"), F.col("system.text").alias("text"))
    leads = (F.col("pos") > 1) & F.col("system").isNotNull()
    lead = F.when(leads, F.array(system)).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    charged = F.when(leads, F.col("system_size")).otherwise(0)
    turns = turns.withColumn("repeated", F.when(F.col("fresh"), F.struct("pos", charged.alias("charged"), lead.alias("lead"), near.alias("near"))))
    made = turns.groupBy("conv", "chunk", "span").agg(F.min("repeated").alias("repeated"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("own"), F.sum("size").alias("own_size"))
    # of the history what the window's own turns and the system turn leave room for
    fits = F.reverse(F.transform(F.filter("repeated.near", lambda x: x["sum"] <= budget - F.col("repeated.charged") - F.col("own_size")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
    made = made.select(F.col("conv.conv_id").alias("conv_id"), F.col("repeated.pos").cast("long").alias("window"), F.concat("repeated.lead", fits).alias("repeated"), "own")
    own = F.transform("own", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    made = made.select("conv_id", "window", F.size("repeated").cast("long").alias("n_repeated"), F.size("own").cast("long").alias("n_turns"), F.concat("repeated", own).alias("all"))
    rendered = F.transform("all", lambda t: F.struct(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"), t["role"].alias("role")))
    made = made.withColumn("parts", rendered)
    lengths = F.transform("parts", lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(END))
    made = made.withColumn("lengths", lengths)
    start = F.transform("parts", lambda p, i: F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.char_length(p["head"]))
    made = made.withColumn("starts", start)
    spans = F.transform("parts", lambda p, i: F.struct(F.get("starts", i).alias("start"), F.char_length(p["body"]).alias("length"), ((p["role"] == "assistant") & (i >= F.col("n_repeated"))).alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return made.select("conv_id", "window", "n_repeated", "n_turns", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted window, unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>", -1), F.lit(2), F.size(F.split(formatted, r"<\|im_start\|>", -1)))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")

"""Secret scan by grammar inference.

Base patterns label credentials in the texts.  From a bounded sample of them
(``max_examples`` distinct ones for each kind, by smallest hash) a prefix tree
over character classes is built per kind and its statistically compatible states
are merged into a probabilistic automaton.  Every candidate token of the corpus
is then scored by the automata: the mean log-likelihood of its characters, its
end included.  A candidate that overlaps no base span is added with kind
``grammar`` if its likelihood is one that left-out labelled credentials reach
and lies ``margin`` or more above that under a character model of all tokens of
the texts.  Kinds of fewer than five examples add nothing.

Null and empty texts have no spans; repeated rows keep a row each; offsets are
code points, end exclusive; other columns are ignored by ``scan`` and kept by
``redact``; very long texts and tokens are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

# The base patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "grammar")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

_HEX_MASK = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_CAND_MASK = bytes(120 if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_=-") else 32 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0, m[2]) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in re.finditer(ACCESS, text) if len(m[0]) >= 20]
    if b"x" * 24 in text.encode().translate(_HEX_MASK):
        out += [(m.start(), m.end(), 2, m[0]) for m in re.finditer(HEX, text) if len(m[0]) >= 24]
    return [(s, e, KINDS[k], c) for s, e, k, c in sorted(out, key=lambda x: (x[0], x[2]))]


def candidates(text: str, base) -> list[tuple[int, int, str]]:
    """Tokens of 20 or more credential characters apart from the base spans."""
    if b"x" * 20 not in text.encode().translate(_CAND_MASK):
        return []
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(CANDIDATE, text)]
    return [f for f in found if not any(s < f[1] and f[0] < e for s, e, *_ in base)]


def symbol(ch: str) -> str:
    """The class of a character: digit, a-f, g-z, A-F, G-Z; any other stands for itself."""
    if "0" <= ch <= "9":
        return "d"
    if "a" <= ch <= "z":
        return "x" if ch <= "f" else "l"
    if "A" <= ch <= "Z":
        return "X" if ch <= "F" else "L"
    return ch


# Members of the character classes.
CLASS_SIZE = {"d": 10, "x": 6, "l": 20, "X": 6, "L": 20}
#: Counts that stand for a step never seen, and the likelihood of a character past one.
UNSEEN, LOST = 0.05, log(1e-4)


class Automaton:
    """A probabilistic automaton over character classes, inferred from example strings.

    The prefix tree's states are merged where their outgoing distributions, and
    those of the states they lead to, pass Hoeffding's test.  First only states of
    equal depth are merged, so that each has the evidence of all examples and
    lengths aren't lost; then states of different depths, which makes loops where
    the length varies.  States seen fewer than ``least`` times are no evidence:
    they merge within their depth only.
    """

    def __init__(self, examples: list[str], alpha: float = 0.05, least: int = 8):
        self.move: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]  # by class; "" is the end
        self.chars: list[Counter] = [Counter()]
        for x in examples:
            s = 0
            for ch in x:
                c = symbol(ch)
                self.count[s][c] += 1
                self.chars[s][ch] += 1
                if c not in self.move[s]:
                    self.move[s][c] = len(self.move)
                    self.move.append({})
                    self.count.append(Counter())
                    self.chars.append(Counter())
                s = self.move[s][c]
            self.count[s][""] += 1
        self.into = list(range(len(self.move)))
        self.bound, self.least = sqrt(0.5 * log(2 / alpha)), least
        self._merge_levels()
        self._merge_loops()
        self.states = sorted({self._at(s) for s in range(len(self.move))})

    def _at(self, s: int) -> int:
        while self.into[s] != s:
            self.into[s] = self.into[self.into[s]]
            s = self.into[s]
        return s

    def _alike(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = pair = tuple(map(self._at, todo.pop()))
            if a == b or pair in seen:
                continue
            seen.add(pair)
            x, y = self.count[a], self.count[b]
            n, m = sum(x.values()), sum(y.values())
            if n < self.least or m < self.least:
                continue
            limit = self.bound * (1 / sqrt(n) + 1 / sqrt(m))
            if any(abs(x[c] / n - y[c] / m) > limit for c in set(x) | set(y)):
                return False
            todo += [(self.move[a][c], t) for c, t in self.move[b].items() if c in self.move[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = map(self._at, todo.pop())
            if a == b:
                continue
            self.into[b] = a
            self.count[a].update(self.count[b])
            self.chars[a].update(self.chars[b])
            for c, t in self.move[b].items():
                if c in self.move[a]:
                    todo.append((self.move[a][c], t))
                else:
                    self.move[a][c] = t

    def _weight(self, s: int) -> int:
        return sum(self.count[s].values())

    def _merge_levels(self) -> None:
        level = [0]
        while level:
            below = sorted({self._at(t) for s in level for t in self.move[s].values()}, key=lambda t: (-self._weight(t), t))
            level = []
            for t in below:
                if self._at(t) != t:
                    continue
                like = next((r for r in level if self._alike(r, t)), None)
                if like is None:
                    level.append(t)
                else:
                    self._fold(like, t)

    def _merge_loops(self) -> None:
        red = [0]
        while True:
            blue = sorted({self._at(t) for s in red for t in self.move[s].values()} - set(red), key=lambda t: (-self._weight(t), t))
            if not blue:
                return
            t = blue[0]
            like = next((r for r in red if self._weight(t) >= self.least and self._alike(r, t)), None)
            if like is None:
                red.append(t)
            else:
                self._fold(like, t)
                red = [r for r in red if self._at(r) == r]

    def likelihood(self, text: str) -> float:
        """Mean natural log-likelihood of the characters and the end."""
        s, total = 0, 0.0
        for ch in text:
            if s is None:
                total += LOST
                continue
            c, n = symbol(ch), self._weight(s)
            total += log((self.count[s][c] + UNSEEN) / (n + UNSEEN * 12))
            total += log((self.chars[s][ch] + 1) / (self.count[s][c] + CLASS_SIZE.get(c, 1)))
            t = self.move[s].get(c)
            s = None if t is None else self._at(t)
        total += LOST if s is None else log((self.count[s][""] + UNSEEN) / (self._weight(s) + UNSEEN * 12))
        return total / (len(text) + 1)


class WordModel:
    """Character pairs of all tokens of the texts, the background of the likelihood ratio."""

    def __init__(self, pairs: dict[str, int]):
        self.pair, self.one, self.symbols = Counter(), Counter(), 70
        for (a, b), n in pairs.items():
            self.pair[a, b] += n
            self.one[a] += n

    @staticmethod
    def count(text: str) -> Counter:
        """The pairs of adjacent characters of all tokens of the text, with ``^`` before and ``$`` after each."""
        marked = "^" + re.sub(r"[^A-Za-z0-9+/_=-]+", "$^", text) + "$"
        pairs = Counter(map("".join, zip(marked, marked[1:])))
        pairs.pop("$^", None)
        pairs.pop("^$", None)
        return pairs

    def likelihood(self, text: str) -> float:
        steps = list(zip("^" + text, text + "$", strict=True))
        return sum(log((self.pair[s] + 0.5) / (self.one[s[0]] + 0.5 * self.symbols)) for s in steps) / len(steps)


class SecretGrammar:
    """An automaton for each kind of labelled credentials, with the likelihood that those left out of a fit reach."""

    FOLDS, REACHED = 5, 0.02

    def __init__(self, examples: dict[str, list[str]], pairs: dict[str, int], margin: float = 0.5):
        self.automata = {k: Automaton(v) for k, v in examples.items() if v}
        self.floor = {k: self._floor(examples[k]) for k in self.automata}
        self.words, self.margin = WordModel(pairs), margin

    @classmethod
    def _floor(cls, examples: list[str]) -> float:
        """The REACHED quantile of the likelihoods of examples under automata fitted without them; infinite for fewer than FOLDS."""
        if len(examples) < cls.FOLDS:
            return float("inf")
        scores = []
        for k in range(cls.FOLDS):
            fitted = Automaton([x for i, x in enumerate(examples) if i % cls.FOLDS != k])
            scores += [fitted.likelihood(x) for x in examples[k :: cls.FOLDS]]
        return sorted(scores)[int(len(scores) * cls.REACHED)]

    def score(self, token: str) -> float:
        """Log-likelihood per character over that of ordinary tokens, by the best automaton whose floor is reached; -inf where none is."""
        found = [x for k, a in self.automata.items() if (x := a.likelihood(token)) >= self.floor[k]]
        return max(found) - self.words.likelihood(token) if found else float("-inf")

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """Base spans and candidates that reach the margin, by start, then kind as listed."""
        base = base_spans(text)
        added = [(s, e, "grammar", c) for s, e, c in candidates(text, base) if self.score(c) >= self.margin]
        return sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]))) if added else base


SPAN = "array<struct<start:int,end:int,kind:string,secret:string>>"


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_id: bool = True) -> DataFrame:
    """One pass over the texts: doc_id (null unless ``with_id``), base spans, candidate spans (each with its string), and in one row of each batch the character pairs of all its tokens."""
    id_of = F.col(id_col) if with_id else F.lit(None).cast("long")
    source = df.select(id_of.alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("secret", pa.string())]))
        count = pa.list_(pa.struct([("pair", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            base, cand, pairs = [], [], Counter()
            for text in (x or "" for x in batch.column(1).to_pylist()):
                b = base_spans(text)
                base.append([{"start": s, "end": e, "kind": k, "secret": c} for s, e, k, c in b])
                cand.append([{"start": s, "end": e, "kind": "grammar", "secret": c} for s, e, c in candidates(text, b)])
                pairs.update(WordModel.count(text))
            counted = [[{"pair": p, "n": n} for p, n in pairs.items()], *[[]] * (batch.num_rows - 1)][: batch.num_rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(cand, span), pa.array(counted, count)], names=["doc_id", "base", "candidates", "pairs"])

    return source.mapInArrow(run, f"doc_id {kind}, base {SPAN}, candidates {SPAN}, pairs array<struct<pair:string,n:bigint>>")


def learn(found: DataFrame, max_examples: int = 400, margin: float = 0.5) -> SecretGrammar:
    """Automata from at most ``max_examples`` distinct labelled credentials of each kind; the word model from all words of all texts."""
    order = F.xxhash64("secret")
    labelled = found.select(F.explode("base").alias("s")).select("s.kind", "s.secret").distinct()
    examples = {k: [r.secret for r in labelled.filter(F.col("kind") == k).orderBy(order, "secret").limit(max_examples).collect()] for k in KINDS[:3]}
    counted = found.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("n"))
    return SecretGrammar(examples, {r.pair: r.n for r in counted.collect()}, margin)  # at most 69 x 69 pairs


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_examples: int = 400, margin: float = 0.5) -> DataFrame:
    """doc_id and spans: array of (start, end, kind, secret) by start, then kind as listed; one row for each input row."""
    small_batches(df.sparkSession)
    found = materialise(extract(df, id_col, text_col), "secrets")
    shared = df.sparkSession.sparkContext.broadcast(learn(found, max_examples, margin))

    @F.pandas_udf("array<double>")
    def scores(column):
        return column.map(lambda x: [] if x is None else [shared.value.score(c["secret"]) for c in x])

    scored = found.withColumn("scores", F.when(F.size("candidates") > 0, scores("candidates")))
    added = F.filter(F.col("candidates"), lambda c, i: F.coalesce(F.element_at("scores", i + 1) >= margin, F.lit(False)))
    return scored.select("doc_id", F.array_sort(F.concat("base", added), by_place).alias("spans"))


def by_place(a, b):
    """Comparator: start, then kind as listed."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int")
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(rank(a) - rank(b))


def redact(df: DataFrame, mark: str = "[SECRET]", text_col: str = "text", max_examples: int = 400, margin: float = 0.5) -> DataFrame:
    """``df`` with every found span replaced by ``mark``; texts without a span, null ones included, stay as they are.

    One pass learns, a second one scans again and replaces, so no text is shuffled.
    """
    small_batches(df.sparkSession)
    learned = learn(materialise(extract(df, text_col=text_col, with_id=False), "secrets"), max_examples, margin)
    shared = df.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("string")
    def replaced(text):
        import pandas as pd

        def one(t):
            if not t:
                return t
            out, at = [], 0
            for s, e, *_ in sorted(shared.value.spans(t), key=lambda x: (x[0], -x[1])):
                if s >= at:
                    out += [t[at:s], mark]
                at = max(at, e)
            return "".join([*out, t[at:]]) if out else t

        return pd.Series([one(t) for t in text], dtype=object)

    return df.withColumn(text_col, replaced(F.col(text_col)))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """Reference form of the span digest, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()

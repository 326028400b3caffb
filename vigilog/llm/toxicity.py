"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear numpy classifier over the presence of words and of runs of characters
in them is fitted from confirmed
toxic examples (positives) and unlabelled text.  With class prior ``p`` the risk
is ``p * R+(pos) + max(0, R-(unl) - p * R-(pos))``; where the second term turns
negative its gradient is stepped against, as the method prescribes.

The fit uses a bounded sample of the allowed rows: at most ``max_positive``
positives and ``max_unlabelled`` rows of any kind (confirmed ones included, so
that their share is the prior), those of smallest keyed hash of doc_id.  Scoring
covers every whole text.  Null texts count as empty and get the score of no words; with no positives the model is constant (score = prior).
Repeated rows keep one output row each; of rows with the same id the fit uses the
smallest text; further columns are kept, and one named as the output is replaced;
very long texts are scored whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT_TO_SPACE, crc_bucket, materialise, small_batches, texts


def words_of(text: bytes) -> set[bytes]:
    return set(text.lower().translate(PUNCT_TO_SPACE).split())


def pieces(word: bytes) -> list[bytes]:
    """The features of a word: itself and, marked by ``#``, its runs of 4 and 5 characters with its ends."""
    marked = f"^{word.decode(errors='replace')}$"
    return [word, *{("#" + marked[i : i + n]).encode() for n in (4, 5) for i in range(len(marked) - n + 1)}]


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float
    prior: float
    #: Weighted features by word, remembered in a worker (a speed bound only).
    memo: dict[bytes, tuple] = field(default_factory=dict, repr=False, compare=False)

    def probability(self, text: bytes) -> float:
        held: set[bytes] = set()
        for w in words_of(text):
            own = self.memo.get(w)
            if own is None:
                if len(self.memo) > 100_000:
                    self.memo.clear()
                own = self.memo[w] = tuple(f for f in pieces(w) if f in self.weights)
            if own:
                held.update(own)
        s = self.bias + math.fsum(self.weights[f] for f in held)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, s))))


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], names: list[bytes], prior: float, epochs: int = 600, rate: float = 0.05, l2: float = 1e-5, beta: float = 0.0, gamma: float = 1.0) -> ToxicityModel:
    """Full-batch Adam on the non-negative PU risk with the sigmoid loss, which bounds what one text can add.

    Texts are lists of positions in ``names``, the features.
    """
    import numpy as np

    prior = min(max(prior, 1e-4), 0.9)
    start = float(np.log(prior / (1 - prior)))
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return ToxicityModel({}, start, prior)

    def sparse(docs):
        return np.repeat(np.arange(len(docs)), [len(x) for x in docs]), np.concatenate([np.asarray(x, np.int64) for x in docs])

    (rp, cp), (ru, cu) = sparse(positive), sparse(unlabelled)
    k = len(names)
    theta = np.zeros(k + 1)
    theta[k] = start
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, epochs + 1):
        s_p = theta[k] + np.bincount(rp, theta[cp], n_p) if len(rp) else np.full(n_p, theta[k])
        s_u = theta[k] + np.bincount(ru, theta[cu], n_u) if len(ru) else np.full(n_u, theta[k])
        q_p, q_u = sigmoid(s_p), sigmoid(s_u)
        neg_risk = q_u.mean() - prior * q_p.mean()
        d_neg_p, d_neg_u = -prior * q_p * (1 - q_p) / n_p, q_u * (1 - q_u) / n_u
        if neg_risk >= -beta:
            g_p, g_u = 2 * d_neg_p, d_neg_u
        else:
            g_p, g_u = -gamma * d_neg_p, -gamma * d_neg_u
        grad = np.zeros(k + 1)
        if k:
            grad[:k] = np.bincount(cp, g_p[rp], k) + np.bincount(cu, g_u[ru], k) + l2 * theta[:k]
        grad[k] = g_p.sum() + g_u.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return ToxicityModel({w: float(theta[i]) for i, w in enumerate(names)}, float(theta[k]), prior)


def held_out(col=None):
    """True where crc32 of doc_id as text leaves 2 modulo 4: never learned from (null ids are not held out)."""
    return F.coalesce(crc_bucket(F.col("doc_id") if col is None else col, 4) == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 12000, prior: float | None = None, min_df: int = 5, min_z: float = 4.0, seed: int = 7) -> ToxicityModel:
    """Fit from rows that are not held out; ``prior`` defaults to the toxic share of their labels."""
    small_batches(documents.sparkSession)
    known = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = known.agg(F.avg("toxic")).first()[0] or 0.01
    order = F.xxhash64("doc_id", F.lit(seed))
    pos = known.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(max_positive).withColumn("positive", F.lit(True))
    rest = documents.filter(~held_out()).select("doc_id").distinct().orderBy(order, "doc_id").limit(max_unlabelled).withColumn("positive", F.lit(False))
    # one text for each drawn id, so that repeated ids don't widen the bound
    drawn = F.broadcast(pos.union(rest))
    sample = documents.select("doc_id", "text").join(drawn, "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))

    def words(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b" ".join(sorted(words_of(x))) for x in texts(b, "text")], pa.binary())], names=["positive", "words"])

    bags = materialise(sample.select("positive", "text").mapInArrow(words, "positive boolean, words binary"), "bags")
    sizes = {r.positive: r["count"] for r in bags.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return fit_nnpu([], [], [], prior)
    names = select_features(bags, sizes[True], sizes[False], min_df, min_z)
    shared = documents.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def slots(batches):
        import pyarrow as pa

        index, memo = shared.value, {}
        for b in batches:
            found = []
            for bag in b.column(1).to_pylist():
                own: set[int] = set()
                for w in bag.split():
                    if w not in memo:
                        memo[w] = [index[f] for f in pieces(w) if f in index]
                    own.update(memo[w])
                found.append(sorted(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["positive", "slots"])

    # as Arrow arrays: Python lists of so many numbers would take several times the driver's memory
    rows = bags.mapInArrow(slots, "positive boolean, slots array<int>").toArrow()
    held, starts = rows["slots"].combine_chunks(), [0]
    flat = held.flatten().to_numpy()
    starts.extend(held.value_lengths().to_numpy().cumsum().tolist())
    docs = {flag: [flat[starts[i] : starts[i + 1]] for i, f in enumerate(rows["positive"].to_pylist()) if f is flag] for flag in (True, False)}
    del rows, held, flat
    return fit_nnpu(docs[True], docs[False], names, prior)


def select_features(bags: DataFrame, n_p: int, n_u: int, min_df: int, min_z: float) -> list[bytes]:
    """Words and character runs in at least ``min_df`` sampled texts whose share differs between positives and unlabelled by ``min_z`` standard errors."""

    def count(batches):
        import pyarrow as pa

        def table(counts):
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())], names=["feature", "c_p", "c_u"])

        counts: dict[bytes, list[int]] = {}
        for b in batches:
            for flag, bag in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in {f for w in bag.split() for f in pieces(w)}:
                    counts.setdefault(f, [0, 0])[0 if flag else 1] += 1
                if len(counts) > 200_000:
                    yield table(counts)
                    counts = {}
        yield table(counts)

    counted = bags.mapInArrow(count, "feature binary, c_p long, c_u long").groupBy("feature").agg(F.sum("c_p").alias("c_p"), F.sum("c_u").alias("c_u"))
    pooled = (F.col("c_p") + F.col("c_u")) / (n_p + n_u)
    z = (F.col("c_p") / n_p - F.col("c_u") / n_u) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    chosen = counted.filter((F.col("c_p") + F.col("c_u") >= min_df) & (F.abs(z) >= min_z)).select("feature")
    return sorted(bytes(r.feature) for r in chosen.collect())  # bounded by the sample


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the model's probability, 0 to 1, for every whole text.

    ``df`` keeps its columns; the model's size is bounded by its sample.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(column):
        import pandas as pd

        return pd.Series([shared.value.probability(text.encode() if text else b"") for text in column], dtype="float64")

    return df.withColumn(out, probability(F.col(text_col)))

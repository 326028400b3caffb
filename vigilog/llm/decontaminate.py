"""Benchmark decontamination: BM25 inverted index of test items with block-max WAND.

Items are indexed once; each training passage (overlapping token windows over
the whole text, as wide as the items of one length class need) is a query, and
every item whose share of its own best BM25 score reaches ``threshold`` is
retrieved.  A passage is first bounded by its rarer terms alone, which skips no
item.  Retrieved pairs are verified on the text around: overlap of the item's
question (all but its last sentence) by 5-word shingles and of its answer (the
last sentence) by words in the same place.

Document frequencies and the mean length are those of all items.  The index is
broadcast in blocks of at most ``items_per_block`` items, one pass over the texts
per block, so its size is bounded whatever the benchmark's; an item's score, its
passages and its retrieval depend neither on the block nor on the other items'
lengths.

Null or empty texts and items match nothing; items without any word cannot
match; repeated rows of documents keep a row each; a repeated item counts once,
equal texts are reported for each item_id; an item's best passage is the first of
highest score; very long texts and items are read whole; other columns are
ignored by ``find`` and kept by ``drop_leaked``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT_TO_SPACE, materialise, small_batches, texts

K1, B = 1.2, 0.75
POSTINGS_PER_BLOCK = 16
#: Share of an item's best score that its most widespread terms may make up unread in the first bound.
LIGHT = 0.35


def tokens(text: bytes) -> list[bytes]:
    return text.lower().translate(PUNCT_TO_SPACE).split()


class Index:
    """Postings by term, in item order, cut into blocks with their largest contribution.

    A contribution is the BM25 weight divided by the item's own best score, so
    1.0 is a passage that holds every term of the item.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n: int, mean: float, stride: int):
        """``df``, ``n`` and ``mean`` are those of all items; ``stride`` is the length no item here exceeds."""
        self.stride = stride
        parsed = [(i, self.split(t)) for i, t in items]
        self.items = [(i, q, a) for i, (q, a) in parsed if q or a]
        bags = []
        for _, q, a in self.items:
            bag: dict[bytes, int] = {}
            for w in q + a:
                bag[w] = bag.get(w, 0) + 1
            bags.append(bag)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for d, bag in enumerate(bags):
            size = sum(bag.values())
            weight = {w: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean)) for w, c in bag.items()}
            best = sum(weight.values())
            for w, x in weight.items():
                postings.setdefault(w, []).append((d, x / best))
        self.docs = {w: [d for d, _ in p] for w, p in postings.items()}
        self.part = {w: [x for _, x in p] for w, p in postings.items()}
        self.bound = {w: max(x) for w, x in self.part.items()}
        # Per item, its most widespread terms, worth at most LIGHT together, may be left out of the first bound.
        self.light: dict[bytes, list[tuple[int, float]]] = {}
        self.rest = []
        for d, bag in enumerate(bags):
            at = {w: self.part[w][bisect_left(self.docs[w], d)] for w in bag}
            rest = 0.0
            for w in sorted(bag, key=lambda w: (-df[w], w)):
                if rest is not None and rest + at[w] <= LIGHT:
                    rest += at[w]
                    held = rest
                else:
                    held, rest = (held if rest is None else rest), None
                    self.light.setdefault(w, []).append((d, at[w]))
            self.rest.append(held)
        step = POSTINGS_PER_BLOCK
        self.block_end = {w: [p[min(k + step, len(p)) - 1] for k in range(0, len(p), step)] for w, p in self.docs.items()}
        self.block_max = {w: [max(x[k : k + step]) for k in range(0, len(x), step)] for w, x in self.part.items()}

    @staticmethod
    def split(text: str) -> tuple[list[bytes], list[bytes]]:
        """Question and answer tokens: the answer is the last sentence or line."""
        parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text or "") if tokens(p.encode())]
        toks = [tokens(p.encode()) for p in parts]
        return [w for p in toks[:-1] for w in p], (toks[-1] if toks else [])

    def wand(self, terms, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items whose summed contributions reach ``threshold``."""
        eps = 1e-9
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.bound[c[2]]
                if total >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            blocks, skip_to = 0.0, None
            for c in cursors[: pivot + 1]:
                ends = self.block_end[c[2]]
                b = bisect_left(ends, doc)
                if b < len(ends):
                    blocks += self.block_max[c[2]][b]
                    skip_to = ends[b] if skip_to is None else min(skip_to, ends[b])
            if blocks < threshold - eps:
                goal = max(doc, skip_to if skip_to is not None else doc) + 1
                if pivot + 1 < len(cursors):
                    goal = max(doc + 1, min(goal, cursors[pivot + 1][0]))
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == doc:
                score = sum(self.part[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold - eps:
                    out.append((doc, score))
                goal, moved = doc + 1, cursors[: pivot + 1]
            else:
                goal, moved = doc, [c for c in cursors[: pivot + 1] if c[0] < doc]
            for c in moved:
                docs = self.docs[c[2]]
                c[1] = bisect_left(docs, goal, c[1])
                c[0] = docs[c[1]] if c[1] < len(docs) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out


def overlaps(item, passage: list[bytes]) -> tuple[float, float]:
    """Shares of the question's 5-word shingles and of the answer's words found in the passage (1 where a part is empty)."""
    _, question, answer = item

    def grams(ws, n):
        return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}

    def share(part):
        if not part:
            return 1.0
        n = min(5, len(part))
        own = grams(part, n)
        return len(own & grams(passage, n)) / len(own)

    q = share(question)
    held = set(passage)
    a = sum(w in held for w in answer) / len(answer) if answer else 1.0
    return q, min(a, share(answer)) if not question else a


def stride_of(size: int) -> int:
    """The length class of an item: the power of two, 32 at least, that its tokens fit."""
    return max(32, 1 << max(size - 1, 0).bit_length())


def indexes(benchmark: DataFrame, items_per_block: int) -> list[list[Index]]:
    """For each block of items an Index for each length class."""
    small_batches(benchmark.sparkSession)
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def split(batches):
        import pyarrow as pa

        for b in batches:
            bags = [[w for part in Index.split(x.decode()) for w in part] for x in texts(b, "text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([sorted(set(x)) for x in bags], pa.list_(pa.binary())), pa.array([len(x) for x in bags], pa.int64())], names=["item_id", "text", "terms", "size"])

    items = benchmark.select("item_id", "text").distinct().mapInArrow(split, f"item_id {kind}, text string, terms array<binary>, size long").filter("size > 0")
    items = materialise(items.withColumn("place", F.xxhash64("item_id", "text")), "items")
    n, mean = items.agg(F.count(F.lit(1)), F.avg("size")).first()
    blocks = max(1, -(-n // items_per_block))
    frequency = items.select(F.explode("terms").alias("w")).groupBy("w").count()
    if blocks > 1:
        frequency = materialise(frequency, "frequency")
    out = []
    for k in range(blocks):
        part = items.filter(F.pmod("place", F.lit(blocks)) == k)
        rows = sorted(part.select("item_id", "text", "size").collect(), key=lambda r: (str(r.item_id), r.text))
        held = part.select(F.explode("terms").alias("w")).distinct().join(frequency, "w")
        df = {bytes(r.w): r["count"] for r in held.collect()}
        by_class: dict[int, list] = {}
        for r in rows:
            by_class.setdefault(stride_of(r["size"]), []).append((r.item_id, r.text))
        out.append([Index(x, df, n, mean, stride) for stride, x in sorted(by_class.items())])
    return out


class Searcher:
    """Finds the items of some indexes in texts."""

    def __init__(self, parts: list[Index], threshold: float, min_question: float, min_answer: float):
        self.parts, self.threshold, self.min_question, self.min_answer = parts, threshold, min_question, min_answer
        self.need = [[threshold - 1e-9 - r for r in part.rest] for part in parts]
        self.always = [any(x <= 0 for x in need) for need in self.need]

    def find(self, text: bytes, one: bool = False) -> list[tuple]:
        """(item_id, score, question overlap, answer overlap) of each item found, only the first ``one`` if asked."""
        words, out = tokens(text), []
        for part, need, always in zip(self.parts, self.need, self.always, strict=True):
            best = self._in_part(words, part, need, always, one)
            out += [(part.items[i][0], *v) for i, v in sorted(best.items())]
            if one and out:
                break
        return out

    def _in_part(self, words, part: Index, need, always, one: bool) -> dict[int, tuple]:
        light, bound, stride = part.light, part.bound, part.stride
        at = [i for i, w in enumerate(words) if w in light]
        best: dict[int, tuple] = {}
        if not at and not always:
            return best
        lists = [light[words[i]] for i in at]
        for s in range(0, max(1, len(words) - stride), stride):
            e = min(s + 2 * stride, len(words))
            if not always and not self._promising(lists[bisect_left(at, s) : bisect_left(at, e)], need):
                continue
            terms = {w for w in words[s:e] if w in bound}
            if sum(bound[w] for w in terms) < self.threshold - 1e-9:
                continue
            for item, score in part.wand(sorted(terms), self.threshold):
                if item in best and best[item][0] >= score:
                    continue
                q, a = overlaps(part.items[item], words[max(0, s - stride) : e + stride])
                if q >= self.min_question and a >= self.min_answer:
                    best[item] = (score, q, a)
                    if one:
                        return best
        return best

    @staticmethod
    def _promising(lists, need) -> bool:
        """Whether an item can reach the threshold: its rarer terms here plus all of its widespread ones."""
        total: dict[int, float] = {}
        for postings in lists:
            for d, x in postings:
                total[d] = t = total.get(d, 0.0) + x
                if t >= need[d]:
                    return True
        return False


def find(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_question: float = 0.6, min_answer: float = 0.6, items_per_block: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: every verified pair, at its best passage."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def searching(shared):
        def run(batches):
            import pyarrow as pa

            searcher = Searcher(shared.value, threshold, min_question, min_answer)
            item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string())
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[k], *found) for k, text in enumerate(texts(batch, "text")) for found in searcher.find(text)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = [batch.schema.field(0).type, item_type, pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return run

    parts = [source.mapInArrow(searching(spark.sparkContext.broadcast(block)), schema) for block in indexes(benchmark, items_per_block)]
    return reduce(DataFrame.union, parts)


def drop_leaked(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_question: float = 0.6, min_answer: float = 0.6, items_per_block: int = 20_000, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` whose text holds no item; decided row by row, whatever their ids."""
    spark = documents.sparkSession
    for block in indexes(benchmark, items_per_block):

        def leaked(column, shared=spark.sparkContext.broadcast(block)):
            searcher = Searcher(shared.value, threshold, min_question, min_answer)
            return column.map(lambda x: bool(x) and bool(searcher.find(x.encode(), one=True))).astype(bool)

        documents = documents.filter(~F.pandas_udf(lambda column, f=leaked: f(column), "boolean")(F.col(text_col)))
    return documents

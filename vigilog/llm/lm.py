"""Language-model scoring from a log-frequency Bloom filter.

Unigram and bigram counts of the training texts are quantised on a growing
scale; an n-gram of level q puts its levels 1..q into a Bloom filter, and its
count is read back by probing level after level until one is missing.  The
filter is cut into segments by hash bucket, each built where that bucket is
summed; it holds every n-gram and so grows with the corpus.

A filter that can't be over ``broadcast_bytes`` is broadcast and probed where the texts
are.  Otherwise the distinct n-grams of each group of texts travel to their bucket
with their training counts, once; there they are summed, the segment is built and
probed, and levels (of words also exact counts) come back to the group.  Both ways
probe the same segments and give the same scores.  Bigrams keep 32 bits of their hash
within a bucket, which mistakes far fewer of them than the filter does.

Smoothing: p(w) = (c(w) + 1) / (N + V + 1) and p(w | u) = (c(u w) + k p(w)) /
(c(u) + k), with the text's end as the context of its first word.

The add-one base score needs exact counts: beside a broadcast filter, tokens with at
least ``N / MAX_HEAVY`` occurrences (so at most ``MAX_HEAVY``) are broadcast, all others
are joined, which also keeps frequent words out of the join.  Tokens are keyed
by their 64-bit hash.

Null and empty texts consist of their end token; a null id counts as not held
out; repeated rows keep a row each; very long texts are read whole; other columns
are ignored; with no training row the base is that of N = V = 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, texts

#: A filter of at most so many bytes is broadcast.
BROADCAST_BYTES = 96 << 20
MAX_HEAVY = 1 << 20
BITS_PER_ENTRY = 12
PROBES = 5
#: Texts are worked on in groups of about this many tokens, and of so many rows at most.
GROUP_TOKENS, GROUP_ROWS = 800_000, 4000
#: Distinct n-grams that a task sums up before it sends them.
HELD_KEYS = 2_000_000
#: A white-space byte, so never a word.
END = b"\n"


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram_keys(before, after, buckets: int):
    """Keys below ``buckets`` times 2**32, the bucket being the remainder."""
    import numpy as np

    h, b = _mix(before * np.uint64(0x9E3779B97F4A7C15) + _mix(after)), np.uint64(buckets)
    return (h // b & np.uint64(0xFFFFFFFF)) * b + h % b


def codebook(growth: float = 1.2, top: float = 1e15):
    """Lower ends of the quantised counts: 1, 2, 3, ... growing by ``growth``."""
    values, x = [1], 1.0
    while values[-1] < top:
        x = max(values[-1] + 1, x * growth)
        values.append(int(x))
    return values


LEVELS = codebook()


@dataclass
class LogFrequencyFilter:
    """Segments by bucket, one after the other."""

    data: bytes
    lengths: list

    def __post_init__(self):
        import numpy as np

        self.bits = np.array(self.lengths, np.uint64) * np.uint64(8)
        self.base = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        self.flags = np.frombuffer(self.data, np.uint8)

    def __reduce__(self):
        return LogFrequencyFilter, (self.data, self.lengths)

    @classmethod
    def of(cls, segments: list[bytes]) -> LogFrequencyFilter:
        return cls(b"".join(segments), [len(s) for s in segments])

    @staticmethod
    def value(levels):
        """The counts that levels stand for, 0 for none."""
        import numpy as np

        ends = np.array(LEVELS, float)
        return np.concatenate([[0.0], np.sqrt(ends[:-1] * np.maximum(ends[:-1], ends[1:] - 1)), ends[-1:]])[np.minimum(levels, len(ends))]

    @staticmethod
    def positions(keys, level, bits):
        """The ``PROBES`` bit positions of (key, level), one row each."""
        import numpy as np

        g = _mix(keys + np.uint64(0xD1B54A32D192ED03) * np.asarray(level, np.uint64))
        step = _mix(g) | np.uint64(1)
        return [(g + np.uint64(i) * step) % bits for i in range(PROBES)]

    @staticmethod
    def build(keys, counts) -> bytes:
        """The segment of one bucket."""
        import numpy as np

        levels = np.searchsorted(LEVELS, counts, "right")
        bits = -(-max(64, BITS_PER_ENTRY * int(levels.sum())) // 8) * 8
        flags = np.zeros(bits, bool)
        level = 1
        while len(keys):
            for p in LogFrequencyFilter.positions(keys, level, np.uint64(bits)):
                flags[p.astype(np.int64)] = True
            level += 1
            more = levels >= level
            keys, levels = keys[more], levels[more]
        return np.packbits(flags, bitorder="little").tobytes()

    def levels(self, keys):
        """The quantised counts of the keys, 0 where even level one is missing."""
        import numpy as np

        bucket = (keys % np.uint64(len(self.lengths))).astype(np.int64)
        level = np.zeros(len(keys), np.uint8)
        alive = np.arange(len(keys))
        j = 1
        while len(alive):
            b = bucket[alive]
            ok = np.ones(len(alive), bool)
            for p in self.positions(keys[alive], j, self.bits[b]):
                at = np.flatnonzero(ok)
                q = p[at]
                ok[at] = (self.flags[self.base[b[at]] + (q >> np.uint64(3)).astype(np.int64)] >> (q & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[ok]
            level[alive] = j
            j += 1
        return level


def _groups(batches, column: str):
    """Groups of rows: batch, first row, ids of tokens, end position of each text, hashes of the distinct tokens.

    Every text ends with END; ids point into the hashes, in which END is first.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    def close(batch, first, ids, ends, index):
        hashes = np.fromiter((xxh64_intdigest(t) for t in index), np.uint64, len(index))
        return batch, first, np.array(ids, np.int64), np.array(ends, np.int64), hashes

    for batch in batches:
        first, ids, ends, index = 0, [], [], {END: 0}
        for k, text in enumerate(texts(batch, column)):
            add = index.setdefault
            ids.extend([add(w, len(index)) for w in text.lower().split()])
            ids.append(0)
            ends.append(len(ids))
            if len(ids) >= GROUP_TOKENS:
                yield close(batch, first, ids, ends, index)
                first, ids, ends, index = k + 1, [], [], {END: 0}
        if ends:
            yield close(batch, first, ids, ends, index)


def _before(ids, ends):
    """The token before each token; END before a text's first."""
    import numpy as np

    out = np.concatenate([[0], ids[:-1]])
    out[np.concatenate([[0], ends[:-1]])] = 0
    return out


def _merged(parts):
    """Sorted distinct keys and summed counts of (keys, counts) pairs."""
    import numpy as np

    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _partial_counts(df: DataFrame, buckets: int, order: int) -> DataFrame:
    """bucket, hashes, counts (binary): n-gram counts summed over as much of each task as HELD_KEYS keys allow."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def dealt(keys, counts):
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            sort = np.argsort(bucket, kind="stable")
            keys, counts = keys[sort], counts[sort].astype(np.int32)
            cut = np.searchsorted(bucket[sort], np.arange(buckets + 1))
            some = np.flatnonzero(cut[1:] > cut[:-1])
            pieces = [(keys[cut[b] : cut[b + 1]].tobytes(), counts[cut[b] : cut[b + 1]].tobytes()) for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.binary())], names=["bucket", "hashes", "counts"])

        held, size = [], 0
        for _, _, ids, ends, hashes in _groups(batches, "text"):
            if order == 1:
                held.append((hashes, np.bincount(ids, minlength=len(hashes))))
            else:
                held.append(np.unique(bigram_keys(hashes[_before(ids, ends)], hashes[ids], buckets), return_counts=True))
            size += len(held[-1][0])
            if size >= HELD_KEYS:
                held = [_merged(held)]
                size = len(held[0][0])
                if size >= HELD_KEYS // 2:
                    yield dealt(*held[0])
                    held, size = [], 0
        if held:
            yield dealt(*_merged(held))

    return df.select("text").mapInArrow(run, "bucket int, hashes binary, counts binary")


def _summed(table):
    import numpy as np

    return _merged([(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int32)) for k, c in zip(table["hashes"].to_pylist(), table["counts"].to_pylist(), strict=True)])


def unigrams(train: DataFrame, buckets: int) -> DataFrame:
    """h, c: exact counts of the training tokens by hash."""

    def total(table):
        import numpy as np
        import pyarrow as pa

        keys, counts = _summed(table)
        return pa.table({"h": keys.view(np.int64), "c": counts})

    return _partial_counts(train, buckets, 1).groupBy("bucket").applyInArrow(total, "h long, c long")


def _segments(parts: DataFrame) -> DataFrame:
    def build(table):
        import pyarrow as pa

        return pa.table({"bucket": table["bucket"].combine_chunks()[:1], "segment": pa.array([LogFrequencyFilter.build(*_summed(table))], pa.binary())})

    return parts.groupBy("bucket").applyInArrow(build, "bucket int, segment binary")


def _unigram_segments(counts: DataFrame, buckets: int) -> DataFrame:
    def build(table):
        import numpy as np
        import pyarrow as pa

        keys = table["h"].to_numpy().view(np.uint64)
        return pa.table({"bucket": table["bucket"].combine_chunks()[:1], "segment": pa.array([LogFrequencyFilter.build(keys, table["c"].to_numpy())], pa.binary())})

    # unsigned remainder of the hash, as in the filter
    high = F.shiftrightunsigned("h", 1)
    bucket = ((high % buckets) * 2 + (F.col("h").bitwiseAND(F.lit(1)))) % buckets
    return counts.select(bucket.cast("int").alias("bucket"), "h", "c").groupBy("bucket").applyInArrow(build, "bucket int, segment binary")


def _loaded(segments: DataFrame, buckets: int) -> LogFrequencyFilter:
    table = segments.select("bucket", "segment").toArrow()  # at most BROADCAST_BYTES
    found = dict(zip(table["bucket"].to_pylist(), table["segment"].to_pylist(), strict=True))
    return LogFrequencyFilter.of([found.get(b, b"\0" * 8) for b in range(buckets)])


def _bigrams(ids, ends, hashes):
    """before, after (positions in hashes) of the distinct bigrams, and each token's place among them."""
    import numpy as np

    pair, back = np.unique(_before(ids, ends) * len(hashes) + ids, return_inverse=True)
    return pair // len(hashes), pair % len(hashes), back


def _of_heavy(hashes, heavy):
    """The exact counts of the heavy tokens, -1 for all others."""
    import numpy as np

    heavy_h, heavy_c = heavy
    if not len(heavy_h):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(heavy_h, hashes), len(heavy_h) - 1)
    return np.where(heavy_h[at] == hashes, heavy_c[at], -1)


def _scores(ids, ends, hashes, levels, exact, buckets: int, n: int, v: int, strength: float):
    """Of a group's texts: tokens, known tokens of exact count, their base sum, score, and offsets, hashes and times of the tokens to join."""
    import numpy as np

    docs_n = len(ends)
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(docs_n), sizes)
    known = np.bincount(doc, (exact > 0)[ids], docs_n).astype(np.int64)
    base = np.bincount(doc, np.log10(np.maximum(exact, 0) + 1.0)[ids], docs_n)
    u, w, back = _bigrams(ids, ends, hashes)
    one, two = levels(hashes, bigram_keys(hashes[u], hashes[w], buckets))
    c1 = LogFrequencyFilter.value(one)
    p1 = (c1 + 1) / (n + v + 1)
    c2 = np.minimum(LogFrequencyFilter.value(two), c1[u])
    logs = np.log10((c2 + strength * p1[w]) / (c1[u] + strength))
    tail = exact[ids] < 0
    rare, times = np.unique(doc[tail] * len(hashes) + ids[tail], return_counts=True)
    offsets = np.searchsorted(rare // len(hashes), np.arange(docs_n + 1)).astype(np.int32)
    return sizes.astype(np.int64), known, base, np.bincount(doc, logs[back], docs_n), offsets, hashes[rare % len(hashes)].view(np.int64), times.astype(np.int32)


def _result(row, doc_ids, held, scores):
    import pyarrow as pa

    sizes, known, base, model, offsets, tail, times = scores
    columns = [row, doc_ids, held, pa.array(sizes), pa.array(known), pa.array(base), pa.array(model), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tail)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times))]
    return columns, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail", "times"]


def _by_broadcast(docs: DataFrame, filters, buckets: int, heavy, n: int, v: int, strength: float, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((heavy, filters))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        heavy, (one, two) = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch, first, ids, ends, hashes in _groups(batches, "text"):
            part = batch.slice(first, len(ends))
            scores = _scores(ids, ends, hashes, lambda x, y: (one.levels(x), two.levels(y)), _of_heavy(hashes, heavy), buckets, n, v, strength)
            yield pa.RecordBatch.from_arrays(*_result(pa.array(np.arange(row, row + len(ends))), part.column(0), part.column(1), scores))
            row += len(ends)

    return docs.mapInArrow(run, schema)


def _packed(numbers) -> bytes:
    """Numbers compressed byte by byte of equal weight, with their count."""
    import numpy as np
    import pyarrow as pa

    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) + len(numbers).to_bytes(8, "little")


def _unpacked(data: bytes, kind: str):
    import numpy as np
    import pyarrow as pa

    n, size = int.from_bytes(data[-8:], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[:-8], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _dealt(keys, buckets: int, order: int):
    """The order of ``keys`` by bucket and key, the buckets that have some, and where each ends in that order."""
    import numpy as np

    b = np.uint64(buckets)
    bucket, rest = keys % b, keys // b
    # the rest of a bigram has 32 bits
    at = np.argsort(bucket << np.uint64(32) | rest) if order else np.lexsort((rest, bucket))
    sizes = np.bincount(bucket.astype(np.int64), minlength=buckets)
    some = np.flatnonzero(sizes)
    return at, some, np.cumsum(sizes)[some]


def _by_shuffle(docs: DataFrame, buckets: int, strength: float) -> tuple[DataFrame, int, int]:
    """row, doc_id, held_out, n_tokens, known, base, score with all counts exact; N and V.

    The texts are read twice, and must come in the same order both times.
    """
    import functools

    kind = docs.schema["doc_id"].dataType.simpleString()

    def numbered(batches):
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() << 40
        for batch, first, ids, ends, hashes in _groups(batches, "text"):
            yield group, batch.slice(first, len(ends)), ids, ends, hashes
            group += len(ends)  # a group has the number of its first row

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        for group, part, ids, ends, hashes in numbered(batches):
            learned = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(ends, prepend=0))
            u, w, back = _bigrams(ids, ends, hashes)
            for order, keys, places in ((0, hashes, ids), (1, bigram_keys(hashes[u], hashes[w], buckets), back)):
                counts = np.bincount(places[learned], minlength=len(keys)).astype(np.uint32)
                at, some, ends_at = _dealt(keys, buckets, order)
                keys, counts, start, sent = keys[at] // np.uint64(buckets), counts[at], 0, []
                for end in ends_at:
                    sent.append((_packed(np.diff(keys[start:end], prepend=np.uint64(0))), _packed(counts[start:end])))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array([order] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array([group] * len(some), pa.int64()), *(pa.array([x[k] for x in sent], pa.binary()) for k in (0, 1))], names=["order", "bucket", "group", "keys", "counts"])

    def answer(who, table):
        import numpy as np
        import pyarrow as pa

        order, bucket = (x.as_py() for x in who)
        asked = [np.cumsum(_unpacked(k, "uint64"), dtype=np.uint64) for k in table["keys"].to_pylist()]
        keys, back = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(back, np.concatenate([_unpacked(c, "uint32") for c in table["counts"].to_pylist()]), len(keys)).astype(np.int64)
        keys = keys * np.uint64(buckets) + np.uint64(bucket)
        seen = counts > 0
        found = LogFrequencyFilter.of([LogFrequencyFilter.build(keys[seen], counts[seen])]).levels(keys)[back]
        cut = np.cumsum([len(k) for k in asked])[:-1]
        exact = [_packed(c) for c in np.split(counts[back], cut)] if order == 0 else [None] * len(asked)
        none = pa.array([0] * (len(asked) - 1), pa.int64())
        total = lambda x: pa.concat_arrays([pa.array([int(x) if order == 0 else 0], pa.int64()), none])
        return pa.table({"group": table["group"], "order": table["order"], "bucket": table["bucket"], "levels": pa.array([_packed(x) for x in np.split(found, cut)], pa.binary()), "exact": pa.array(exact, pa.binary()), "n": total(counts.sum()), "v": total(seen.sum())})

    def pack(batches):
        import pyarrow as pa

        for group, part, ids, ends, hashes in numbered(batches):
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            yield pa.RecordBatch.from_arrays([pa.array([group]), whole(part.column(0)), whole(part.column(1)), *(pa.array([x], pa.binary()) for x in (_packed(ids.astype("int32")), ends.tobytes(), hashes.tobytes()))], names=["group", "doc_id", "held_out", "ids", "ends", "hashes"])

    def finish(n, v, group, found):
        import numpy as np
        import pyarrow as pa

        if group.num_rows != 1:
            raise ValueError("the texts came in another order when they were read again")
        r = group.to_pylist()[0]
        ids, ends, hashes = _unpacked(r["ids"], "int32").astype(np.int64), np.frombuffer(r["ends"], np.int64), np.frombuffer(r["hashes"], np.uint64)
        got = sorted(zip(found["order"].to_pylist(), found["bucket"].to_pylist(), found["levels"].to_pylist(), found["exact"].to_pylist(), strict=True), key=lambda x: x[:2])

        def told(order, keys, place, kind):
            parts = [_unpacked(x[place], kind) for x in got if x[0] == order]
            out = np.zeros(len(keys), kind)
            out[_dealt(keys, buckets, order)[0]] = np.concatenate(parts)  # fails if the numbers differ
            return out

        scores = _scores(ids, ends, hashes, lambda one, two: (told(0, one, 2, "uint8"), told(1, two, 2, "uint8")), told(0, hashes, 3, "int64"), buckets, n, v, strength)
        rows = pa.array(r["group"] + np.arange(len(ends)))
        columns, names = _result(rows, pa.array(r["doc_id"], group.schema.field("doc_id").type.value_type), pa.array(r["held_out"], pa.bool_()), scores)
        return pa.table(dict(zip(names[:7], columns[:7], strict=True)))

    asked = docs.mapInArrow(ask, "`order` int, bucket int, group long, keys binary, counts binary")
    answers = materialise(asked.groupBy("order", "bucket").applyInArrow(answer, "group long, `order` int, bucket int, levels binary, exact binary, n long, v long"), "levels")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    groups = docs.mapInArrow(pack, f"group long, doc_id array<{kind}>, held_out array<boolean>, ids binary, ends binary, hashes binary")
    done = functools.partial(finish, n, v)
    scored = groups.groupBy("group").cogroup(answers.drop("n", "v").groupBy("group")).applyInArrow(lambda a, b: done(a, b), f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double")
    return scored, n, v


def score(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", strength: float = 1000.0, bucket_bytes: int = 8 << 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every whole text.

    ``held_out`` (a Column) marks the rows that are not learned from.
    """
    import numpy as np

    small_batches(df.sparkSession, GROUP_ROWS)
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    train = docs.filter(~F.col("held_out"))
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))

    def shown(scored, n: int, v: int, known, base):
        return scored.select(
            "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (base - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), "score",
        )

    # a text has half as many tokens as bytes at most, of both orders; an n-gram's levels are no more than its occurrences
    if size * BITS_PER_ENTRY // 8 > broadcast_bytes:
        scored, n, v = _by_shuffle(docs, buckets, strength)
        return shown(scored, n, v, F.col("known"), F.col("base"))
    uni = materialise(unigrams(train, buckets), "unigrams")
    n, v = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    heavy_from = max(1, -(-n // MAX_HEAVY))
    top = uni.filter(F.col("c") >= heavy_from).toArrow()  # at most MAX_HEAVY rows
    hashes, order = top["h"].to_numpy().view(np.uint64), np.argsort(top["h"].to_numpy().view(np.uint64))
    heavy = hashes[order], top["c"].to_numpy()[order]
    made = [_unigram_segments(uni, buckets), _segments(_partial_counts(train, buckets, 2))]
    segments = materialise(made[0].withColumn("order", F.lit(0)).union(made[1].withColumn("order", F.lit(1))), "segments")
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail array<long>, times array<int>"
    filters = [_loaded(segments.filter(F.col("order") == k), buckets) for k in (0, 1)]
    made = _by_broadcast(docs, filters, buckets, heavy, n, v, strength, schema)
    scored = materialise(made, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.times").alias("times"))
    light = uni.filter(F.col("c") < heavy_from)
    exact = rare.join(light, "h").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("more_known"))
    joined = scored.drop("tail", "times").join(exact, "row", "left")
    return shown(joined, n, v, F.col("known") + F.coalesce("more_known", F.lit(0)), F.col("base") + F.coalesce("more", F.lit(0.0)))

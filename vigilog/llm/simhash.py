"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared exactly within ``radius``: cut into ``m`` blocks, two
fingerprints within the radius agree in at least ``m - radius`` of them, so each
choice of that many blocks is one lookup table.  ``m`` grows with the number of
distinct fingerprints, which keeps the buckets small at any size.  A bucket's
fingerprints are stored as vertical bit planes of 64 lanes; one pass over the
planes updates 64 distances at once with carry-save counters and drops a block
of lanes as soon as all of them exceed the radius.

Equal fingerprints are collapsed before any comparison, buckets past
``TILE`` fingerprints are split into pairs of tiles, and each bucket returns a
spanning forest of its links instead of all pairs.

Null or blank texts have fingerprint zero and link like any other; repeated
rows keep one output row each; a component whose doc_ids are all null has a null
id; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, texts

TILE = 8192
#: (row, word) comparisons held at once.
CHUNK = 1 << 15
#: Fingerprints of at least COPIES rows, the MAX_HOT most frequent ones at most, are joined by broadcast.
COPIES, MAX_HOT = 1000, 10_000


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long): one bit per position set in over half of the shingles' XXH64 (seed 42)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest as h64

        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for k, text in enumerate(texts(batch, "_text")):
                words = text.lower().split()
                if not words:
                    continue
                if len(words) <= shingle:
                    grams = [b" ".join(words)]
                else:
                    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
                hashes = np.array([h64(g, 42) for g in grams], np.uint64)
                ones = np.zeros(64, np.int64)
                for i in range(0, len(hashes), 1 << 16):
                    part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
                    ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
                out[k] = np.packbits(ones * 2 > len(hashes)).view(">u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"doc_id {kind}, fp long")


def plan_blocks(n: int, radius: int, bits: int = 64, target: int = 512) -> list[tuple[int, int]]:
    """The (low, high) bit ranges: the fewest blocks whose lookup keys leave about ``target`` in a bucket."""
    m = radius + 1
    while m < 2 * radius + 2 and n / 2 ** (bits * (m - radius) / m) > target and comb(m + 1, radius) <= 256:
        m += 1
    return [(bits * i // m, bits * (i + 1) // m) for i in range(m)]


def _buckets(fps: DataFrame, blocks, radius: int) -> DataFrame:
    """tab, key, fp: one row for each lookup table."""
    keys = []
    for combo in combinations(range(len(blocks)), len(blocks) - radius):
        mask = 0
        for i in combo:
            lo, hi = blocks[i]
            mask |= ((1 << (hi - lo)) - 1) << lo
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.col("fp").bitwiseAND(F.lit(signed).cast("long")))
    return fps.select("fp", F.posexplode(F.array(*keys)).alias("tab", "key"))


def _planes(values):
    """Bit planes (64, words) of 64-lane words; lane i of word w is value 64 * w + i."""
    import numpy as np

    words = -(-len(values) // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.reshape(words, 64, 64), axis=1, bitorder="little")
    return np.ascontiguousarray(packed.transpose(2, 0, 1)).view("<u8")[:, :, 0]


def close_lanes(rows, planes, word_of, radius: int):
    """For each comparison (row value, word index): the lanes of that word within ``radius`` of the row, as a mask."""
    import numpy as np

    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    width = (radius + 1).bit_length() + 1
    result = np.zeros(len(rows), np.uint64)
    alive = np.arange(len(rows))
    counter = [np.zeros(len(rows), np.uint64) for _ in range(width)]
    over = np.zeros(len(rows), np.uint64)
    limit = radius + 1
    for k in range(64):
        ones = (np.uint64(0) - ((rows >> np.uint64(k)) & np.uint64(1))).astype(np.uint64)
        carry = planes[k][word_of] ^ ones
        for b in range(width):
            carry, counter[b] = counter[b] & carry, counter[b] ^ carry
        equal = full
        for b in range(width):
            equal = equal & (counter[b] if limit >> b & 1 else ~counter[b])
        over |= equal
        if k % 8 == 7 and k >= 15:
            keep = over != full
            if keep.sum() < 0.7 * len(keep):
                alive, rows, word_of, over = alive[keep], rows[keep], word_of[keep], over[keep]
                counter = [c[keep] for c in counter]
                if not len(alive):
                    break
    result[alive] = ~over
    return result


def _lanes(sizes, fps):
    """Buckets of the given sizes as bit planes, each from a new word on: planes, used lanes, and per row its bucket, place, first word and words."""
    import numpy as np

    words = -(-sizes // 64)
    base = np.concatenate([[0], np.cumsum(words)])[:-1]
    lanes = np.zeros(int(words.sum()) * 64, np.uint64)
    used = np.zeros(len(lanes), bool)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(bucket)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
    slot = base[bucket] * 64 + place
    lanes[slot], used[slot] = fps, True
    planes = _planes(lanes)
    valid = np.packbits(used.reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    return planes, valid, bucket, place, base, words[bucket]


def close_pairs(sizes, fps, asked, radius: int):
    """Batches (i, j) of positions in ``fps``: each row of ``asked`` with the rows of its bucket within ``radius``.

    Buckets lie one after the other with the given sizes; ``asked`` is ascending.
    """
    import numpy as np

    planes, valid, bucket, place, base, per_row = _lanes(sizes, fps)
    done = np.cumsum(per_row[asked])
    first = 0
    while first < len(asked):
        last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + CHUNK, "right")))
        count = per_row[asked[first:last]]
        row = np.repeat(asked[first:last], count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        word = base[bucket[row]] + offset
        masks = close_lanes(fps[row], planes, word, radius) & valid[word]
        hit = np.flatnonzero(masks)
        bits = np.unpackbits(masks[hit].astype("<u8").view(np.uint8), bitorder="little").reshape(len(hit), 64)
        which, lane = np.nonzero(bits)
        i = row[hit][which]
        j = i - place[i] + offset[hit][which] * 64 + lane
        yield i[i != j], j[i != j]
        first = last


def _link_all(starts, ends, fps, radius):
    """Edges (a, b) of a spanning forest for each bucket ``fps[start:end]``."""
    import numpy as np

    out = []
    sizes = ends - starts
    planes, valid, bucket, place, base, per_row = _lanes(sizes, fps)
    row_end = np.cumsum(per_row)
    labels = np.arange(len(fps))
    first = 0
    while first < len(fps):
        last = max(first + 1, int(np.searchsorted(row_end, (row_end[first - 1] if first else 0) + CHUNK, "right")))
        count = per_row[first:last]
        row = np.repeat(np.arange(first, last), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        word = base[bucket[row]] + offset
        masks = close_lanes(fps[row], planes, word, radius) & valid[word]
        own = base[bucket[row]] * 64 + place[row]
        mine = own // 64 == word
        masks[mine] &= ~(np.uint64(1) << (own[mine] % 64).astype(np.uint64))
        hit = np.flatnonzero(masks)
        for r in np.unique(row[hit]):
            at = hit[np.searchsorted(row[hit], r) : np.searchsorted(row[hit], r, "right")]
            bits = np.unpackbits(masks[at].astype("<u8").view(np.uint8), bitorder="little").reshape(len(at), 64)
            which, lane = np.nonzero(bits)
            b = bucket[r]
            lo = r - place[r]
            members = lo + offset[at][which] * 64 + lane
            found = labels[members]
            if (found == labels[r]).all():
                continue
            group = slice(lo, lo + sizes[b])
            for label, where in zip(*np.unique(found, return_index=True), strict=True):
                if label != labels[r]:
                    out.append((fps[r], fps[members[where]]))
                    part = labels[group]
                    part[part == label] = labels[r]
        first = last
    return out


def _edges(buckets: DataFrame, radius: int) -> DataFrame:
    """a, b (fingerprints): links of each (tab, key, part) bucket, as a spanning forest."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def emit(ids, fps):
            cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ends = np.append(cut[1:], len(ids))
            many = ends - cut > 1
            if not many.any():
                return None
            keep = np.repeat(many, ends - cut)
            starts = np.cumsum((ends - cut)[many]) - (ends - cut)[many]
            pairs = _link_all(starts, starts + (ends - cut)[many], fps[keep], radius)
            if not pairs:
                return None
            a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*pairs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        hold_i, hold_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            hold_i, hold_f = np.concatenate([hold_i, ids]), np.concatenate([hold_f, fps])
            done = int(np.searchsorted(hold_i == hold_i[-1], True)) if len(hold_i) else 0
            if done:
                if (made := emit(hold_i[:done], hold_f[:done])) is not None:
                    yield made
                hold_i, hold_f = hold_i[done:], hold_f[done:]
        if len(hold_i) and (made := emit(hold_i, hold_f)) is not None:
            yield made

    placed = buckets.withColumn("bucket", F.xxhash64("tab", "key", "part"))
    return placed.repartition("bucket").sortWithinPartitions("bucket", "fp").select("bucket", "fp").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Spanning links (a < b) between distinct fingerprints ``fp`` within ``radius`` bits."""
    n = fps.count()
    rows = _buckets(fps, plan_blocks(n, radius), radius)
    sizes = rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes.filter("n > 1"), ["tab", "key"])
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), tiles.cast("long")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.least(j, F.col("mine")) * tiles + F.greatest(j, F.col("mine")))
    rows = rows.withColumn("mine", mine).select("tab", "key", "fp", F.explode(parts).alias("part"))
    found = _edges(rows, radius)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, root: the smallest node of each connected component, by alternating large-star and small-star steps.

    ``edges`` has columns a, b; nodes without edges are absent.  Each round is
    written to the shared folder, so lineage stays short.  Rounds grow with the
    logarithm of the nodes; the call fails where ``max_rounds`` don't suffice.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        joined = both.join(low, "a")
        if large:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = joined.select("b", "low").union(low.select("a", "low")).toDF("a", "b")
        return moved.filter("a <> b").distinct()

    current, seen = materialise(edges.select("a", "b"), "links"), None
    for _ in range(max_rounds):
        current = materialise(star(star(current, True), False), "stars")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError(f"the components have not settled after {max_rounds} rounds")


def near_duplicates(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most ``radius`` bits."""
    small_batches(df.sparkSession)
    prints = materialise(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialise(rooted.join(ids, "root").select("fp", "component_id", "copies"), "named")
    # Fingerprints of many copies would be hot keys of the join; there are at most n / COPIES of them, and at most MAX_HOT are broadcast.
    n = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    many = F.col("copies") >= max(COPIES, n // MAX_HOT)
    hot = named.filter(many).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = prints.join(F.broadcast(hot), "fp", "left")
    rest = marked.filter("hot is null").join(named.filter(~many).drop("copies"), "fp")
    return rest.select("doc_id", "fp", "component_id").union(marked.filter("hot").select("doc_id", "fp", "hot_id"))

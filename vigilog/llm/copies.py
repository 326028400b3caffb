"""SimHash near copies of a given shingle similarity.

Two texts are linked when the Jaccard similarity of their sets of word shingles
is at least ``similarity``.  A SimHash radius alone can't give this (at 0.8 two
64-bit fingerprints differ in about ten bits), so the lookup tables are keyed by
shingles here: in any common order of shingles two such sets share one of their
first ``size - ceil(similarity * size) + 1``.  The order puts the shingles that
are frequent in a sample of the texts last; the sample decides the cost only,
never which links are found.  Within a table's buckets the fingerprints are
compared by bit planes with carry-save counters (``simhash.close_pairs``), and
what lies within ``RADIUS`` bits is verified: first by the two prefixes, whose
common shingles and the remainder of the one that ends first bound what the sets
can share, then, for the pairs left, by the sets themselves.  Sets of
``EXACT_BELOW`` shingles or fewer skip the radius; for larger ones ``RADIUS`` is
five standard deviations away from what a link can have.

Equal sets are one class.  Buckets of more than ``SMALL`` classes are first
compared with one member for each range of sizes, and then only across the
components found so far: their rows (never their pairs) meet their sets in one
task, which returns a spanning forest of the links.  Buckets past ``TILE`` are
cut into pairs of tiles.  Long texts share many buckets, so buckets with a class
in common are taken as one where that has at most ``TILE`` classes; a set then
travels once, not once for each of its buckets.

Null and blank texts have the empty set and are copies of each other; texts of
fewer words than a shingle have one shingle, the text.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, small_side, texts
from .simhash import close_pairs, components

RADIUS, EXACT_BELOW = 24, 16
SMALL, TILE = 16, 8192
#: Texts read for the frequent shingles: one in SHARE, SAMPLE at least; so many shingles are held at most.
SHARE, SAMPLE, COMMON = 8, 20_000, 1 << 19
SIGNED = 1 << 64


def shingles(text: bytes, n: int):
    """Sorted distinct XXH64 (seed 42) of the text's word n-grams."""
    import numpy as np
    from xxhash import xxh64_intdigest as h64

    words = text.lower().split()
    if len(words) <= n:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(n))))
    return np.unique(np.array([h64(g, 42) for g in grams], np.uint64))


def fingerprint(held):
    """SimHash of a set of hashes."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for i in range(0, len(held), 1 << 16):
        ones += np.unpackbits(held[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(held)).view(">u8")[0]


def _frequent(df: DataFrame, shingle: int, row: str, text_col: str):
    """Frequent shingles by hash, their counts in the sample, and the share of the sample."""
    import numpy as np

    n = df.count()
    one_in = max(1, min(SHARE, n // SAMPLE))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shingles(t, shingle) for t in texts(batch, text_col)]
            keys, counts = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])

    sample = df.filter(F.pmod(F.xxhash64(row), F.lit(one_in)) == 0).select(text_col)
    counted = sample.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rows = counted.filter("c >= 4").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    keys, times = rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy()
    order = np.argsort(keys)
    return keys[order], times[order], one_in


def _prefixes(df: DataFrame, shingle: int, similarity: float, row: str, text_col: str, shared) -> DataFrame:
    """row, digest of the shingle set, its size and fingerprint, and its prefix (null where the task has given that of an equal set) with the frequency of its last shingle."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        keys, counts, _ = shared.value
        seen = set()
        for batch in batches:
            digests, sizes, prints, firsts, lasts = [], [], [], [], []
            for text in texts(batch, text_col):
                held = shingles(text, shingle)
                size = len(held)
                digest = xxh64_intdigest(held.tobytes(), 7)
                digests.append(digest)
                sizes.append(size)
                if digest in seen:
                    prints.append(0)
                    firsts.append(None)
                    lasts.append(0)
                    continue
                seen.add(digest)
                times = np.zeros(size, np.int64)
                if len(keys) and size:
                    at = np.minimum(np.searchsorted(keys, held), len(keys) - 1)
                    times = np.where(keys[at] == held, counts[at], 0)
                reach = size - ceil(similarity * size - 1e-9) + 1 if size else 0
                prints.append(fingerprint(held) if size else 0)
                order = np.lexsort((held, times))[:reach]
                firsts.append(held[order].view(np.int64))
                lasts.append(times[order[-1]] if size else 0)
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), long(digests), pa.array(sizes, pa.int32()), long(prints), pa.array(firsts, pa.list_(pa.int64())), pa.array(lasts, pa.int64())], names=["_row", "digest", "size", "fp", "prefix", "last"])

    return df.select(F.col(row).alias("_row"), text_col).mapInArrow(run, "_row long, digest long, size int, fp long, prefix array<long>, last long")


def _groups(batches, columns: int):
    """Arrays of whole groups (equal first two columns) of sorted batches."""
    import numpy as np

    held = [np.zeros(0, np.int64) for _ in range(columns)]
    for batch in batches:
        held = [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k, x in enumerate(held)]
        if len(held[0]) and (done := int(np.argmax((held[0] == held[0][-1]) & (held[1] == held[1][-1])))):
            yield [x[:done] for x in held]
            held = [x[done:] for x in held]
    yield held


def _leaders(sizes, similarity: float):
    """Positions in ascending sizes: the first of each range that a similarity can span."""
    import numpy as np

    at = 0
    while at < len(sizes):
        yield at
        at = max(at + 1, int(np.searchsorted(sizes, sizes[at] / similarity + 1e-9, "right")))


def _buckets(batches, columns: int, parts: bool):
    """Batches of whole buckets of two or more classes (of two or more parts): counts and the columns without repeated classes.

    The columns begin with h, tile, size, digest, fp, part.
    """
    import numpy as np

    for held in _groups(batches, columns):
        if len(held[0]) < 2:
            continue
        other = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])
        fresh = np.concatenate([[True], other | (held[3][1:] != held[3][:-1])])
        held = [x[fresh] for x in held]
        cut = np.flatnonzero(np.concatenate([[True], (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]), [True]]))
        counts = np.diff(cut)
        wanted = counts > 1
        if parts:
            wanted = np.minimum.reduceat(held[5], cut[:-1]) != np.maximum.reduceat(held[5], cut[:-1])
        keep = np.repeat(wanted, counts)
        if keep.any():
            yield counts[wanted], [x[keep] for x in held]


def _close(counts, size, fp, part, asked, similarity: float):
    """Batches (i, j): rows of different parts within the radius, of sizes that the similarity allows."""
    import numpy as np

    tiny = size[asked] <= EXACT_BELOW
    for who, radius in ((asked[tiny], 64), (asked[~tiny], RADIUS)):
        for i, j in close_pairs(counts, fp.view(np.uint64), who, radius) if len(who) else ():
            near = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9) & (part[i] != part[j])
            if near.any():
                yield i[near], j[near]


def _first(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b (digests): all pairs of small buckets, those with the leaders of larger ones; the larger ones' members follow with b null and their h, size and fp."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def batch_of(a, b, *rest):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), k) if x is None else pa.array(x, k) for x, k in zip((a, b, *rest), kinds, strict=True)], names=["a", "b", "h", "size", "fp"])

        for counts, (h, _, size, digest, fp, part) in _buckets(batches, 6, False):
            ends = np.cumsum(counts)
            asked = np.ones(len(h), bool)
            for g in np.flatnonzero(counts > SMALL):
                s = slice(ends[g] - counts[g], ends[g])
                asked[s] = False
                asked[[s.start + k for k in _leaders(size[s], similarity)]] = True
                for k in range(s.start, s.stop, 1 << 16):
                    t = slice(k, min(k + (1 << 16), s.stop))
                    yield batch_of(digest[t], None, h[t], size[t], fp[t])
            for i, j in _close(counts, size, fp, part, np.flatnonzero(asked), similarity):
                pairs = np.unique(np.column_stack([np.minimum(digest[i], digest[j]), np.maximum(digest[i], digest[j])]), axis=0)
                yield batch_of(pairs[:, 0], pairs[:, 1], None, None, None)

    return _dealt(rows).mapInArrow(run, "a long, b long, h long, size int, fp long")


def _across(rows: DataFrame, similarity: float) -> DataFrame:
    """h, tile, digest, part of the rows within the radius of a row of another part in their bucket: rows, not pairs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for counts, (h, tile, size, digest, fp, part) in _buckets(batches, 6, True):
            found = np.zeros(len(h), bool)
            for i, j in _close(counts, size, fp, part, np.arange(len(h)), similarity):
                found[i] = found[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(h[found]), pa.array(tile[found], pa.int32()), pa.array(digest[found]), pa.array(part[found])], names=["h", "tile", "digest", "part"])

    return _dealt(rows).mapInArrow(run, "h long, tile int, digest long, part long")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("h", "tile").sortWithinPartitions("h", "tile", "size", "digest").select("h", "tile", "size", "digest", "fp", "part")


def _forest(similarity: float):
    """For a bucket of (digest, part, held): a, b of verified links that join different parts, no more than join them."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        digest = table["digest"].to_numpy()
        label = np.unique(table["part"].to_numpy(), return_inverse=True)[1]
        lists = table["held"].combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        values = lists.flatten().to_numpy()
        ends = np.cumsum(sizes)
        order = np.argsort(values, kind="stable")
        ordered, owner = values[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        low, high = np.searchsorted(ordered, values), np.searchsorted(ordered, values, "right")
        out = []
        for i in range(len(sizes)):
            if (label == label[i]).all():
                break
            s = slice(ends[i] - sizes[i], ends[i])
            n = high[s] - low[s]
            at = np.arange(n.sum()) + np.repeat(low[s] - np.cumsum(n) + n, n)
            both = np.bincount(owner[at], minlength=len(sizes))
            for j in np.flatnonzero((both >= similarity * (sizes[i] + sizes - both) - 1e-9) & (label != label[i])):
                if label[j] != label[i]:
                    out.append((digest[i], digest[j]))
                    label[label == label[j]] = label[i]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _tiled(rows: DataFrame, crossing: bool) -> DataFrame:
    """``rows`` with a tile: -1 but for groups past TILE, whose rows get their own tile or, ``crossing``, all pairs with it."""
    counts = rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).filter("tiles > 1")
    own = F.pmod(F.xxhash64("digest"), F.col("tiles").cast("long")).cast("int")
    some = rows.join(counts, "h", "left").withColumn("own", F.when(F.col("tiles").isNotNull(), own))
    if not crossing:
        return some.withColumn("tile", F.coalesce("own", F.lit(-1))).drop("tiles", "own")
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.least(j, F.col("own")) * F.col("tiles") + F.greatest(j, F.col("own")))
    return some.withColumn("tile", F.explode(F.when(F.col("own").isNotNull(), others).otherwise(F.array(F.lit(-1))))).drop("tiles", "own")


def _can_share(similarity: float):
    """Whether the sets of prefixes x and y (structs of size, prefix, last) can have the similarity.

    A common shingle up to the end of the prefix that ends first in the common
    order is in both prefixes; any other one is in the remainder of that set.
    """
    x, y = F.col("x"), F.col("y")

    def end(side):
        return F.struct(side["last"], F.element_at(side["prefix"], -1).bitwiseXOR(F.lit(-(1 << 63))))

    def rest(side):
        return side["size"] - F.size(side["prefix"])

    common = F.size(F.array_intersect(x["prefix"], y["prefix"])) + F.when(end(x) <= end(y), rest(x)).otherwise(rest(y))
    return common * (1 + similarity) >= similarity * (x["size"] + y["size"]) - 1e-6


def _merged(across: DataFrame) -> DataFrame:
    """``across`` with connected buckets as one (h: the connection's smallest digest, tile: -2) where that has at most TILE classes."""
    hubs = across.groupBy("h", "tile").agg(F.min("digest").alias("hub"))
    edges = across.join(hubs, ["h", "tile"]).select(F.col("digest").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
    roots = components(edges)
    rooted = across.join(roots, across.digest == roots.node, "left").select("h", "tile", "digest", "part", F.coalesce("root", "digest").alias("root"))
    sizes = rooted.groupBy("root").agg(F.count_distinct("digest").alias("n"))
    small = F.col("n") <= TILE
    h, tile = F.when(small, F.col("root")).otherwise(F.col("h")), F.when(small, F.lit(-2)).otherwise(F.col("tile"))
    return rooted.join(sizes, "root").select(h.alias("h"), tile.alias("tile"), "digest", "part").distinct()


def near_copies(df: DataFrame, row: str, shingle: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """_row, component (long): rows of equal component are linked by pairs of at least ``similarity``; ``row`` (long) is unique."""
    spark = df.sparkSession
    small_batches(spark)
    frequent = _frequent(df, shingle, row, text_col)
    shared = spark.sparkContext.broadcast(frequent)
    prints = materialise(_prefixes(df, shingle, similarity, row, text_col, shared), "prefixes")
    rows = prints.filter("prefix is not null").select(F.explode("prefix").alias("h"), "size", "digest", "fp", F.col("digest").alias("part"))
    keys, times, one_in = frequent
    tiled = None
    hot = [int(k) - SIGNED * (int(k) >= SIGNED // 2) for k in keys[times * one_in > TILE // 2]]
    if hot:
        # Only shingles in so many texts of the sample can have a group past TILE; there are at most COMMON of them.
        is_hot = F.broadcast(spark.createDataFrame([(h,) for h in hot], "h long"))
        tiled = materialise(_tiled(rows.join(is_hot, "h", "left_semi"), False), "tiled")
        rows = rows.join(is_hot, "h", "left_anti").withColumn("tile", F.lit(-1)).unionByName(tiled)
    else:
        rows = rows.withColumn("tile", F.lit(-1))
    first = materialise(_first(rows, similarity), "candidates")
    sample = materialise(prints.filter("prefix is not null").groupBy("digest").agg(F.min("_row").alias("_row")), "classes")

    def wanted(digests: DataFrame) -> DataFrame:
        """digest, _row: a row with a prefix for each of the given classes."""
        return small_side(materialise(digests.distinct().join(sample, "digest"), "wanted"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("digest")).union(pairs.select("b"))

    def sets_of(digests: DataFrame) -> DataFrame:
        """digest, held: the shingles of the given classes."""
        chosen = df.select(F.col(row).alias("_row"), F.col(text_col).alias("_text")).join(wanted(digests), "_row").select("digest", "_text")

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                held = [shingles(t, shingle).view(np.int64) for t in texts(batch, "_text")]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], names=["digest", "held"])

        return materialise(chosen.mapInArrow(run, "digest long, held array<long>"), "sets")

    pairs = materialise(first.filter("b is not null").select("a", "b").distinct(), "pairs")
    heads = prints.drop("digest").join(wanted(ends(pairs)), "_row").select("digest", F.struct("size", "prefix", "last").alias("head"))
    heads = materialise(heads, "heads")
    pairs = pairs.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").filter(_can_share(similarity)).select("a", "b")
    pairs = materialise(pairs, "pairs")
    sets = sets_of(ends(pairs))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    same = F.size(F.array_intersect("x", "y"))
    links = materialise(both.filter(same >= similarity * (F.size("x") + F.size("y") - same) - 1e-9).select("a", "b"), "links")
    roots = components(links)
    members = first.filter("b is null").select("h", "size", F.col("a").alias("digest"), "fp")
    if tiled is not None:
        # a tile may hold few classes of a large group, or one
        members = members.unionByName(tiled.filter("tile >= 0").select("h", "size", "digest", "fp"))
    parts = members.join(roots, members.digest == roots.node, "left").select("h", "size", "digest", "fp", F.coalesce("root", "digest").alias("part"))
    across = materialise(_across(_tiled(parts.distinct(), True), similarity), "across")
    if across.isEmpty():
        return prints.join(roots, prints.digest == roots.node, "left").select("_row", F.coalesce("root", "digest").alias("component"))
    across = materialise(_merged(across), "across")
    loaded = across.join(sets_of(across.select("digest")), "digest").select("h", "tile", "digest", "part", "held")
    more = materialise(loaded.groupBy("h", "tile").applyInArrow(_forest(similarity), "a long, b long").distinct(), "links")
    if not more.isEmpty():
        roots = components(links.union(more))
    return prints.join(roots, prints.digest == roots.node, "left").select("_row", F.coalesce("root", "digest").alias("component"))

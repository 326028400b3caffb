"""Nearest neighbours by largest inner product over balanced posting lists.

Vectors are dealt into at most ``BANDS`` bands of norm (so that a few long ones
don't stretch the rest), and within a band inner products become Euclidean
distances by one more coordinate.  Centroids are the leaf means of a balanced
tree (median splits) over a bounded sample; every vector is put on its nearest
list and, as a boundary vector, on each other list not farther than ``closure``
times that distance, the ``replicas`` nearest of them.  A query walks a neighbour
graph of the centroids in memory, keeps the lists within a ratio of the nearest
distance and compares itself with all vectors on them.  The ratio is fitted on
the sample: the smallest that finds ``recall`` of the sampled queries' own
neighbours.  Lists and their queries are cut into blocks, so no task holds an
unbounded list.

The sample's bound (SAMPLE vectors a band) bounds the lists at SAMPLE / 8; in a
larger table lists grow with it.

Equal vectors are one class before the search; a class needs only its ``k + 1``
smallest ids, which loses no result.  Vectors null, zero, or with null or
non-finite components, and those of another length than most, take no part; the
same id with several vectors keeps the smallest; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: The index is fitted on at most this many vectors a band.
SAMPLE = 65_536
BANDS = 8
#: Queries of the sample by which the ratio is fitted, and nodes the walk expands at least.
TRIAL, BEAM = 256, 32
LIST_SIZE = 256
BLOCK = 4096
QUERY_BLOCK = 16_384


@dataclass
class Centroids:
    points: object
    links: list
    entry: list[int]
    reach: float

    @classmethod
    def fit(cls, sample, reach: float, lists: int, degree: int = 24, seed: int = 7) -> Centroids:
        import numpy as np

        rng = np.random.default_rng(seed)
        x = augment(sample, reach)
        leaves = [np.arange(len(x))]
        while len(leaves) < lists and max(map(len, leaves)) > 1:
            parts = []
            for rows in leaves:
                if len(rows) < 2:
                    parts.append(rows)
                    continue
                a, b = x[rows[rng.integers(len(rows))]], x[rows[rng.integers(len(rows))]]
                for _ in range(4):
                    side = ((x[rows] - a) ** 2).sum(1) - ((x[rows] - b) ** 2).sum(1)
                    cut = np.argsort(side, kind="stable")
                    half = len(rows) // 2
                    a, b = x[rows[cut[:half]]].mean(0), x[rows[cut[half:]]].mean(0)
                parts += [rows[cut[:half]], rows[cut[half:]]]
            leaves = parts
        points = np.array([x[r].mean(0) for r in leaves])
        far = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2) if len(points) <= 256 else np.array([((points - p) ** 2).sum(1) for p in points])
        near = np.argsort(far, axis=1, kind="stable")[:, 1 : degree + 1]
        links = [set(map(int, n)) for n in near]
        for i, n in enumerate(near):
            for j in n:
                links[int(j)].add(i)
        entry = sorted({int(i) for i in np.linspace(0, len(points) - 1, min(8, len(points)))})
        return cls(points, [np.array(sorted(s), np.int64) for s in links], entry, reach)

    def search(self, q, ratio: float):
        """Lists within ``ratio`` of the nearest distance, best first over the graph: nodes a little past the ratio are expanded too."""
        import numpy as np

        seen = set(self.entry)
        far = ((self.points[self.entry] - q) ** 2).sum(1)
        heap = [(float(d), i) for d, i in zip(far, self.entry, strict=True)]
        heapq.heapify(heap)
        best = min(heap)[0]
        found = list(heap)
        slack, popped = ratio * ratio, 0
        while heap:
            d, i = heapq.heappop(heap)
            popped += 1
            if d > best * slack * 1.1 and popped > BEAM:
                break
            new = [j for j in self.links[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(((self.points[new] - q) ** 2).sum(1), new, strict=True):
                heapq.heappush(heap, (float(e), int(j)))
                found.append((float(e), int(j)))
                best = min(best, float(e))
        return np.array(sorted(int(j) for e, j in found if e <= best * slack), np.int32)

    def post(self, x, closure: float, replicas: int):
        """(row, list) of the lists that rows of ``x`` are put on."""
        import numpy as np

        far = np.maximum((x * x).sum(1)[:, None] + (self.points * self.points).sum(1)[None, :] - 2 * x @ self.points.T, 0)
        close = np.partition(far, min(replicas, far.shape[1]) - 1, axis=1)[:, min(replicas, far.shape[1]) - 1]
        return np.nonzero(far <= np.minimum(far.min(1) * closure * closure, close)[:, None] + 1e-12)

    def fitted_ratio(self, sample, k: int, recall: float, closure: float, replicas: int) -> float:
        """The smallest ratio by which sampled queries reach ``recall`` of their ``k`` nearest of the sample."""
        import numpy as np

        asked = sample[:TRIAL]
        rough = asked @ sample.T
        rough[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1.0
        top = np.argpartition(-rough, k - 1, axis=1)[:, :k].ravel()
        far = np.sqrt(np.maximum((asked * asked).sum(1)[:, None] + (self.points * self.points).sum(1)[None, :] - 2 * np.hstack([asked, np.zeros((len(asked), 1))]) @ self.points.T, 0))
        relative = far / np.maximum(far.min(1), 1e-12)[:, None]
        at, to = self.post(augment(sample[top], self.reach), closure, replicas)
        need = np.full(len(top), np.inf)
        np.minimum.at(need, at, relative[at // k, to])
        return float(max(1.0, np.sort(need)[int(np.ceil(recall * len(need))) - 1])) + 1e-9


def augment(x, reach: float):
    import numpy as np

    return np.hstack([x, np.sqrt(np.maximum(reach * reach - (x * x).sum(1), 0.0))[:, None]])


def _matrix(column):
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    # -0.0 equals 0.0
    return rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def bands(norms: dict[int, int]) -> dict[int, int]:
    """A group for each band: neighbouring bands merged, the smallest first, until BANDS are left."""
    groups = [[[b], n] for b, n in sorted(norms.items())]
    while len(groups) > BANDS:
        k = min(range(len(groups) - 1), key=lambda i: groups[i][1] + groups[i + 1][1])
        groups[k : k + 2] = [[groups[k][0] + groups[k + 1][0], groups[k][1] + groups[k + 1][1]]]
    return {b: g for g, (members, _) in enumerate(groups) for b in members}


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", closure: float = 1.01, replicas: int = 2, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score for every row where ``is_query`` (a Column over ``id``) holds.

    All vectors on the lists within the ratio are compared; there is no cap on candidates.
    """
    import numpy as np

    spark = df.sparkSession
    rows = valid(df, id_col, vector_col)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialise(rows.filter(F.size("v") == top.d).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
    fewest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    some = salted.groupBy("v", "salt").agg(fewest(F.collect_list("id")).alias("ids"))
    classes = some.groupBy("v").agg(fewest(F.flatten(F.collect_list("ids"))).alias("ids"))
    classes = materialise(classes.select(F.col("ids")[0].alias("cls"), "v", "ids").withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "classes")
    asked = rows.filter(is_query).join(classes.select("cls", "v"), "v").select("id", "cls")
    asked = materialise(asked, "asked")

    middle = classes.agg(F.percentile_approx("norm", 0.5)).first()[0]
    band = F.round(F.log2(F.col("norm") / middle)).cast("int")
    counted = classes.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("reach")).collect()  # a band for each power of two
    group_of = bands({r.band: r.n for r in counted})
    models, ratios, offsets = [], [], [0]
    for g in sorted(set(group_of.values())):
        own = [r for r in counted if group_of[r.band] == g]
        size = sum(r.n for r in own)
        drawn = classes.filter(band.isin([r.band for r in own])).orderBy(F.xxhash64("cls"), "cls").select("v").limit(SAMPLE).toArrow()
        sample = _matrix(drawn["v"].combine_chunks())
        lists = int(min(max(1, len(sample) // 8), 2 ** max(0, round(np.log2(max(1, size / LIST_SIZE))))))
        models.append(Centroids.fit(sample, max(r.reach for r in own), lists))
        ratios.append(models[-1].fitted_ratio(sample, k, recall, closure, replicas))
        offsets.append(offsets[-1] + len(models[-1].points))
    index = spark.sparkContext.broadcast((models, ratios, offsets))
    group = F.element_at(F.create_map(*[F.lit(x) for pair in group_of.items() for x in pair]), band).alias("grp")

    def post(batches):
        import pyarrow as pa

        models, _, offsets = index.value
        for b in batches:
            if not b.num_rows:
                continue
            x, grp, cls = _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False)
            for g in np.unique(grp):
                own = np.flatnonzero(grp == g)
                for s in range(0, len(own), 1024):
                    part = own[s : s + 1024]
                    at, to = models[g].post(augment(x[part], models[g].reach), closure, replicas)
                    yield pa.RecordBatch.from_arrays([pa.array(cls[part][at]), pa.array((to + offsets[g]).astype(np.int32))], names=["cls", "lst"])

    def walk(batches):
        import pyarrow as pa

        models, ratios, offsets = index.value
        for b in batches:
            v = _matrix(b.column(1))
            got = [np.concatenate([m.search(np.append(q, 0.0), r) + np.int32(o) for m, r, o in zip(models, ratios, offsets, strict=False)]) for q in v]
            at = np.repeat(np.arange(len(got)), [len(g) for g in got]) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy(zero_copy_only=False)[at]), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32))], names=["cls", "lst"])

    posted = materialise(classes.select("cls", "v", group).mapInArrow(post, "cls long, lst int"), "postings")
    wanted = asked.select("cls").distinct().join(classes.select("cls", "v"), "cls")
    walked = materialise(wanted.select("cls", "v").mapInArrow(walk, "cls long, lst int"), "probes")
    blocks = posted.groupBy("lst").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("pb"))
    probes = walked.groupBy("lst").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qb"))
    shape = F.broadcast(blocks.join(probes, "lst"))  # a row for each list
    part = lambda n: F.pmod(F.xxhash64("cls"), F.col(n).cast("long")).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = walked.join(shape, "lst").select("lst", "cls", part("qb").alias("q"), spread("pb").alias("p")).join(classes.select("cls", "v"), "cls")
    right = posted.join(shape, "lst").select("lst", "cls", part("pb").alias("p"), spread("qb").alias("q")).join(classes.select("cls", "v", "ids"), "cls")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)

    def compare(queries, vectors):
        import pyarrow as pa

        name = {"cls": pa.int64(), "found": pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())]))}
        if not queries.num_rows or not vectors.num_rows:
            return pa.table({n: pa.array([], t) for n, t in name.items()})
        q, p = _matrix(queries["v"].combine_chunks()), _matrix(vectors["v"].combine_chunks())
        ids = vectors["ids"].to_pylist()
        keep = min(len(p), k + 1)
        out = []
        for s in range(0, len(q), 1024):
            rough = q[s : s + 1024] @ p.T
            least = np.partition(rough, len(p) - keep, axis=1)[:, len(p) - keep]
            # all that rounding could put among the best, ties included
            close = rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
            for one, row in zip(q[s : s + 1024], close, strict=True):
                cols = np.flatnonzero(row)
                exact = (p[cols] * one).sum(1)
                found = sorted((-float(e), i) for e, c in zip(exact, cols, strict=True) for i in ids[c])[: k + 1]
                out.append([{"far": f, "vec_id": i} for f, i in found])
        return pa.table({"cls": queries["cls"].combine_chunks(), "found": pa.array(out, name["found"])})

    keys = ["lst", "p", "q"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "cls long, found array<struct<far:double,vec_id:long>>")
    # A vector found on several lists has the same distance on each, so its copies are neighbours once sorted.
    merged = near.groupBy("cls").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("all"))
    apart = F.filter("all", lambda x, i: (i == 0) | (x["vec_id"] != F.get("all", i - 1)["vec_id"]))
    merged = merged.select("cls", F.slice(apart, 1, k + 1).alias("found"))
    own = asked.join(merged, "cls").withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k))
    flat = own.select(F.col("id").alias("query_id"), F.posexplode("found").alias("pos", "hit"))
    return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))

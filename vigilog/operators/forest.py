"""Extended isolation forest whose every draw is a digest of (seed, tree, node).

Each tree is grown in a task of its own from about ``sample`` rows, which a digest
of their keys chooses, so the forest depends on the rows alone and on no
partitioning or random state, and SQL can repeat it.  A node picks the two features
of smallest digest among those that vary, draws two weights that are near normal and
a point of the node's box, and cuts through that point.  Rows go down the broadcast
trees in Arrow batches, all rows of a batch at once; joins with a table of nodes, a
level at a time, took twelve times as long.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Eight uniform numbers have this deviation, upside down.
UNIT = math.sqrt(12 / 8)


def mean_path(m: int) -> float:
    """The mean path of a failed search among ``m`` rows."""
    return 0.0 if m <= 1 else 2 * (math.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m


def _digest(*parts) -> str:
    return hashlib.md5("|".join(map(str, parts)).encode(), usedforsecurity=False).hexdigest()


def _uniform(*parts) -> float:
    return int(_digest(*parts)[:8], 16) / 2**32


def _normal(*parts) -> float:
    d = _digest(*parts)
    return (sum(int(d[4 * k : 4 * k + 4], 16) for k in range(8)) / 65536 - 4) * UNIT


def below(share: float, *parts: Column) -> Column:
    """Whether ``_uniform`` of columns is less than ``share`` (below 1), told from the digits alone."""
    return F.md5(F.concat_ws("|", *parts)) < F.lit(f"{math.ceil(share * 2**32):08x}" if share <= 1 - 2**-32 else "g")


#: Nodes are numbered from 1 within their tree, with the children 2n and 2n + 1.
NODE = "tree int, node long, size int, a int, b int, w1 double, w2 double, cut double, path double"


def _grower(seed: int, depth: int):
    def grow(pdf):
        import numpy as np
        import pandas as pd

        tree, x = int(pdf.tree.iloc[0]), np.stack(pdf.x.to_list()).astype(float)
        made, waiting = [], [(1, 0, np.arange(len(x)))]
        while waiting:
            node, level, rows = waiting.pop()
            part = x[rows]
            low, high = (part.min(0), part.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
            live = np.flatnonzero(high > low)
            if level >= depth or len(rows) <= 1 or not len(live):
                made.append((tree, node, len(rows), None, None, None, None, None, level + mean_path(len(rows))))
                continue
            picked = sorted(live, key=lambda f: _digest(seed, tree, node, "feature", f))[:2]
            a, b = int(picked[0]), int(picked[-1])
            w1, w2 = _normal(seed, tree, node, "weight", 0), _normal(seed, tree, node, "weight", 1) if len(picked) > 1 else 0.0
            point = [float(low[f]) + _uniform(seed, tree, node, "point", k) * float(high[f] - low[f]) for k, f in enumerate((a, b))]
            cut = w1 * point[0] + w2 * point[1]
            made.append((tree, node, len(rows), a, b, w1, w2, cut, None))
            right = part[:, a] * w1 + part[:, b] * w2 >= cut
            waiting += [(2 * node, level + 1, rows[~right]), (2 * node + 1, level + 1, rows[right])]
        return pd.DataFrame(made, columns=[c.split()[0] for c in NODE.split(", ")]).astype({"a": "Int32", "b": "Int32"})

    return grow


def forest_scores(df: DataFrame, columns: list[str], key: str, trees: int = 100, sample: int = 4096, seed: int = 7, out: str = "ml_score") -> DataFrame:
    """Add the anomaly score, 0 to 1, of an extended isolation forest over ``columns`` (null counts as 0); ``key`` names rows, and those of a null one are all alike."""
    from ..session import materialise

    rows = df.select(F.col(key).cast("string").alias("name"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"))
    held = df.count()
    # each row draws its trees by itself, however many rows there are: so each tree has its rows whatever the others have
    pool = rows.select("name", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    if held > sample:
        pool = pool.filter(below(sample / held, F.lit(seed), F.col("tree").cast("string"), F.col("name")))
    depth = math.ceil(math.log2(max(2, min(sample, held))))
    # a number of its own, or so little data would go to few tasks
    grown = materialise(pool.repartition(trees, "tree").groupBy("tree").applyInPandas(_grower(seed, depth), NODE), "forest")
    shared = df.sparkSession.sparkContext.broadcast(_flat(grown.toPandas()))  # trees and sample bound its rows

    @F.pandas_udf("double")
    def score(*series):
        import numpy as np
        import pandas as pd

        x = np.column_stack([s.to_numpy(float) for s in series])
        total, usual = np.zeros(len(x)), []
        for size, a, b, w1, w2, cut, left, path in shared.value:
            usual.append(mean_path(size))
            at, going = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(going := going[left[at[going]] > 0]):
                k = at[going]
                right = x[going, a[k]] * w1[k] + x[going, b[k]] * w2[k] >= cut[k]
                at[going] = left[k] + right
            total += path[at]
        return pd.Series(np.clip(2.0 ** (-(total / max(1, len(usual))) / max(float(np.mean(usual)) if usual else 0.0, 1e-9)), 0, 1))

    return df.withColumn(out, score(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]))


def _flat(grown) -> list[tuple]:
    """For each tree its rows and arrays over its nodes: features, weights, cut, place of the left child (the right one is next; 0 for a leaf) and path."""
    import numpy as np

    out = []
    for _, tree in grown.sort_values(["tree", "node"]).groupby("tree"):
        ids = tree.node.to_numpy(np.int64)
        leaf = tree.cut.isna().to_numpy()
        whole = lambda c: np.where(leaf, 0, tree[c].astype("float64").fillna(0).to_numpy()).astype(np.int64)  # noqa: B023, E731
        left = np.where(leaf, 0, np.searchsorted(ids, 2 * ids))
        out.append((int(tree["size"].iloc[0]), whole("a"), whole("b"), *(tree[c].fillna(0).to_numpy(float) for c in ("w1", "w2", "cut")), left, tree.path.fillna(0).to_numpy(float)))
    return out

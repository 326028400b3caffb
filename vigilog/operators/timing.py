"""Burst windows, runs, cadence and the timestamp grid, exact in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Cadence measures of rows without a run of three.
SENTINEL = 999.0


def micros(col):
    return F.unix_micros(col.cast("timestamp"))


def burst_counts(df: DataFrame, contexts: list[str], ts: str, seconds: int, out: str = "burst") -> DataFrame:
    """Rows of the same contexts within half the window on either side, both ends included; 1 without a time.

    Counting is done over distinct times, and each time once more with its time
    chunk's neighbours, so a context with most of the rows spreads over its
    chunks instead of one window partition.
    """
    half = seconds * SECOND // 2
    at = df.filter(F.col(ts).isNotNull()).groupBy(*contexts, micros(F.col(ts)).alias("_us")).agg(F.count(F.lit(1)).alias("_n"))
    width = half * 64
    home = F.floor(F.col("_us") / width).cast("long")
    near = F.array_distinct(F.array(home, F.floor((F.col("_us") - half) / width).cast("long"), F.floor((F.col("_us") + half) / width).cast("long")))
    spread = at.withColumn("_chunk", F.explode(near))
    frame = Window.partitionBy(*contexts, "_chunk").orderBy("_us").rangeBetween(-half, half)
    counted = spread.withColumn(out, F.sum("_n").over(frame)).filter(F.col("_chunk") == home)
    counted = counted.select(*[F.col(c).alias(f"_{c}") for c in contexts], "_us", out)
    same = micros(F.col(ts)) == F.col("_us")
    for c in contexts:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(counted, same, "left").drop("_us", *[f"_{c}" for c in contexts]).withColumn(out, F.coalesce(out, F.lit(1).cast("long")))


def runs(df: DataFrame, contexts: list[str], ts: str, key: str, seconds: int) -> DataFrame:
    """Timed rows with run number, run size, and the run's gap deviation and its ratio to the mean gap (run of 3 at least, else the sentinel).

    A context is read in time chunks; the last time and the number of runs before
    a chunk come from a small table, so a context with most rows is no single task.
    """
    width = seconds * SECOND * 4096
    timed = df.filter(F.col(ts).isNotNull()).withColumn("_us", micros(F.col(ts))).withColumn("_ctx", F.struct(*contexts) if contexts else F.struct(F.lit(1).alias("all")))
    timed = timed.withColumn("_chunk", F.floor(F.col("_us") / width))
    chunks = Window.partitionBy("_ctx").orderBy("_chunk")
    ends = timed.groupBy("_ctx", "_chunk").agg(F.max("_us").alias("_last"))
    ends = ends.select("_ctx", "_chunk", F.lag("_last").over(chunks).alias("_prior"))
    order = Window.partitionBy("_ctx", "_chunk").orderBy("_us", key)
    timed = timed.join(ends, ["_ctx", "_chunk"]).withColumn("_gap", (F.col("_us") - F.coalesce(F.lag("_us").over(order), F.col("_prior"))) / SECOND)
    timed = timed.withColumn("_new", F.coalesce((F.col("_gap") > seconds).cast("long"), F.lit(0))).withColumn("_own", F.sum("_new").over(order))
    past = F.sum("_k").over(chunks.rowsBetween(Window.unboundedPreceding, -1))
    sums = timed.groupBy("_ctx", "_chunk").agg(F.sum("_new").alias("_k")).select("_ctx", "_chunk", F.coalesce(past, F.lit(0)).alias("_before"))
    timed = timed.join(sums, ["_ctx", "_chunk"]).withColumn("run", F.col("_own") + F.col("_before"))
    per = timed.withColumn("_inner", F.when(F.col("_gap") <= seconds, F.col("_gap"))).groupBy("_ctx", "run")
    stats = per.agg(F.count(F.lit(1)).alias("run_size"), F.avg("_inner").alias("_mean"), F.stddev_pop("_inner").alias("_std"))
    ok = (F.col("run_size") >= 3) & (F.col("_mean") > 0)
    stats = stats.withColumn("dt_std", F.when(ok, F.col("_std")).otherwise(SENTINEL)).withColumn("dt_cv", F.when(ok, F.col("_std") / F.col("_mean")).otherwise(SENTINEL))
    made = timed.drop("_gap", "_us", "_chunk", "_prior", "_new", "_own", "_before").join(stats.drop("_mean", "_std"), ["_ctx", "run"])
    return made.drop("_ctx")


#: Contexts of more rows are read in time chunks.
LARGE_CONTEXT = 1 << 16


def paced(df: DataFrame, context: Column | None, sizes: DataFrame | None, ts: str, key: str, seconds: int) -> DataFrame:
    """Add burst__n, run__n, dt_std, dt_cv and (with a context) context__n, the measures of ``burst_counts`` and ``runs``, by one shuffle of the rows.

    ``sizes`` (value, c) holds the rows of each context.  A context of up to
    LARGE_CONTEXT rows is one window partition.  A larger one is cut into time
    chunks, which also get the neighbours' rows within ``seconds`` of their ends;
    only the runs that reach over an end are put together from their pieces.
    """
    from ..session import materialise
    from .counts import BROADCAST_VALUES

    reach, half, width = seconds * SECOND, seconds * SECOND // 2, seconds * SECOND * 64
    us, chunk, place = F.col("_us"), F.col("_chunk"), F.col("_home")
    rows = df.withColumn("_us", micros(F.col(ts))).withColumn("_ctx", F.lit("") if context is None else context)
    large = None if context is None else sizes.filter(F.col("c") > LARGE_CONTEXT).select(F.col("value").alias("_ctx"), F.col("c").alias("_all"))
    chunked = large is None or not large.isEmpty()
    if chunked:
        rows = rows.withColumn("_all", F.lit(0)) if large is None else rows.join(F.broadcast(large), "_ctx", "left")
        # rows without a time are spread by their key, below all chunks
        home = F.when(us.isNull(), F.pmod(F.xxhash64(key), F.lit(4096)) - (1 << 62)).otherwise(F.floor(us / width))
        near = F.when(us.isNull(), F.array(place)).otherwise(F.array_distinct(F.array(place, F.floor((us - reach) / width), F.floor((us + reach) / width))))
        rows = rows.withColumn("_home", F.when(F.col("_all").isNotNull(), home).otherwise(F.lit(0).cast("long")))
        rows = rows.withColumn("_chunk", F.explode(F.when(F.col("_all").isNotNull(), near).otherwise(F.array(place))))
        here, group = chunk == place, Window.partitionBy("_ctx", "_chunk")
    else:
        here, group = F.lit(True), Window.partitionBy("_ctx")
    order = group.orderBy("_us")
    till = lambda end: F.count("_us").over(order.rangeBetween(Window.unboundedPreceding, end))
    rows = rows.withColumns({"_gap": (us - F.lag("_us").over(order)) / SECOND, "burst__n": till(half) - till(-half - 1)})
    rows = rows.withColumn("_piece", F.sum(F.coalesce((F.col("_gap") > seconds).cast("long"), F.lit(0))).over(order))
    if context is not None:
        rows = rows.withColumn("context__n", F.coalesce("_all", F.count(F.lit(1)).over(group)) if chunked else F.count(F.lit(1)).over(group))
    piece = Window.partitionBy("_ctx", *(["_chunk"] if chunked else []), "_piece")
    inner = F.when(here & (F.col("_gap") <= seconds), F.col("_gap"))
    rows = rows.withColumns({"run__n": F.count(F.when(here, us)).over(piece), "_k": F.count(inner).over(piece), "_mean": F.avg(inner).over(piece), "_std": F.stddev_pop(inner).over(piece)})
    if chunked:
        rows = rows.withColumns({"_back": F.max(us.isNotNull() & (place < chunk)).over(piece), "_on": F.max(us.isNotNull() & (place > chunk)).over(piece)})
        rows = materialise(rows.filter(here), "paced")
        at = ["_ctx", "_chunk", "_piece"]
        parts = rows.filter("_us IS NOT NULL AND (_back OR _on)").groupBy(*at).agg(*[F.first(c).alias(c) for c in ("run__n", "_k", "_mean", "_std", "_back")])
        parts = parts.withColumn("_run", F.sum((~F.col("_back")).cast("long")).over(Window.partitionBy("_ctx").orderBy("_chunk", "_piece")))
        whole = Window.partitionBy("_ctx", "_run")
        parts = parts.withColumns({"_size": F.sum("run__n").over(whole), "_gaps": F.sum("_k").over(whole), "_middle": F.sum(F.col("_k") * F.coalesce("_mean", F.lit(0.0))).over(whole) / F.sum("_k").over(whole)})
        away = F.col("_mean") - F.col("_middle")
        parts = parts.withColumn("_spread", F.sqrt(F.sum(F.col("_k") * (F.col("_std") * F.col("_std") + away * away)).over(whole) / F.col("_gaps")))
        parts = materialise(parts.select(*at, "_size", "_middle", "_spread"), "pieces")
        rows = rows.join(F.broadcast(parts) if parts.count() <= BROADCAST_VALUES else parts, at, "left")
        rows = rows.withColumns({"run__n": F.coalesce("_size", "run__n"), "_mean": F.coalesce("_middle", "_mean"), "_std": F.coalesce("_spread", "_std")})
    timed = us.isNotNull()
    ok = timed & (F.col("run__n") >= 3) & (F.col("_mean") > 0)
    alone = F.lit(1).cast("long")
    rows = rows.withColumns({
        "burst__n": F.when(timed, F.col("burst__n")).otherwise(alone), "dt_std": F.when(ok, F.col("_std")).otherwise(SENTINEL),
        "dt_cv": F.when(ok, F.col("_std") / F.col("_mean")).otherwise(SENTINEL), "run__n": F.when(timed, F.col("run__n")).otherwise(alone),
    })
    return rows.select(*df.columns, "burst__n", "run__n", "dt_std", "dt_cv", *(["context__n"] if context is not None else []))


def gaps(df: DataFrame, ts: str) -> DataFrame:
    """gap (microseconds), n: positive gaps between consecutive distinct times.

    Times are cut into day chunks; only the chunks' last times meet in one window.
    """
    times = df.filter(F.col(ts).isNotNull()).select(micros(F.col(ts)).alias("us")).distinct().withColumn("day", F.floor(F.col("us") / (86_400 * SECOND)))
    lagged = times.withColumn("prior", F.lag("us").over(Window.partitionBy("day").orderBy("us")))
    ends = times.groupBy("day").agg(F.max("us").alias("last"))
    ends = ends.withColumn("bound", F.lag("last").over(Window.orderBy("day"))).select("day", "bound")  # a row for each day of the log
    full = lagged.join(ends, "day").withColumn("gap", F.col("us") - F.coalesce("prior", "bound"))
    return full.filter("gap > 0").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def grid(df: DataFrame, ts: str) -> DataFrame:
    """One row (none if there is no gap): the most frequent gap, the smallest on ties."""
    return gaps(df, ts).orderBy(F.desc("n"), "gap").limit(1).select("gap", "n")


def on_grid(df: DataFrame, ts: str, tolerance_us: int = 1000) -> DataFrame:
    """Add ``on_grid``: within the tolerance of the grid's most frequent remainder over distinct times."""
    step = grid(df, ts).select(F.col("gap").alias("_gap"))
    times = df.filter(F.col(ts).isNotNull()).select(micros(F.col(ts)).alias("us")).distinct()
    phase = times.crossJoin(F.broadcast(step)).groupBy("_gap", F.pmod("us", "_gap").alias("_phase")).count().orderBy(F.desc("count"), "_phase").limit(1).drop("count")
    away = F.pmod(micros(F.col(ts)) - F.col("_phase"), F.col("_gap"))
    near = F.least(away, F.col("_gap") - away) <= tolerance_us
    return df.join(F.broadcast(phase), F.lit(True), "left").withColumn("on_grid", F.coalesce(near, F.lit(False))).drop("_gap", "_phase")

"""Batch detection over an event log: features, rules, anomaly score, decision and evidence tiers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import counts, entities, forest, robust, rules, timing
from ..session import materialise

# Floors of the adaptive cuts and limits of the rules.
FLOORS = {"text": 10, "categorical": 50, "numeric": 10, "context": 50, "time": 4}
LOCAL_BURST, MIN_DISTINCT, MIN_RUN, MAX_CV, MAX_ENTROPY, MIN_LENGTH = 5, 20, 8, 0.50, 1.5, 5
MIN_VOLUME, MAX_DIVERSITY, LOW_SHARE, MIN_HUB, ASYMMETRY, DEGREE_SHARE = 12, 0.20, 0.10, 3, 10, 0.99


@dataclass(frozen=True)
class Log:
    """Roles of a table's columns, in the table's order; ``key`` orders and names its rows."""

    key: str
    timestamp: str | None = None
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    #: Columns of sparse parameters.
    maps: list[str] = field(default_factory=list)
    #: Columns that hold content, and columns that are entities by decree.
    content: tuple[str, ...] = ()
    entity: tuple[str, ...] = ()
    #: Names to show instead of the columns' own.
    names: dict[str, str] = field(default_factory=dict)

    def shown(self, name: str) -> str:
        """A column's or a feature's name as it is shown."""
        column = next((c for c in self.names if name == c or name.startswith(f"{c}__")), None)
        return name if column is None else self.names[column] + name[len(column):]

    @classmethod
    def of(cls, schema, key: str) -> Log:
        """The roles of an inferred schema; URL-derived and overridden columns are content."""
        named = lambda role: [c.name for c in schema.with_role(role)]
        content = tuple(c.name for c in schema.columns if c.role == "url" or c.derived_from or c.content)
        return cls(key, schema.primary_timestamp, named("categorical"), named("numeric"), named("text"), named("boolean"), named("map"), content, tuple(c.name for c in schema.columns if c.entity))


@dataclass
class Features:
    """The row-wise table (key, columns, context and matrix), the matrix's names and families in order, and the scalars."""

    frame: DataFrame
    families: dict[str, str]
    shapes: dict[str, dict]
    cuts: dict[str, float]
    entity: list[str]
    actor: list[str]
    grid: int | None
    gated: bool


@dataclass
class Detection:
    """The scored rows, the thresholds used, and what the outputs need."""

    frame: DataFrame
    log: Log
    features: Features
    thresholds: dict
    threshold: float
    method: str
    backend: str
    cutoff: float


def features(df: DataFrame, log: Log, burst_seconds: int = 10) -> Features:
    """Counts, timing, entity and actor measures of every row.

    The table is written once and read a fixed number of times, whatever its
    columns: all values are counted by one aggregation and looked up by one join,
    all numeric columns are sorted and binned together.
    """
    named = [*log.categorical, *log.numeric, *log.text]
    keep = list(dict.fromkeys([log.key, *([log.timestamp] if log.timestamp else []), *named, *log.boolean, *log.maps]))
    clean = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.when(F.col(c) == 0, F.abs(c)).otherwise(F.col(c))).alias(c) for c in log.numeric if df.schema[c].dataType.typeName() in ("double", "float")}
    base = materialise(df.select(*[clean.get(c, F.col(c)) for c in keep]), "base")
    families: dict[str, str] = {}
    matrix: dict[str, Column] = {}

    def emit(name: str, family: str, col: Column):
        families[name], matrix[name] = family, col

    # what is counted: the columns, the context of all categorical ones, the instant
    counted = {c: F.col(c) for c in named}
    if len(log.categorical) >= 2:
        counted["__context"] = counts.joint(log.categorical)
    if log.timestamp:
        counted["__time"] = timing.micros(F.col(log.timestamp))
    place = {c: i for i, c in enumerate(counted)}
    stored = counts.store(base, counted) if counted else None
    by_name = counts.as_column_counts(stored, list(counted)) if counted else None
    shapes = entities.column_shapes(by_name.filter(F.col("column").isin(named))) if named else {}
    cut = {r["column"]: float(r["cut"]) for r in counts.cuts(by_name).collect()} if counted else {}

    entity = entities.entity_columns(shapes, log.categorical, log.content, log.entity)
    order = {c: i for i, c in enumerate(df.columns)}
    actor = entities.actor_columns(shapes, sorted([*log.categorical, *log.text], key=order.get), log.content, log.entity)
    actor = actor if len(actor) >= 2 else []
    bins, medians = entities.all_bins(base, log.numeric, log.key) if log.numeric else (F.array().cast("array<int>"), {})

    # the measures of a value: its count, and for entities and actors theirs
    wanted = {f"{c}__n": (place[c], "c") for c in counted}
    found = stored
    links = base.select(*[counts.short(F.col(c)).alias(c) for c in dict.fromkeys([*log.categorical, *actor])], bins.alias(entities.BINS))
    n_bins = len(log.numeric)
    if actor or len(entity) > 1:
        links = materialise(links, "links")  # else it is read once
    measured: list[DataFrame] = []
    if entity:
        per = entities.entity_table(links, entity, log.categorical, n_bins)
        measured.append(per.withColumnRenamed("volume", "entity_volume"))
        wanted |= {f"{c}__{name}": (place[c], m) for c in entity for name, m in (("diversity", "diversity"), ("volume", "entity_volume"), ("degree", "degree"))}
    if actor:
        graph = materialise(entities.actor_graph(links, actor, [c for c in log.categorical if c not in actor], n_bins), "actors")
        measured.append(graph.withColumnsRenamed({"degree": "out", "reverse_degree": "back", "volume": "events", "diversity": "spread"}))
        wanted |= {f"{c}__{m}": (place[c], m) for c in actor for m in ("out", "back", "events", "spread")}
        hubs = counts.quantiles(graph.filter(F.col("degree") >= MIN_HUB).select("degree"), ["degree"], [DEGREE_SHARE])
        if hubs:
            cut["__degree"] = hubs["degree", DEGREE_SHARE]
    for more in measured:
        found = found.join(counts.coded(more, place), ["code", "value"], "left")
    rows = base
    if log.timestamp:
        context = counts.joint(log.categorical) if log.categorical else None
        sizes = base.select(context.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("c")) if len(log.categorical) == 1 else stored.filter(F.col("code") == 2 * place["__context"]) if context is not None else None
        rows = timing.paced(base, context, sizes, log.timestamp, log.key, burst_seconds)
    if counted:
        # values of one row and nothing else to tell aren't looked up: their count is known
        special = F.floor(F.col("code") / 2).isin([place[c] for c in {*entity, *actor}])
        asked = {c: v for c, v in counted.items() if c != "__context" or not log.timestamp}
        wanted = {name: w for name, w in wanted.items() if name != "__context__n" or not log.timestamp}
        values = materialise(found.filter(((F.col("c") > 1) | special) & F.floor(F.col("code") / 2).isin([place[c] for c in asked])), "values")
        if len(asked) <= counts.NARROW:
            rows = counts.attach(rows, log.key, asked, place, values, wanted)
        else:
            rows = rows.join(counts.look_up(base, log.key, counted, values, wanted), log.key, "left")
        shown = {"__context": "context__n", "__time": "same_time__n"}
        held = {"__context": "true", "__time": f"`{log.timestamp}` IS NOT NULL"}
        alone = [f"CAST(CASE WHEN {held.get(c, f'`{c}` IS NOT NULL')} THEN coalesce(`{c}__n`, 1) ELSE 0 END AS BIGINT) AS `{shown.get(c, f'{c}__n')}`" for c in asked]
        rows = rows.selectExpr(*[f"`{c}`" for c in rows.columns if c not in {f"{c}__n" for c in asked}], *alone)

    for c in log.categorical:
        emit(f"{c}__conc", "concentration", F.log1p(f"{c}__n"))
    if len(log.categorical) >= 2:
        emit("context__conc", "concentration", F.log1p("context__n"))
    for c in log.numeric:
        emit(f"{c}__val", "value", F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c, 0.0))))
        emit(f"{c}__rep", "repetition", F.log1p(f"{c}__n"))
    for c in log.text:
        rows = rows.withColumn(f"{c}__chars", texts.characters(F.col(c)))
        emit(f"{c}__entropy", "text", F.col(f"{c}__chars")["entropy"])
        emit(f"{c}__uniqchar", "text", F.col(f"{c}__chars")["unique_ratio"])
        emit(f"{c}__rep", "repetition", F.log1p(f"{c}__n"))
    for c in log.boolean:
        emit(f"{c}__bool", "flag", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    for c in log.maps:
        rows = rows.join(counts.map_concentration(base, log.key, c, f"{c}__common"), log.key, "left")
        emit(f"{c}__keys", "value", F.coalesce(F.size(c), F.lit(0)).cast("double"))
        emit(f"{c}__conc", "concentration", F.coalesce(f"{c}__common", F.lit(0.0)))
    grid, gated = None, False
    if log.timestamp:
        ts = log.timestamp
        step = timing.grid(base, ts).first()
        grid = step.gap if step else None
        gated = grid is not None and grid >= burst_seconds * timing.SECOND
        if gated:
            rows = timing.on_grid(rows, ts)
        emit("hour", "time", F.coalesce(F.hour(F.col(ts).cast("timestamp")), F.lit(0)).cast("double"))
        emit("same_time__conc", "burst", F.log1p("same_time__n"))
        emit(f"burst{burst_seconds}s__conc", "burst", F.log1p("burst__n"))
    if entity:
        lowest, volume = F.lit(1.0), F.lit(1).cast("long")
        for c in entity:
            lower = F.round(F.col(f"{c}__diversity"), 12) < lowest
            lowest, volume = F.when(lower, F.round(F.col(f"{c}__diversity"), 12)).otherwise(lowest), F.when(lower, F.col(f"{c}__volume")).otherwise(volume)
        rows = rows.withColumn("entity__low", lowest).withColumn("entity__vol", volume)
    rows = materialise(rows, "rows")
    if log.timestamp:
        measured_run = F.col("dt_std") < timing.SENTINEL
        middle = counts.quantiles(rows.filter(measured_run), ["dt_std", "dt_cv"], [0.5])
        emit("has_regular_timing", "timing", measured_run.cast("double"))
        for c, name in (("dt_std", "dt__std"), ("dt_cv", "dt__cv")):
            emit(name, "timing", F.log1p(F.when(measured_run, F.col(c)).otherwise(F.lit(middle.get((c, 0.5), 0.0)))))
    if entity:
        emit("entity__diversity", "entity", F.col("entity__low"))
        busy = counts.quantiles(rows.filter(F.col("entity__vol") >= MIN_VOLUME), ["entity__low"], [LOW_SHARE])
        cut["__entity"] = min(MAX_DIVERSITY, busy.get(("entity__low", LOW_SHARE), 0.0))
    rows = rows.select("*", *[col.cast("double").alias(f"x__{name}") for name, col in matrix.items()])
    return Features(rows, families, shapes, cut, entity, actor, grid, gated)


def apply_rules(made: Features, log: Log) -> tuple[DataFrame, dict]:
    """Add ``hits`` and ``heuristic``; and the thresholds applied."""
    found = []
    n = lambda c: F.col(f"{c}__n")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    two = lambda c: F.format_number(c, 2)
    limit = lambda c, kind: max(float(FLOORS[kind]), made.cuts.get(c, 0.0))
    eligible = lambda cs: [c for c in cs if made.shapes[c]["distinct"] >= MIN_DISTINCT]
    used = {
        "text_repeat": {c: limit(c, "text") for c in log.text},
        "categorical_concentration": {c: limit(c, "categorical") for c in eligible(log.categorical)},
        "numeric_reuse": {c: limit(c, "numeric") for c in eligible(log.numeric)},
        "context_cluster": limit("__context", "context"), "same_instant": limit("__time", "time"), "local_burst": LOCAL_BURST,
        "timestamp_grid": made.grid / timing.SECOND if made.grid else None, "dense_timing_gated": made.gated,
        "entity_diversity_cut": made.cuts.get("__entity", 0.0), "entity_columns": made.entity, "entity_graph_active": len(made.entity) >= 2,
        "actor_columns": made.actor, "actor_graph_active": bool(made.actor), "degree_floor": made.cuts.get("__degree"),
    }
    for c in log.text:
        found.append(rules.rule("repeat_value", (n(c) > 1) & (n(c) >= used["text_repeat"][c]), text(f"{log.shown(c)} value occurs ", n(c), " times")))
        entropy = F.col(f"x__{c}__entropy")
        found.append(rules.rule("low_entropy", (entropy > 0) & (entropy <= MAX_ENTROPY) & (F.char_length(c) >= MIN_LENGTH), text(f"{log.shown(c)} has an entropy of ", two(entropy), " bits")))
    for c, at in used["categorical_concentration"].items():
        found.append(rules.rule("concentration", n(c) >= at, text(f"{log.shown(c)} value holds ", n(c), " rows")))
    for c, at in used["numeric_reuse"].items():
        found.append(rules.rule("numeric_reuse", (n(c) > 1) & (n(c) >= at), text(f"{log.shown(c)} number occurs ", n(c), " times")))
    if len(log.categorical) >= 2:
        found.append(rules.rule("context_cluster", n("context") >= used["context_cluster"], text("context holds ", n("context"), " rows")))
    if log.timestamp:
        off = ~F.col("on_grid") if made.gated else F.lit(True)
        found.append(rules.rule("same_instant_burst", (n("same_time") >= used["same_instant"]) & off, text(n("same_time"), " rows at the same instant")))
        found.append(rules.rule("local_burst", (n("burst") >= LOCAL_BURST) & off, text(n("burst"), " rows of the context close in time")))
        found.append(rules.rule("regular_timing", (n("run") >= MIN_RUN) & (F.col("dt_cv") <= MAX_CV), text("run of ", n("run"), " rows at a regular pace (cv ", two(F.col("dt_cv")), ")")))
    cut = F.lit(used["entity_diversity_cut"])
    busy = lambda c: (F.col(f"{c}__volume") >= MIN_VOLUME) & (F.round(F.col(f"{c}__diversity"), 12) <= cut)
    low = (F.col("entity__vol") >= MIN_VOLUME) & (F.col("entity__low") <= cut)
    used["entity_fallback_hub_gated"] = len(made.entity) == 1 and made.entity[0] in made.actor
    used["min_hub_degree"] = MIN_HUB if used["entity_graph_active"] or used["entity_fallback_hub_gated"] else None
    if used["entity_graph_active"]:
        hubs = [F.when(busy(c) & (F.col(f"{c}__degree") >= MIN_HUB), F.struct(F.col(f"{c}__degree").alias("degree"), F.lit(-i).alias("place"), text(f"{log.shown(c)} '", F.coalesce(c, F.lit("")), "' repeats itself (diversity ", two(F.col(f"{c}__diversity")), " over ", F.col(f"{c}__volume"), " rows) with ", F.col(f"{c}__degree"), " counterparts").alias("reason"))) for i, c in enumerate(made.entity)]
        hub = F.array_max(F.filter(F.array(*hubs), lambda x: x.isNotNull()))
        found.append(rules.rule("entity_monotony", hub.isNotNull(), hub["reason"]))
    elif used["entity_fallback_hub_gated"]:
        c = made.entity[0]
        found.append(rules.rule("entity_monotony", low & (F.col(f"{c}__out") >= MIN_HUB), text("entity repeats itself (diversity ", two(F.col("entity__low")), " over ", F.col("entity__vol"), " rows) with ", F.col(f"{c}__out"), " counterparts")))
    elif made.entity:
        found.append(rules.rule("entity_monotony", low, text("entity repeats itself (diversity ", two(F.col("entity__low")), " over ", F.col("entity__vol"), " rows)")))
    if made.actor and used["degree_floor"] is not None:
        c = made.actor[0]
        star = (F.col(f"{c}__events") >= MIN_VOLUME) & (F.col(f"{c}__out") >= used["degree_floor"]) & (F.col(f"{c}__out") >= ASYMMETRY * (F.col(f"{c}__back") + 1)) & (F.round(F.col(f"{c}__spread"), 12) <= MAX_DIVERSITY)
        found.append(rules.rule("asymmetric_degree", star, text(f"{log.shown(c)} '", F.coalesce(c, F.lit("")), "' reaches ", F.col(f"{c}__out"), " counterparts, ", F.col(f"{c}__back"), " reach it")))
    return made.frame.withColumn("hits", rules.hits(found)).withColumn("heuristic", rules.score(found)), used


def shown_thresholds(found: Detection) -> dict:
    """The thresholds with the columns' shown names."""
    shown = found.log.shown
    turned = lambda v: {shown(k): x for k, x in v.items()} if isinstance(v, dict) else [shown(x) for x in v] if isinstance(v, list) else v
    return {k: turned(v) for k, v in found.thresholds.items()}


def ml_scores(df: DataFrame, columns: list[str], key: str, backend: str) -> tuple[DataFrame, str]:
    """Add ``ml_score``: 0.5 for fewer than three rows or no column, else the forest's or the deviation's score."""
    if not columns or df.limit(3).count() < 3:
        return df.withColumn("ml_score", F.lit(0.5)), "degenerate"
    if backend == "deviation":
        return robust.deviation_score(df, columns), backend
    return forest.forest_scores(df, columns, key), backend


def detect(df: DataFrame, log: Log, burst_seconds: int = 10, backend: str = "forest", cutoff: float = 0.70, max_ml_rate: float = 0.02) -> Detection:
    """The whole detection; ``backend`` is ``forest`` or ``deviation`` (robust z, expressible in SQL)."""
    made = features(df, log, burst_seconds)
    ruled, used = apply_rules(made, log)
    scored, backend = ml_scores(ruled, [f"x__{c}" for c in made.families], log.key, backend)
    scored = scored.withColumn("ml_score", F.round("ml_score", 9))
    # scores of expressions alone are computed again where they are read, which is less than to write all rows; the forest's are written
    scored = scored if backend == "deviation" else materialise(scored, "scored")
    ranked = materialise(scored.select(log.key, "ml_score"), "scores") if backend == "deviation" else scored
    threshold, method = robust.knee_threshold(ranked, "ml_score", log.key)
    cap = counts.quantiles(ranked, ["ml_score"], [1 - max_ml_rate]).get(("ml_score", 1 - max_ml_rate))
    if cap is not None and cap > threshold:
        threshold, method = cap, f"{method}+rate_capped"
    by_rule, by_ml = F.col("heuristic") >= cutoff, F.col("ml_score") > threshold
    tier = F.when(by_rule & by_ml, 1).when(by_rule, 2).when(by_ml, 3).otherwise(0)
    decided = scored.withColumn("threshold", F.lit(threshold)).withColumn("is_bot", by_rule | by_ml).withColumn("tier", tier).withColumn("combined", F.greatest("heuristic", "ml_score"))
    return Detection(decided, log, made, used, threshold, method, backend, cutoff)


def summary(found: Detection) -> DataFrame:
    """One row of counters."""
    flag = F.col("is_bot").cast("long")
    tiers = [F.coalesce(F.sum((F.col("tier") == t).cast("long")), F.lit(0)).alias(f"tier_{t}") for t in range(4)]
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return found.frame.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(flag), F.lit(0)).alias("n_flagged"), rate(flag).alias("rate"),
        rate(F.col("heuristic") >= found.cutoff).alias("heuristic_rate"), rate(F.col("ml_score") > F.col("threshold")).alias("ml_rate"), *tiers,
    )


def top_reasons(found: Detection, n: int = 10) -> DataFrame:
    """The reasons given most among flagged rows."""
    # written first: Spark may put a filter on the size of ``hits``, and so its whole expression, before the explode once more
    fired = materialise(found.frame.filter("is_bot").select("hits"), "hits").select(F.explode("hits").alias("h")).groupBy(F.col("h.rule_id").alias("rule_id"), F.col("h.reason").alias("reason"))
    return fired.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id", "reason").limit(n)


def selected(found: Detection, n: int = 500, reasons: int = 6) -> DataFrame:
    """The flagged rows of highest combined score, each with its first reasons."""
    key = found.log.key
    top = found.frame.filter("is_bot").orderBy(F.desc("combined"), key).limit(n)
    return top.withColumn("reasons", F.slice(F.transform("hits", lambda h: h["reason"]), 1, reasons))


def deviations(found: Detection, rows: DataFrame, top_k: int = 5) -> DataFrame:
    """key, feature, value, z, place, percentile: the largest deviations of ``rows`` (a table with the key)."""
    key, names = found.log.key, list(found.features.families)
    frame = found.frame.select(key, *[F.col(f"x__{c}").alias(c) for c in names])
    wanted = rows.select(key).distinct().withColumn("_wanted", F.lit(True))
    made = robust.feature_deviations(frame.join(wanted, key, "left"), key, names, F.col("_wanted"), top_k)
    return robust.batch_percentiles(frame, made, names)

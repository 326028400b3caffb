"""From a log file to the detection's outputs."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from ..sources import ingest, sinks
from . import detect

#: Points of the sorted score curve that are drawn.
PLOTTED = 2000


def plain_names(columns: list[str]) -> dict[str, str]:
    """For each column a name without signs that Spark reads as syntax, its own where it has none."""
    out, taken = {}, set(columns)
    for k, c in enumerate(columns):
        name = c
        if set(c) & set(".`"):
            name = f"column{k}"
            while name in taken:
                name += "_"
            taken.add(name)
        out[c] = name
    return out


def run_pipeline(spark: SparkSession, path: str, output_dir: str, entity: tuple = (), content: tuple = (), timestamp: str | None = None, backend: str = "forest", single: bool = True, max_events: int = 500) -> dict:
    """Write predictions, the extended predictions, features, selected events and the summary; returns the summary.

    ``single`` writes each table as one file; without it the executors write folders.
    """
    key = "_rid"
    df, schema = ingest.load(spark, path, entity=entity, content=content, timestamp=timestamp, row_number=key)
    # names that Spark would read as paths into a struct are replaced inside, and shown as they are
    inside = plain_names(df.columns)
    shown = {v: k for k, v in inside.items() if v != k}
    renamed = lambda c: inside.get(c, c)
    schema_inside = replace(schema, columns=[replace(c, name=renamed(c.name)) for c in schema.columns], primary_timestamp=renamed(schema.primary_timestamp), row_id=renamed(schema.row_id))
    df = materialise(df.toDF(*map(renamed, df.columns)), "typed")
    log = replace(detect.Log.of(schema_inside, key), names=shown)
    found = detect.detect(df, log, backend=backend)
    id_name = schema.row_id or "row_id"
    if schema.row_id:
        name = F.col(schema_inside.row_id)
    else:
        # positions in the file: row numbers of a partition are consecutive, and partitions are in order
        parts = df.groupBy(F.shiftright(key, 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
        start = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = F.broadcast(parts.select("_part", start.alias("_start")))  # a row for each partition of the file
        name = F.concat(F.lit("row_"), (F.col("_start") + F.col(key).bitwiseAND(F.lit((1 << 33) - 1))).cast("string"))
    ids = df if schema.row_id else df.withColumn("_part", F.shiftright(key, 33)).join(starts, "_part")
    ids = ids.select(key, F.coalesce(name, F.lit("")).alias("_name"))
    rows = found.frame.join(ids, key)
    out = lambda *parts: os.path.join(output_dir, *parts)
    who, flag = {id_name: F.col("_name")}, {"is_bot": F.col("is_bot").cast("int")}
    top = F.coalesce(F.get("hits", F.lit(0))["reason"], F.lit(""))
    scores = {"evidence_tier": F.col("tier"), "heuristic_score": sinks.six("heuristic"), "ml_score": sinks.six("ml_score"), "combined_score": sinks.six("combined"), "top_reason": top}
    names = list(found.features.families)
    matrix = {log.shown(c): sinks.six(f"x__{c}") for c in names}
    tables = {out("predictions.tsv"): who | flag, out("predictions-extended.tsv"): who | flag | scores, out("artifacts", "features.tsv"): who | matrix}
    sinks.write_tables(rows, [F.col(key)], tables, single)
    chosen = materialise(detect.selected(found, max_events), "selected").join(ids, key)
    away = detect.deviations(found, chosen).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "feature", "value", "z", "percentile"))).alias("away"))
    records = []
    for r in chosen.join(away, key, "left").orderBy(F.desc("combined"), key).collect():
        records.append({
            "event_id": r["_name"], "evidence_tier": r.tier, "heuristic_score": round(r.heuristic, 4), "ml_score": round(r.ml_score, 4), "combined_score": round(r.combined, 4), "reasons": r.reasons,
            "feature_deviations": [{"feature": log.shown(x.feature), "value": round(x.value, 4), "robust_z": round(x.z, 2), "batch_percentile": None if x.percentile is None else round(x.percentile, 4)} for x in r.away or []],
        })
    sinks.write_json(spark, out("artifacts", "selected_events.json"), records)
    counted = detect.summary(found).first()
    summary = {
        "input_path": path, "total_events": counted.n_rows, "bot_events": counted.n_flagged, "bot_rate": counted.rate, "decision_rule": f"heuristic >= {found.cutoff} or ml_score > threshold", "heuristic_cutoff": found.cutoff,
        "entity_column_overrides": list(entity), "content_column_overrides": list(content), "timestamp_column_override": timestamp, "ml_threshold": found.threshold, "ml_threshold_method": found.method, "ml_backend": found.backend,
        "heuristic_flag_rate": counted.heuristic_rate, "ml_flag_rate": counted.ml_rate,
        "evidence_tier_counts": {"tier_1_both": counted.tier_1, "tier_2_heuristic_only": counted.tier_2, "tier_3_ml_only": counted.tier_3, "not_selected": counted.tier_0},
        "id_column": id_name, "feature_names": [log.shown(c) for c in names], "schema": schema.to_dict(), "rule_thresholds": detect.shown_thresholds(found), "top_reasons": [[r.reason, r.n] for r in detect.top_reasons(found).collect()],
    }
    sinks.write_json(spark, out("artifacts", "summary.json"), summary)
    if single:
        step = max(1, counted.n_rows // PLOTTED)
        drawn = [r.ml_score for r in found.frame.select("ml_score", key).filter(F.pmod(F.xxhash64(key), F.lit(step)) == 0).orderBy(F.desc("ml_score")).limit(2 * PLOTTED).collect()]
        sinks.threshold_plot(spark, out("artifacts", "ml_score_threshold.png"), drawn, found.threshold)
    return summary

"""Wall-clock seconds of the headline queries; prints one JSON line.

Each query runs whole, its result written to Spark's no-op sink.  The first
query is run once before, unmeasured, to start the session.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["value_concentration", "joint_context", "burst_window", "runs_cadence", "entity_diversity", "actor_graph", "robust_z", "rule_scores", "detect_events", "forest_scores"]


def main() -> None:
    from pyspark.sql import SparkSession

    from vigilog.plans import catalogue
    from vigilog.session import SETTINGS

    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = SETTINGS | {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    }
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for k, name in enumerate([HEADLINE[0], *HEADLINE]):
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        if k:
            took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    sf = os.path.basename(data.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

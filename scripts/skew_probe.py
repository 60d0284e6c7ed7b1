"""Skew probe: one task holds a third of all runs; check that no task gets a third of the work.

Derives a skewed run log from lineitem (task 'hot' for every third order), runs best-of-N
(E1), last-write-wins (A10) and pass@k (D6) on it, and reads per-task input records of
every stage from Spark's event log (written to a fresh scratch folder).

Usage: python scripts/skew_probe.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="skew-events-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").appName("skew-probe")
             .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", logdir).config("spark.eventLog.compress", "false").config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="skew-ckpt-", dir="/tmp")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from passforge.operators import metrics as m
    from passforge.operators import verdicts as v
    from passforge.sources import runlog as rl

    li = spark.read.parquet(os.path.join(sf, "lineitem.parquet")).repartition(16)
    runs = li.select(
        F.lit("e").alias("experiment_id"), F.col("l_returnflag").alias("model"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("hot")).otherwise(F.col("l_partkey").cast("string")).alias("task_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("candidate_idx"),
        F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("overall_pass"),
        (F.col("l_discount") * 100).cast("long").alias("n_passed"), F.col("l_tax").alias("mean_score"))
    jobs = {
        "e1_select_best": lambda: v.select_best(runs),
        "a10_upsert": lambda: rl.upsert_runs(runs.withColumn("ingest_seq", F.col("candidate_idx")),
                                            key=("experiment_id", "task_id")),
        "d6_pass_at_k": lambda: m.pass_at_k_by_model(runs),
    }
    for name, fn in jobs.items():
        spark.sparkContext.setJobDescription(name)
        fn().write.format("noop").mode("overwrite").save()
    total = runs.count()
    spark.stop()

    stages = {}
    for path in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
        if not os.path.isfile(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerTaskEnd":
                    met = ev.get("Task Metrics") or {}
                    recs = (met.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    stages.setdefault(ev["Stage ID"], []).append(recs)
    worst = max((max(r) for r in stages.values() if sum(r) > 0), default=0)
    print(json.dumps({"rows": total, "hot_task_rows": total // 3, "max_shuffle_records_in_one_task": worst,
                      "stages": {k: {"tasks": len(v), "max": max(v), "sum": sum(v)} for k, v in sorted(stages.items())
                                 if sum(v) > 0}}))


if __name__ == "__main__":
    main()

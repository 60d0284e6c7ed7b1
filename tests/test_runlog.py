"""A5-A11, C3-C7, C4, D15, E2 on tiny frames."""

import csv
import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from passforge.functions.ids import config_hash, run_id
from passforge.operators import work as w
from passforge.sources import runlog as rl

LOG = "experiment_id string, task_id string, candidate_idx int, model string, overall_pass int, " \
      "gen_error string, ingest_seq long"


def test_run_id_matches_hashlib(spark):
    import hashlib
    got = spark.range(1).select(run_id(F.lit("exp-1"), F.lit("t/1"), F.lit(3)).alias("r")).first()["r"]
    want = "exp-1-" + hashlib.sha1("exp-1\x00t/1\x003".encode()).hexdigest()[:16]
    assert got == want
    j = '{"a": 1, "b": [1, 2]}'
    assert spark.range(1).select(config_hash(F.lit(j)).alias("h")).first()["h"] == \
        hashlib.sha256(j.encode()).hexdigest()[:12]


def test_init_store_is_repeatable(spark, tmp_dir):
    locs = rl.init_store(spark, tmp_dir)
    rl.init_store(spark, tmp_dir)
    assert set(locs) == {"experiments", "runs", "method_results"}
    assert spark.table("runs").count() == 0


def test_upsert_last_write_wins_and_replay_is_idempotent(spark):
    log = spark.createDataFrame([("e", "t", 0, "m", 0, None, 1), ("e", "t", 0, "m", 1, None, 2),
                                 ("e", "t", 1, "m", 0, "boom", 1)], LOG)
    cur = {(r["task_id"], r["candidate_idx"]): (r["overall_pass"], r["ingest_seq"]) for r in rl.upsert_runs(log).collect()}
    assert cur == {("t", 0): (1, 2), ("t", 1): (0, 1)}
    replay = rl.upsert_runs(log.unionByName(log)).collect()
    assert sorted(map(tuple, replay)) == sorted(map(tuple, rl.upsert_runs(log).collect()))


def test_replacement_drops_old_children(spark):
    log = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 1)], "run_id string, ingest_seq long") \
        .withColumn("experiment_id", F.lit("e")).withColumn("task_id", F.col("run_id")) \
        .withColumn("candidate_idx", F.lit(0))
    cur = rl.upsert_runs(log)
    kids = spark.createDataFrame([("r1", 1, "ruff"), ("r1", 1, "pytest"), ("r1", 2, "ruff"), ("r2", 1, "ruff")],
                                 "run_id string, ingest_seq long, method string")
    got = sorted((r["run_id"], r["ingest_seq"], r["method"]) for r in rl.current_methods(kids, cur).collect())
    assert got == [("r1", 2, "ruff"), ("r2", 1, "ruff")]


def test_finished_keys_rules(spark):
    runs = spark.createDataFrame([
        ("e", "t", 0, "r0", 1, None),        # passed
        ("e", "t", 1, "r1", 0, "rate"),      # generation error: finished, not retried
        ("e", "t", 2, "r2", 0, None),        # has a method row
        ("e", "t", 3, "r3", 0, None),        # nothing: retried
    ], "experiment_id string, task_id string, candidate_idx int, run_id string, overall_pass int, gen_error string")
    methods = spark.createDataFrame([("r2", "ruff")], "run_id string, method string")
    done = sorted(r["candidate_idx"] for r in rl.finished_keys(runs, methods, "e").collect())
    assert done == [0, 1, 2]
    tasks = spark.createDataFrame([("t",), ("u",)], "task_id string")
    pend = w.pending_work(tasks, 5, rl.finished_keys(runs, methods, "e"), base_seed=10)
    got = sorted((r["task_id"], r["candidate_idx"], r["seed"]) for r in pend.collect())
    assert got == [("t", 3, 13), ("t", 4, 14)] + [("u", i, 10 + i) for i in range(5)]
    summary = w.work_summary(tasks, 5, pend).first()
    assert (summary["planned"], summary["pending"], summary["skipped"]) == (10, 7, 3)
    assert w.pending_work(tasks, 0).count() == 0
    assert w.pending_work(tasks, 2, base_seed=None).where(F.col("seed").isNotNull()).count() == 0


def test_assign_seeds_positional(spark):
    work = spark.createDataFrame([("t", 2), ("t", 5), ("t", 7), ("u", 0)], "task_id string, candidate_idx int")
    out = {(r["task_id"], r["candidate_idx"]): (r["planned_seed"], r["recorded_seed"])
           for r in w.assign_seeds(work, base_seed=100).collect()}
    assert out[("t", 5)] == (105, 103) and out[("t", 7)] == (107, 104) and out[("u", 0)] == (100, 100)
    ignored = w.assign_seeds(work, base_seed=100, honours_seed=False)
    assert ignored.where(F.col("recorded_seed").isNotNull()).count() == 0


def test_pair_and_complete_generations(spark):
    items = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2), ("u", 0)], "task_id string, candidate_idx int")
    outs = spark.createDataFrame([("t", 0, "a", 3, 4), ("t", 1, "b", 3, 4)],
                                 "task_id string, pos int, text string, prompt_tokens int, completion_tokens int")
    assert w.pair_outputs(items, outs).count() == 2
    fails = spark.createDataFrame([("u", "HTTP 500")], "task_id string, error string")
    got = sorted((r["task_id"], r["candidate_idx"], r["text"], r["completion_tokens"], r["error"])
                 for r in w.complete_generations(items, outs, fails).collect())
    assert got == [("t", 0, "a", 4, None), ("t", 1, "b", 4, None), ("u", 0, "", 0, "HTTP 500")]


def test_register_and_finalize_experiments(spark):
    ts = dt.datetime(2024, 1, 1)
    existing = spark.createDataFrame([("e1",)], "experiment_id string")
    new = spark.createDataFrame([("e1", ts), ("e2", ts + dt.timedelta(1)), ("e2", ts)], "experiment_id string, started_at timestamp")
    got = [(r["experiment_id"], r["started_at"]) for r in rl.register_experiments(existing, new).collect()]
    assert got == [("e2", ts)]
    exps = spark.createDataFrame([("e1", None), ("e2", ts)], "experiment_id string, finished_at timestamp")
    ids = spark.createDataFrame([("e1",), ("nope",)], "experiment_id string")
    out = {r["experiment_id"]: r["finished_at"] for r in rl.finalize_experiments(exps, ids, "2025-01-01 00:00:00").collect()}
    assert out == {"e1": dt.datetime(2025, 1, 1), "e2": ts}


def test_export_csv_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("e", "t2", 1, 'say "hi"\nbye', None), ("e", "t1", 0, "", "x")],
                               "experiment_id string, task_id string, candidate_idx int, code string, gen_error string")
    path = os.path.join(tmp_dir, "out", "runs.csv")
    rl.export_runs_csv(df, path, experiment_id="e")
    rows = []
    for f in sorted(glob.glob(os.path.join(path, "part-*.csv"))):
        with open(f, newline="") as fh:
            rows += list(csv.DictReader(fh))
    got = sorted((r["task_id"], r["code"], r["gen_error"]) for r in rows)
    assert got == [("t1", "", "x"), ("t2", 'say "hi"\nbye', "")]


def test_append_method_results(spark):
    df = spark.createDataFrame([("r", "ruff", 1, None), ("r", "z3", 0, [{"violation": "qos_depth_lt_1"}])],
                               "run_id string, method string, passed int, findings array<map<string,string>>")
    out = {r["method"]: r for r in rl.append_method_results(df).collect()}
    assert out["ruff"]["findings_json"] == "[]"
    assert out["z3"]["findings_json"] == '[{"violation":"qos_depth_lt_1"}]'
    assert out["ruff"]["id"] != out["z3"]["id"]


def test_scan_runs_orders(spark):
    df = spark.createDataFrame([("e", "b", 0), ("e", "a", 1), ("e", "a", 0), ("f", "a", 0)],
                               "experiment_id string, task_id string, candidate_idx int")
    got = [(r["task_id"], r["candidate_idx"]) for r in rl.scan_runs(df, "e").collect()]
    assert got == [("a", 0), ("a", 1), ("b", 0)]


def test_append_and_compact(spark, tmp_dir):
    log = os.path.join(tmp_dir, "log")
    out = os.path.join(tmp_dir, "current")
    rows = spark.createDataFrame([("e1", "t", 0, "m", 0, None, 1), ("e1", "t", 0, "m", 1, None, 2),
                                  ("e2", "t", 0, "m", 0, None, 1)], LOG)
    rl.write_append(rows, log)
    rl.write_append(rows, log)          # a replayed job appends the same rows again
    rl.compact_runs(spark, log, out)
    cur = {(r["experiment_id"], r["candidate_idx"]): r["overall_pass"] for r in spark.read.parquet(out).collect()}
    assert cur == {("e1", 0): 1, ("e2", 0): 0}
    rl.write_append(spark.createDataFrame([("e2", "t", 0, "m", 1, None, 5)], LOG), os.path.join(tmp_dir, "log2"))
    rl.compact_runs(spark, os.path.join(tmp_dir, "log2"), out)   # only e2 is rewritten
    cur = {(r["experiment_id"], r["candidate_idx"]): r["overall_pass"] for r in spark.read.parquet(out).collect()}
    assert cur == {("e1", 0): 1, ("e2", 0): 1}

"""The stored run log: narrow last-write-wins, pruned and bucketed reads, compaction of what changed."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from passforge.operators import verdicts as v
from passforge.sources import runlog as rl

LOG = "experiment_id string, task_id string, candidate_idx int, run_id string, overall_pass int, gen_error string, ingest_seq long"


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def log_rows(n=60):
    return [(f"e{i % 4}", f"t{i // 4 % 5}", i // 20, f"e{i % 4}/t{i // 4 % 5}/{i // 20}", int((i + s) % 3 == 0),
             "rate" if i % 11 == 0 else None, s) for i in range(n) for s in range(1, 2 + i % 3)]


@pytest.fixture()
def store(spark, tmp_dir):
    db = f"store_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{tmp_dir}/{db}'")
    for _ in range(2):
        rl.init_store(spark, os.path.join(tmp_dir, db), database=db, buckets=4)
    log = spark.createDataFrame(log_rows(), LOG).withColumns(
        {"provider": F.lit("p"), "model": F.lit("m"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    rl.append_rows(log, f"{db}.runs", 4)
    rl.append_rows(log.where("ingest_seq = 1"), f"{db}.runs", 4)  # a replayed append
    kids = log.where("candidate_idx % 2 = 0").select("run_id", "experiment_id", "ingest_seq", F.lit("ruff").alias("method"),
                                                     F.lit(1).alias("passed"), F.lit("id").alias("id"))
    rl.append_rows(kids, f"{db}.method_results", 4)
    rl.append_rows(spark.createDataFrame([(f"e{i}", "odd" if i % 2 else "even", "{}") for i in range(4)],
                                         "experiment_id string, config_hash string, config_json string")
                   .withColumn("started_at", F.lit("2024-01-01").cast("timestamp")), f"{db}.experiments")
    yield db
    spark.sql(f"DROP DATABASE {db} CASCADE")


def test_last_write_wins_sorts_no_payload(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    log = spark.createDataFrame(log_rows(), LOG).withColumn(
        "payload", F.parse_json(F.to_json(F.struct("task_id", "ingest_seq"))))
    for _ in range(2):
        rl.write_append(log, path)  # replays of every attempt
    cur = rl.current_runs(spark, path)
    plan = plan_of(cur)
    assert "SortAggregate" not in plan and "Sort [" not in plan and "SortMergeJoin" not in plan
    got = {(r["experiment_id"], r["task_id"], r["candidate_idx"]): r["ingest_seq"]
           for r in cur.where(F.variant_get("payload", "$.ingest_seq", "long") == F.col("ingest_seq")).collect()}
    want = {}
    for e, t, c, *_, s in log_rows():
        want[e, t, c] = max(s, want.get((e, t, c), 0))
    assert got == want and cur.count() == len(want)
    assert "payload" in rl.upsert_runs(log).columns and rl.upsert_runs(log).count() == len(want)  # landed first


@pytest.mark.parametrize("order,kind", [(["ts"], "timestamp"), (["d"], "date"), (["ts", "ingest_seq"], "timestamp"), (["name"], "string")])
def test_any_order_columns(spark, order, kind):
    rows = [("k", "2024-01-01 00:00:00.1", "2024-01-01", "a", 1), ("k", "2024-01-01 00:00:00.9", "2024-01-02", "b", 2),
            ("n", None, None, None, 1), ("n", "2020-01-01 00:00:00", "2020-01-01", "a", 2), (None, "2020-01-01 00:00:00", "2020-01-01", "z", 1)]
    df = spark.createDataFrame(rows, "id string, ts string, d string, name string, ingest_seq int") \
        .withColumn("ts", F.col("ts").cast("timestamp")).withColumn("d", F.col("d").cast("date"))
    last = rl.upsert_runs(df.unionByName(df), key=["id"], order=order)
    assert {(r["id"], r["ingest_seq"]) for r in last.collect()} == {("k", 2), ("n", 2), (None, 1)} and last.count() == 3
    first = rl._first_by(df, ["id"], order)
    assert {(r["id"], r["ingest_seq"]) for r in first.collect()} == {("k", 1), ("n", 1), (None, 1)}


def test_experiments_prune_partitions(spark, store):
    runs, experiments = spark.table(f"{store}.runs"), spark.table(f"{store}.experiments")
    rows = rl.scan_experiments(runs, experiments.where("config_hash = 'odd'"))
    plan = plan_of(rows)
    assert "dynamicpruning" in plan
    assert {r["experiment_id"] for r in rows.collect()} == {"e1", "e3"}


def test_bucketed_store_needs_no_exchange(spark, store):
    runs, methods = spark.table(f"{store}.runs"), spark.table(f"{store}.method_results")
    done = rl.finished_in_store(runs, methods, spark.table(f"{store}.experiments").where("config_hash = 'odd'"))
    plan = plan_of(done)
    assert "dynamicpruning" in plan
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan
    want = set()
    last = {}
    for e, t, c, _, p, err, s in log_rows():
        if s >= last.get((e, t, c), (0,))[0]:
            last[e, t, c] = (s, p, err)
    for (e, t, c), (_, p, err) in last.items():
        if e in ("e1", "e3") and (p == 1 or err or c % 2 == 0):
            want.add((e, t, c))
    assert sorted(map(tuple, done.collect())) == sorted(want)


def test_compaction_leaves_other_experiments_alone(spark, tmp_dir):
    path, out = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "current")
    log = spark.createDataFrame(log_rows(), LOG)
    rl.write_append(log, os.path.join(path, "batch_id=0"))
    rl.compact_runs(spark, path, out, since="batch_id >= 0")
    before = {e: set(glob.glob(f"{out}/experiment_id={e}/*.parquet")) for e in ("e0", "e1", "e2", "e3")}
    rl.write_append(log.where("experiment_id = 'e2'").withColumns({"ingest_seq": F.lit(9), "overall_pass": F.lit(7)}),
                    os.path.join(path, "batch_id=1"))
    rl.compact_runs(spark, path, out, since="batch_id >= 1")
    after = {e: set(glob.glob(f"{out}/experiment_id={e}/*.parquet")) for e in before}
    assert all(before[e] == after[e] for e in ("e0", "e1", "e3")) and not before["e2"] & after["e2"]
    cur = spark.read.parquet(out)
    assert {r["overall_pass"] for r in cur.where("experiment_id = 'e2'").collect()} == {7}
    assert cur.count() == len({r[:3] for r in log_rows()})


def test_best_of_n_has_one_winner(spark):
    rows = [("t", 0, False, 0, 0.0, "worse replay"), ("t", 0, True, 2, 0.5, "best"), ("t", 0, True, 2, 0.5, "best"),
            ("t", 1, True, 2, 0.5, "later"), ("u", 3, False, None, None, "only"), ("u", 3, False, 0, 0.0, "only")]
    df = spark.createDataFrame(rows, "task_id string, candidate_idx int, overall_pass boolean, n_passed int, mean_score double, note string")
    got = sorted((r["task_id"], r["candidate_idx"], r["note"]) for r in v.select_best(df).collect())
    assert got == [("t", 0, "best"), ("u", 3, "only")]


def test_scanned_experiments_are_broadcast(spark, tmp_dir):
    """Few experiments hold all runs: dealt by experiment, a task would get all runs of one."""
    path = os.path.join(tmp_dir, "log")
    rl.write_append(spark.createDataFrame(log_rows(), LOG), path)
    log = spark.read.parquet(path)
    ids = log.where("candidate_idx = 0").select("experiment_id").distinct()
    got = rl.scan_experiments(log, ids)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.count() == log.join(ids, "experiment_id").count()


def test_buckets_follow_the_rows():
    assert [rl.buckets_for(n) for n in (0, 600_000, 4_000_000, 4_000_001, 36_000_000)] == [8, 8, 8, 9, 72]

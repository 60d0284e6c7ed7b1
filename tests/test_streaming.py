"""K1 and K2: the streaming landing and status equal their batch counterparts."""

import os

from pyspark.sql import functions as F

from passforge.operators import metrics as m
from passforge.sources import runlog as rl
from passforge.streaming import runstream as rs

SCHEMA = "experiment_id string, task_id string, candidate_idx int, overall_pass int, seq long"


def _land(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, name))


def test_status_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    rows = [("e1", f"t{i}", 0, i % 2, i) for i in range(10)] + [("e2", "t", 0, 1, 99)]
    _land(spark, src, rows, "a")
    stream = rs.read_run_stream(spark, os.path.join(src, "a"), SCHEMA)
    got = {r["experiment_id"]: (r["total"], r["passed"]) for r in rs.run_status(stream).collect()}
    batch = m.experiment_status(spark.createDataFrame(rows, SCHEMA))
    assert got == {r["experiment_id"]: (r["total"], r["passed"]) for r in batch.collect()}


def test_landing_is_idempotent_and_last_write_wins(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    _land(spark, src, [("e", "t", 0, 0, 1), ("e", "t", 1, 1, 2)], "b1")
    out = os.path.join(tmp_dir, "log")
    ckpt = os.path.join(tmp_dir, "ckpt")
    stream = rs.read_run_stream(spark, os.path.join(src, "b1"), SCHEMA)
    rs.land_runs(stream, out, order_by="seq", checkpoint=ckpt)
    # A second file with a correction arrives; the same checkpoint continues.
    spark.createDataFrame([("e", "t", 0, 1, 3)], SCHEMA).write.mode("append").parquet(os.path.join(src, "b1"))
    rs.land_runs(rs.read_run_stream(spark, os.path.join(src, "b1"), SCHEMA), out, order_by="seq", checkpoint=ckpt)
    log = rs.read_landed(spark, out, rs.landed_schema(stream, "seq"))
    cur = {(r["task_id"], r["candidate_idx"]): r["overall_pass"] for r in rl.upsert_runs(log, order=rs.ATTEMPT).collect()}
    assert cur == {("t", 0): 1, ("t", 1): 1}
    # Replaying everything into a fresh log gives the same current state.
    out2 = os.path.join(tmp_dir, "log2")
    rs.land_runs(rs.read_run_stream(spark, os.path.join(src, "b1"), SCHEMA), out2, order_by="seq",
                 checkpoint=os.path.join(tmp_dir, "ckpt2"))
    log2 = rs.read_landed(spark, out2, rs.landed_schema(stream, "seq"))
    cur2 = {(r["task_id"], r["candidate_idx"]): r["overall_pass"] for r in rl.upsert_runs(log2, order=rs.ATTEMPT).collect()}
    assert cur2 == cur
    assert log.where(F.col("batch_id") == 1).count() == 1


def test_dedupe_exact_replays(spark, tmp_dir):
    import datetime as dt

    src = os.path.join(tmp_dir, "replays")
    rows = [("e", "t", 0, 1, 1, dt.datetime(2024, 1, 1, 0, 0)), ("e", "t", 0, 1, 1, dt.datetime(2024, 1, 1, 0, 0)),
            ("e", "t", 1, 0, 2, dt.datetime(2024, 1, 1, 0, 5))]
    schema = SCHEMA + ", ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = rs.dedupe_replays(rs.read_run_stream(spark, src, schema), ["task_id", "candidate_idx"], "ts", "1 hour")
    out = os.path.join(tmp_dir, "dedup-out")
    rs.land_runs(stream, out, order_by="seq", checkpoint=os.path.join(tmp_dir, "dedup-ckpt"))
    assert rs.read_landed(spark, out, rs.landed_schema(stream, "seq")).count() == 2


def test_later_batch_wins_over_any_position(spark, tmp_dir):
    src, out, ckpt = (os.path.join(tmp_dir, n) for n in ("many-in", "many-out", "many-ckpt"))
    first = spark.createDataFrame([("e", f"t{i}", 0, 0, (1 << 61) + i) for i in range(300)], SCHEMA)
    first.repartition(150).write.parquet(src)  # more partitions than a packed sequence had room for
    rs.land_runs(rs.read_run_stream(spark, src, SCHEMA), out, order_by="seq", checkpoint=ckpt)
    spark.createDataFrame([("e", f"t{i}", 0, 1, i) for i in range(300)], SCHEMA).write.mode("append").parquet(src)
    stream = rs.read_run_stream(spark, src, SCHEMA)
    rs.land_runs(stream, out, order_by="seq", checkpoint=ckpt)
    log = rs.read_landed(spark, out, rs.landed_schema(stream, "seq"))
    assert {r["overall_pass"] for r in rl.upsert_runs(log, order=rs.ATTEMPT).collect()} == {1}


def test_status_follows_a_running_stream(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "live-in"), os.path.join(tmp_dir, "live-out")
    _land(spark, src, [("e", "t", 0, 1, 1)], "a")
    q = rs.watch_status(rs.read_run_stream(spark, os.path.join(src, "a"), SCHEMA), out,
                        os.path.join(tmp_dir, "live-ckpt"), every="1 second")
    try:
        q.processAllAvailable()
        assert [(r["total"], r["passed"]) for r in rs.read_status(spark, out).collect()] == [(1, 1)]
        spark.createDataFrame([("e", "t", 1, 0, 2)], SCHEMA).write.mode("append").parquet(os.path.join(src, "a"))
        q.processAllAvailable()
        assert [(r["total"], r["passed"]) for r in rs.read_status(spark, out).collect()] == [(2, 1)]
    finally:
        q.stop()


def test_attempts_inside_one_second_keep_their_order(spark, tmp_dir):
    import datetime as dt

    schema = "experiment_id string, task_id string, candidate_idx int, code string, ts timestamp"
    at = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("e", "t", 0, "zzz-old", at + dt.timedelta(milliseconds=100)), ("e", "t", 0, "aaa-new", at + dt.timedelta(milliseconds=900))]
    src, out = os.path.join(tmp_dir, "sub-in"), os.path.join(tmp_dir, "sub-out")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = rs.read_run_stream(spark, src, schema)
    rs.land_runs(stream, out, order_by="ts", checkpoint=os.path.join(tmp_dir, "sub-ckpt"))
    log = rs.read_landed(spark, out, rs.landed_schema(stream, "ts"))
    assert log.schema["pos"].dataType.typeName() == "timestamp"
    assert [r["code"] for r in rl.upsert_runs(rl.with_row_address(log), order=rs.ATTEMPT).collect()] == ["aaa-new"]


def test_replayed_file_over_triggers(spark, tmp_dir):
    import datetime as dt

    schema = SCHEMA + ", ts timestamp"
    src, out = os.path.join(tmp_dir, "again-in"), os.path.join(tmp_dir, "again-out")
    day = dt.datetime(2024, 1, 1)
    first = [("e", f"t{i}", 0, 0, i, day + dt.timedelta(minutes=i)) for i in range(20)]
    later = [("e", f"t{i}", 0, 1, 100 + i, day + dt.timedelta(days=2, minutes=i)) for i in range(10)]
    for rows in (first, later, first):  # the first file comes again, a trigger later than its corrections
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = rs.read_run_stream(spark, src, schema, max_files_per_trigger=1)
    rs.land_runs(stream, out, order_by="seq", checkpoint=os.path.join(tmp_dir, "again-ckpt"), replay_key=["seq"],
                 event_time="ts", delay="30 days")
    log = rs.read_landed(spark, out, rs.landed_schema(stream, "seq"))
    assert log.count() == 30
    cur = {r["task_id"]: r["overall_pass"] for r in rl.upsert_runs(log, order=rs.ATTEMPT).collect()}
    assert cur == {f"t{i}": int(i < 10) for i in range(20)}


def test_status_folders_are_bounded(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "many-status-in"), os.path.join(tmp_dir, "many-status")
    for i in range(6):
        spark.createDataFrame([("e", f"t{i}", 0, 1, i)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = rs.read_run_stream(spark, src, SCHEMA, max_files_per_trigger=1)
    rs.watch_status(stream, out, os.path.join(tmp_dir, "many-status-ckpt"), available_now=True).awaitTermination()
    assert len([n for n in os.listdir(out) if n.startswith("batch_id=")]) == rs.KEPT
    assert [(r["total"], r["passed"]) for r in rs.read_status(spark, out).collect()] == [(6, 6)]

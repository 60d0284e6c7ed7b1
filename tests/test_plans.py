"""Physical-plan properties the operators are built for (checked on the executed plan)."""

import __spark_entry__ as E
from passforge.operators import verdicts as v
from passforge.sources import runlog as rl

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_columns_and_has_no_window(spark):
    df = E.queries()["d6_pass_at_k_by_model"](spark, SF)
    assert "Window" not in plan(df)
    import re
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan(df))
    assert schemas and all("l_extendedprice" not in s and "l_shipdate" not in s for s in schemas)


def test_best_of_n_and_upsert_do_not_sort_a_hot_key(spark):
    hot = spark.range(2000).selectExpr("'hot' as task_id", "cast(id as int) as candidate_idx",
                                       "id % 7 = 0 as overall_pass", "cast(id % 3 as long) as n_passed",
                                       "cast(id % 5 as double) as mean_score")
    best = v.select_best(hot)
    assert "Window" not in plan(best)
    rows = hot.collect()
    want = min(rows, key=lambda r: (-int(r["overall_pass"]), -r["n_passed"], -r["mean_score"], r["candidate_idx"]))
    assert best.first()["candidate_idx"] == want["candidate_idx"]
    log = hot.selectExpr("'e' as experiment_id", "task_id", "0 as candidate_idx",
                         "cast(candidate_idx as long) as ingest_seq")
    cur = rl.upsert_runs(log)
    assert "Window" not in plan(cur)
    assert cur.first()["ingest_seq"] == 1999


def test_positions_match_row_number_with_a_hot_key(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from passforge.operators.ranking import positions

    df = spark.range(5000).selectExpr("case when id % 3 = 0 then 'cold' || cast(id % 11 as string) else 'hot' end as k",
                                      "id * 7 % 5003 as o")
    got = positions(df, ["k"], ["o"], num_partitions=16)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert sorted(map(tuple, got.select("k", "o", "pos").collect())) == \
        sorted(map(tuple, want.select("k", "o", "pos").collect()))


LINEITEM = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")


def lineitems(spark, folder):
    """Attempts of three orders; the first line of order 1 comes three times."""
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [(o, 1 + o % 2, s, n, 5.0, 10.0 + s, 0.02 * s, 0.03 * s, "A", "F", day)
            for o, n, times in ((1, 1, 3), (1, 2, 1), (2, 1, 2), (3, 1, 1)) for s in range(1, times + 1)]
    spark.createDataFrame(rows, LINEITEM).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_assign_seeds_computes_its_work_once(spark):
    from pyspark.sql import functions as F

    from passforge.operators.work import assign_seeds

    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(i):
        calls.add(1)
        return i

    work = spark.range(60).select(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("task_id"),
                                  counted((F.col("id") + 4).cast("int")).alias("candidate_idx"))
    got = {(r["task_id"], r["candidate_idx"]): (r["planned_seed"], r["recorded_seed"])
           for r in assign_seeds(work, base_seed=100).collect()}
    assert got == {(f"t{i % 3}", i + 4): (i + 104, 104 + i % 3 + i // 3) for i in range(60)}
    assert calls.value == 60, calls.value


def test_runs_are_numbered_before_columns_are_made(spark, tmp_dir):
    from passforge.sources.bindings import runs_view

    df = runs_view(spark, lineitems(spark, tmp_dir), with_ids=True)
    assert "rate limited" not in plan(df).split("Window", 1)[1]  # nor shuffled and sorted
    assert sorted((r["task_id"], r["candidate_idx"]) for r in df.collect()) == \
        [("1", 0), ("1", 1), ("2", 0), ("2", 1), ("2", 2), ("2", 3), ("2", 4)]


def test_attempts_are_numbered_before_columns_are_made(spark, tmp_dir):
    from passforge.sources.bindings import run_log_view

    df = run_log_view(spark, lineitems(spark, tmp_dir))
    assert "exp-" not in plan(df).split("Window", 1)[1]  # nor shuffled and sorted
    assert sorted((r["task_id"], r["candidate_idx"], r["ingest_seq"]) for r in df.collect()) == \
        [("1", 1, 1), ("1", 1, 2), ("1", 1, 3), ("1", 2, 1), ("2", 1, 1), ("2", 1, 2), ("3", 1, 1)]


def test_stored_log_is_numbered_once(spark, tmp_dir, monkeypatch):
    """The attempts that are appended again are read back, so what the log is made of is computed once."""
    from pyspark.sql import functions as F

    from passforge.plans import q_runlog

    calls, view = spark.sparkContext.accumulator(0), q_runlog.run_log_view

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    monkeypatch.setattr(q_runlog, "run_log_view", lambda *a: view(*a).withColumn("latency_ms", counted("latency_ms")))
    got = sorted((r["task_id"], r["candidate_idx"], r["ingest_seq"], r["latency"])
                 for r in E.queries()["a10_current_runs"](spark, lineitems(spark, tmp_dir)).collect())
    assert got == [("1", 1, 3, 13.0), ("1", 2, 1, 11.0), ("2", 1, 2, 12.0), ("3", 1, 1, 11.0)]
    assert calls.value == 7, calls.value


def test_method_rows_of_current_attempts_come_from_files(spark, tmp_dir):
    df = E.queries()["a10_current_methods"](spark, lineitems(spark, tmp_dir))
    assert "Window" not in plan(df)  # the attempts are numbered once, when they are landed
    assert sorted((r["ingest_seq"], r["method"], r["passed"]) for r in df.collect()) == sorted(
        [(3, "ruff", 1), (3, "pytest", 0), (1, "ruff", 0), (1, "pytest", 1), (2, "ruff", 0), (2, "pytest", 0),
         (1, "ruff", 0), (1, "pytest", 1)])


def test_task_lines_are_made_in_all_tasks(spark, tmp_dir):
    """Lines are made, stripped and filtered behind the exchange, not in the task that reads the split."""
    from passforge.sources import tasks as tk
    from passforge.sources.bindings import task_lines_view

    parts = [(k, "old tin", "SMALL", 10) for k in (1, 17, 23, 31)]  # good, cut, blank, no object
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1) \
        .write.parquet(f"{tmp_dir}/part.parquet")
    df = tk.classify_task_lines(task_lines_view(spark, tmp_dir), materialize=False)
    assert "task_id" not in plan(df).rsplit("Exchange", 1)[1]
    assert sorted((r["line_no"], r["status"]) for r in df.collect()) == [(2, "ok"), (18, "malformed"), (32, "not_object")]

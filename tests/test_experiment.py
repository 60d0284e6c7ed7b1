"""The composed write path: plan the work, ingest landed responses into run-log rows."""

import json

import pytest

from pyspark.sql import functions as F

from passforge.plans.experiment import ingest_generations, plan_experiment
from passforge.sources import runlog as rl
from passforge.sources import tasks as tk

GOOD = "import rclpy\n\ndef main(args=None):\n    rclpy.init(args=args)\n    n.destroy_node()\n    rclpy.shutdown()\n"


def _tasks(spark):
    t = {"task_id": "t1", "node_type": "publisher", "difficulty": "Easy", "prompt": "class A:\n    pass",
         "entry_point": "A", "ros_concepts": ["topics"],
         "interface_spec": {"node_name": "a", "topics_published": [{"name": "/a", "type": "std_msgs/Int32"}]},
         "test_oracle": {"checks": []}}
    lines = spark.createDataFrame([(1, json.dumps(t)), (2, json.dumps(dict(t, task_id="t2", difficulty="Hard")))],
                                  "line_no long, line string")
    return tk.split_classified(tk.classify_task_lines(lines))[0]


def test_plan_then_ingest(spark):
    tasks = _tasks(spark)
    work = plan_experiment(tasks, 3, difficulty="easy")
    rows = sorted((r["task_id"], r["candidate_idx"], r["planned_seed"]) for r in work.collect())
    assert rows == [("t1", 0, 0), ("t1", 1, 1), ("t1", 2, 2)]
    assert all("`/a` (std_msgs/Int32)" in r["prompt"] for r in work.collect())

    def body(text):
        return json.dumps({"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 5,
                                                                                 "completion_tokens": 7}})
    resp = spark.createDataFrame([
        ("t1", 0, "openai", "m", body("```python\n" + GOOD + "```"), 10.0, 0, None),
        ("t1", 1, "openai", "m", body("def broken(:"), 11.0, 1, None),
        ("t1", 2, "openai", "m", "", 0.0, 2, "HTTP 500"),
    ], "task_id string, candidate_idx int, provider string, model string, body string, latency_ms double, "
       "seed int, error string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    logs = spark.createDataFrame([("t1", 0, 0, False, None, "<testsuite><testcase name='a'/></testsuite>"),
                                  ("t1", 1, 0, False, None, None)],
                                 "task_id string, candidate_idx int, exit_code int, timed_out boolean, "
                                 "launch_error string, junit_xml string")
    # without evidence the required test method is not passed
    bare, skipped = ingest_generations("e1", resp, tasks, ingest_seq=1)
    assert [r["overall_pass"] for r in bare.collect()] == [0, 0, 0]
    assert {(r["status"], r["passed"]) for r in skipped.where("method = 'pytest'").collect()} == {("SKIPPED", 0)}
    with pytest.raises(ValueError):
        ingest_generations("e1", resp, tasks, methods=["ruff", "mypy"])
    runs, methods = ingest_generations("e1", resp, tasks, ingest_seq=1, logs=logs)
    got = {r["candidate_idx"]: (r["overall_pass"], r["gen_error"], r["code"] is None, r["prompt_tokens"])
           for r in runs.collect()}
    assert got == {0: (1, None, False, 5), 1: (0, None, False, 5), 2: (0, "HTTP 500", True, 0)}
    m = {(r["run_id"][-3:], r["method"]) for r in methods.collect()}
    assert len(m) == 2 * 4  # two verified candidates x (ruff, pylint_ros, pytest, hypothesis)
    assert {r["findings_json"] for r in methods.where("method = 'ruff' and passed = 1").collect()} == {"[]"}
    assert set(methods.columns) >= {"score", "exit_code", "duration_ms", "stdout", "stderr", "findings_json"}
    done = rl.finished_keys(runs, methods, "e1")
    assert sorted(r["candidate_idx"] for r in done.collect()) == [0, 1, 2]
    # a replaced run that crashed is unfinished: its old method rows do not count
    crash = runs.where("candidate_idx = 1").withColumn("ingest_seq", F.lit(2).cast("long"))
    resume = rl.resume_keys(runs.unionByName(crash), methods, "e1")
    assert sorted(r["candidate_idx"] for r in resume.collect()) == [0, 2]
    assert plan_experiment(tasks, 3, done=done, difficulty="easy").count() == 0

"""A1-A4, B1-B4, I5 on a JSON-lines fixture written by the test."""

import json
import os

import pytest
from pyspark.sql import functions as F

from passforge.sources import tasks as tk


def task(tid, **over):
    t = {"task_id": tid, "node_type": "publisher", "difficulty": "Easy", "prompt": "class A:\n    pass",
         "entry_point": "A", "interface_spec": {"node_name": "a", "topics_published": [{"name": "/a", "type": "std_msgs/Int32"}]},
         "test_oracle": {"checks": [{"type": "node_exists", "node_name": "a"}]}}
    t.update(over)
    return json.dumps(t, ensure_ascii=False)


LINES = [
    task("ok1"),                                  # 1
    "",                                           # 2 blank (counted)
    "not json",                                   # 3 malformed
    task("ok2") + "x",                            # 4 valid object + junk: malformed
    "{'task_id': 'q'}",                           # 5 single quotes: malformed
    "[1, 2]",                                     # 6 not an object
    json.dumps({"task_id": "m"}),                 # 7 missing required keys
    task("nl", ros_concepts=None),                # 8 explicit null list
    task("up", difficulty="EASY"),                # 9 bad enum
    task("extra", owner="qa"),                    # 10 unknown key kept
    task("uni", prompt="ünïcödé ✓"),              # 11 unicode
    "   " + task("padded") + "   ",               # 12 padded
    json.dumps({"bad": "x" * 300}),               # 13 long invalid line
    task("ok1", entry_point="B"),                 # 14 duplicate id (second)
]


@pytest.fixture()
def jsonl(tmp_dir):
    p = os.path.join(tmp_dir, "tasks.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(LINES) + "\n")
    return p


def test_load_tasks_line_numbers_and_errors(spark, jsonl):
    tasks, errors = tk.load_tasks(spark, jsonl)
    errs = {r["line_no"]: (r["status"], r["raw"]) for r in errors.collect()}
    assert {k: v[0] for k, v in errs.items()} == {3: "malformed", 4: "malformed", 5: "malformed", 6: "not_object",
                                                  7: "invalid", 8: "invalid", 9: "invalid", 13: "invalid"}
    assert len(errs[13][1]) == 200
    got = {r["line_no"]: r["task_id"] for r in tasks.collect()}
    assert got == {1: "ok1", 10: "extra", 11: "uni", 12: "padded", 14: "ok1"}
    extra = tasks.where(F.col("task_id") == "extra").select(F.try_variant_get("raw", "$.owner", "string")).first()[0]
    assert extra == "qa"
    uni = tasks.where(F.col("task_id") == "uni").first()
    assert uni["prompt"] == "ünïcödé ✓" and uni["ros_concepts"] == [] and uni["canonical_solution"] == ""


def test_line_numbers_across_many_splits(spark, tmp_dir):
    p = os.path.join(tmp_dir, "big.jsonl")
    with open(p, "w") as f:
        for i in range(20000):
            f.write("" if i % 7 == 3 else task(f"t{i}"))
            f.write("\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = tk.read_lines(spark, p)
        assert lines.rdd.getNumPartitions() > 10
        got = {r["line_no"]: r["line"] for r in lines.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 20000
    assert all((got[i + 1] == "") == (i % 7 == 3) for i in range(20000))
    assert json.loads(got[12346])["task_id"] == "t12345"


def test_strict_and_missing_path(spark, jsonl, tmp_dir):
    with pytest.raises(ValueError, match="invalid task at .*line"):   # strict stops at load time on the first bad record
        tk.load_tasks(spark, jsonl, strict=True)
    with pytest.raises(Exception):
        tk.load_tasks(spark, os.path.join(tmp_dir, "missing.jsonl"))


def test_strict_names_the_least_line_of_many_splits(spark, tmp_dir):
    p = os.path.join(tmp_dir, "late.jsonl")
    with open(p, "w") as f:
        for i in range(3000):
            f.write(("{broken" if i in (1717, 1718, 2900) or i > 2950 else task(f"t{i}")) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert tk.read_lines(spark, p).rdd.getNumPartitions() >= 50
        for _ in range(3):
            with pytest.raises(ValueError, match="late.jsonl, line 1718: invalid JSON"):
                tk.load_tasks(spark, p, strict=True)
        good = os.path.join(tmp_dir, "good.jsonl")
        with open(good, "w") as f:
            f.write(task("a") + "\n\n" + task("b") + "\n")
        assert tk.load_tasks(spark, good, strict=True)[0].count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_filters_and_lookup(spark, jsonl):
    tasks, _ = tk.load_tasks(spark, jsonl)
    assert tk.filter_tasks(tasks, difficulty="EASY").count() == 5
    assert tk.filter_tasks(tasks, difficulty="", node_type="publisher").count() == 5
    assert tk.filter_tasks(tasks, node_type="other").count() == 0
    assert sorted(r["task_id"] for r in tk.select_tasks(tasks, " extra, ,uni ").collect()) == ["extra", "uni"]
    assert tk.select_tasks(tasks, "").count() == 5
    first = tk.get_task(tasks, "ok1").first()
    assert first["line_no"] == 1 and json.loads(first["json"])["entry_point"] == "A"
    assert tk.get_task(tasks, "zzz").count() == 0
    listing, counts = tk.list_tasks(tk.classify_task_lines(tk.read_lines(spark, jsonl)))
    c = counts.first()
    assert (c["shown"], c["skipped"]) == (5, 8)
    assert listing.columns[-4:] == ["task_id", "difficulty", "node_type", "entry_point"]


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line.lstrip(" :+-") for line in plan if line.lstrip(" :+-").startswith("Filter")]


def test_filters_stay_above_the_line_check(spark, jsonl):
    lines = tk.read_lines(spark, jsonl)
    tasks = tk.split_classified(tk.classify_task_lines(lines, materialize=False))[0]
    hit = tk.filter_tasks(tasks, difficulty="easy", node_type="publisher")
    filters = _filters(hit)
    assert any("status" in f for f in filters)
    assert not [f for f in filters if "parse" in f.lower() or len(f) > 2000], filters
    kept = tk.filter_tasks(tk.load_tasks(spark, jsonl)[0], difficulty="easy", node_type="publisher")
    rows = sorted(r["line_no"] for r in kept.collect())
    assert rows and sorted(r["line_no"] for r in hit.collect()) == rows


def test_selection_by_table_stays_above_the_line_check(spark, jsonl):
    lines = tk.read_lines(spark, jsonl)
    tasks = tk.split_classified(tk.classify_task_lines(lines, materialize=False))[0]
    ids = spark.createDataFrame([("ok1",), ("padded",), ("m",), (None,)], "id string")
    hit = tk.select_tasks(tasks, ids)
    assert not [f for f in _filters(hit) if "parse" in f.lower() or len(f) > 2000], _filters(hit)
    assert sorted((r["task_id"], r["line_no"]) for r in hit.collect()) == [("ok1", 1), ("ok1", 14), ("padded", 12)]


def test_lookup_parses_lines_with_the_quoted_id_only(spark):
    escaped = task("t1").replace('"t1"', '"\\u0074\\u0031"')
    lines = spark.createDataFrame([(1, task("t10")), (2, task("at1")), (3, escaped), (4, task("t1"))], "line_no long, line string")
    hit = tk.find_task(lines, "t1")
    assert [r["line_no"] for r in hit.collect()] == [3]
    assert [f for f in _filters(hit) if '"t1"' in f], _filters(hit)


def test_explode_checks_and_static_oracle(spark, tmp_dir):
    checks = [
        {"type": "node_exists", "node_name": "a"},
        {"type": "node_exists"},                                  # known type missing field -> unknown
        {"type": "topic_published", "topic": "/a", "min_count": 3},
        {"type": "message_content", "topic": "/a", "field": "data", "expected": None},
        {"type": "log_output_contains", "pattern": "hi"},
        {"type": "parameter_declared", "node_name": "a", "param_name": "p"},
        {"type": "mystery"},
        {"topic": "/b"},                                          # no type, fits a kind -> unknown
    ]
    p = os.path.join(tmp_dir, "c.jsonl")
    with open(p, "w") as f:
        f.write(task("c", test_oracle={"checks": checks}) + "\n")
        f.write(task("bad", test_oracle={"checks": [{"no": "type"}]}) + "\n")
    tasks, errors = tk.load_tasks(spark, p)
    assert [r["line_no"] for r in errors.collect()] == [2]
    ex = tk.explode_checks(tasks).orderBy("check_pos").collect()
    assert [r["kind"] for r in ex] == ["node_exists", "unknown", "topic_published", "message_content",
                                       "log_output_contains", "parameter_declared", "unknown", "unknown"]
    assert ex[0]["timeout_sec"] == 5.0 and ex[2]["min_count"] == 3 and ex[2]["timeout_sec"] == 5.0
    st = [(r["status"], r["message"]) for r in tk.oracle_completeness(tk.explode_checks(tasks)).orderBy("check_pos").collect()]
    assert [s for s, _ in st] == ["PASS", "FAIL", "PASS", "PASS", "PASS", "XFAIL", "XFAIL", "XFAIL"]
    assert st[1][1] == "node_name required"


def test_enforce_contract(spark):
    df = spark.createDataFrame([(1, '{"status": "OK", "exit_code": 0}'), (2, '{"status": "ok"}'),
                                (3, '{"status": "OK", "host": "x"}'), (4, '{"exit_code": 1}'), (5, "nope")],
                               "id int, json string")
    ok, rej = tk.enforce_contract(df, "execution_result")
    assert [r["id"] for r in ok.collect()] == [1]
    reasons = {r["id"]: r["reasons"] for r in rej.collect()}
    assert reasons[2] == ["bad status: ok"] and reasons[3] == ["unexpected keys: host"]
    assert reasons[4] == ["missing keys: status"] and reasons[5] == ["not a JSON object"]


def test_strict_json(spark):
    cases = ['{"a": 1}', '{"a":1}x', "{'a': 1}", "[1]", "1, 2", "1],[2", '"s"', "", "{\"a\": 1, \"a\": 2}", "null"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(tk.strict_json("s")).collect()]
    assert got == [True, False, False, True, False, False, True, False, False, True]


def test_lax_numbers_in_checks(spark, tmp_dir):
    checks = [{"type": "node_exists", "node_name": "a", "timeout_sec": "2.5"},
              {"type": "topic_published", "topic": "/a", "min_count": 3.0},
              {"type": "topic_published", "topic": "/a", "min_count": "x"},
              {"type": "node_exists", "node_name": "a", "timeout_sec": 7}]
    p = os.path.join(tmp_dir, "lax.jsonl")
    with open(p, "w") as f:
        f.write(task("lax", test_oracle={"checks": checks}) + "\n")
    tasks, errors = tk.load_tasks(spark, p)
    assert errors.count() == 0
    ex = tk.explode_checks(tasks).orderBy("check_pos").collect()
    assert [r["kind"] for r in ex] == ["node_exists", "topic_published", "unknown", "node_exists"]
    assert ex[0]["timeout_sec"] == 2.5 and ex[1]["min_count"] == 3 and ex[3]["timeout_sec"] == 7.0


def test_nested_contracts(spark):
    ok_exec = {"status": "OK", "exit_code": 0}
    good = {"task_id": "t", "candidate_idx": 0, "overall_pass": True,
            "methods": [{"method": "ruff", "passed": True, "execution": ok_exec}]}
    bad = {"task_id": "t", "candidate_idx": 1, "overall_pass": False,
           "methods": [{"method": "ruff", "passed": True, "execution": ok_exec},
                       {"method": "mypy", "passed": False, "execution": {"status": "OK", "host": "x"}}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad))], "id int, json string")
    ok, rej = tk.enforce_contract(df, "verification_result")
    assert [r["id"] for r in ok.collect()] == [1]
    reasons = rej.first()["reasons"]
    assert reasons == ["methods[1].bad method: mypy; methods[1].execution.unexpected keys: host"]


def test_require_task(spark, jsonl):
    tasks, _ = tk.load_tasks(spark, jsonl)
    assert json.loads(tk.require_task(tasks, "extra"))["task_id"] == "extra"
    with pytest.raises(KeyError):
        tk.require_task(tasks, "nope")


def test_duplicate_keys_follow_session_setting(spark, tmp_dir):
    p = os.path.join(tmp_dir, "dup.jsonl")
    line = task("dup")[:-1] + ', "entry_point": "Last"}'
    with open(p, "w") as f:
        f.write(line + "\n")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    try:
        tasks, errors = tk.load_tasks(spark, p)
        assert errors.count() == 0 and tasks.first()["entry_point"] == "Last"
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    _, errors = tk.load_tasks(spark, p)
    assert [r["status"] for r in errors.collect()] == ["malformed"]


def test_contract_types_and_variants(spark):
    cases = {"execution_result": [('{"status": "OK", "exit_code": "abc"}', False), ('{"status": "OK", "timed_out": [1]}', False),
                                  ('{"status": null}', False), ('{"status": "OK", "exit_code": null}', True),
                                  ('{"status": "OK", "exit_code": "5", "duration_ms": "1.5", "timed_out": "yes"}', True),
                                  ('{"status": "OK", "stdout": 1}', False), ('{"status": "OK", "exit_code": 1.5}', False)],
             "verification_result": [('{"task_id": "t", "candidate_idx": 0}', True), ('{"task_id": "t"}', False),
                                     ('{"task_id": "t", "candidate_idx": 0, "methods": {}}', False),
                                     ('{"task_id": "t", "candidate_idx": 0, "methods": [null]}', False)],
             "method_result": [('{"method": "ruff", "passed": true, "execution": {"status": "OK"}, "findings": [{}]}', True),
                               ('{"method": "ruff", "passed": true, "execution": null}', False),
                               ('{"method": "ruff", "passed": 2, "execution": {"status": "OK"}}', False),
                               ('{"method": "ruff", "passed": true, "execution": {"status": "OK"}, "findings": [1]}', False)],
             "generation_result": [('{"provider": "p", "model": "m", "task_id": "t", "candidate_idx": 1, "text": "", "error": null}', True),
                                   ('{"provider": "p", "model": "m", "task_id": "t", "candidate_idx": 1, "text": null}', False)],
             "oracle_check": [('{"check_type": "node_exists", "node_name": "a"}', True),
                              ('{"check_type": "node_exists", "topic": "/a"}', False),
                              ('{"check_type": "topic_published", "topic": "/a"}', False),
                              ('{"check_type": "message_content", "topic": "/a", "field": "f", "expected": null}', True),
                              ('{"check_type": "parameter_declared", "node_name": "a", "param_name": "p"}', False),
                              ('{"node_name": "a"}', False), ('{"check_type": null}', False)]}
    for contract, rows in cases.items():
        df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "id int, json string")
        got = {r["id"]: r["reasons"] for r in tk.contract_reasons(df, contract).collect()}
        assert {i: not reasons for i, reasons in got.items()} == {i: ok for i, (_, ok) in enumerate(rows)}, (contract, got)


def test_contracts_are_checked_in_all_tasks(spark):
    """Records of one split are dealt to all tasks: the check is bound by the CPU."""
    df = spark.range(0, 64, 1, 1).select("id", F.when(F.col("id") % 2 == 0, '{"status": "OK"}').otherwise("nope").alias("json"))
    out = tk.contract_reasons(df, "execution_result")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["id"]: r["reasons"] for r in out.collect()} == {i: [] if i % 2 == 0 else ["not a JSON object"] for i in range(64)}

"""I1-I6 spec checks and J1-J7 code checks on the survey's fixture cases."""

import ast
import json

import pytest
from pyspark.sql import functions as F

from passforge.operators import code_checks as cc
from passforge.operators import spec_checks as sc
from passforge.plans.verify import verify

TOPICS = "task_id string, grp string, pos int, name string, type string, depth int"


def topics(spark, rows):
    return spark.createDataFrame(rows, TOPICS)


def test_spec_fixture_cases(spark):
    rows = [
        ("ok", "published", 0, "/a", "std_msgs/Int32", None), ("ok", "subscribed", 0, "/b", "std_msgs/String", None),
        ("dup", "published", 0, "/a", "std_msgs/Int32", None), ("dup", "published", 1, "/a", "std_msgs/Int32", None),
        ("qos", "published", 0, "/a", "std_msgs/Int32", 0),
        ("cross", "published", 0, "/a", "std_msgs/Int32", None), ("cross", "subscribed", 0, "/a", "std_msgs/Int32", None),
        ("twist", "published", 0, "/a", "geometry_msgs/Twist", None),
        ("noname", "published", 0, None, "std_msgs/Int32", None), ("noname", "published", 1, None, "std_msgs/Int32", None),
    ]
    t = topics(spark, rows)
    tasks = spark.createDataFrame([(r,) for r in ("ok", "dup", "qos", "cross", "twist", "noname", "empty")], "task_id string")
    folded = {(r["task_id"], r["method"]): r["passed"] for r in sc.fold_spec_methods(tasks, t).collect()}
    assert folded[("ok", "hypothesis")] == 1 and folded[("ok", "z3")] == 1
    assert folded[("dup", "hypothesis")] == 0 and folded[("dup", "z3")] == 0
    assert folded[("qos", "z3")] == 0 and folded[("qos", "hypothesis")] == 1
    assert folded[("cross", "hypothesis")] == 0 and folded[("cross", "z3")] == 1
    assert folded[("twist", "hypothesis")] == 1
    assert folded[("noname", "z3")] == 0 and folded[("noname", "hypothesis")] == 1
    assert folded[("empty", "hypothesis")] == 1 and folded[("empty", "z3")] == 1
    info = {r["task_id"]: r["n_info"] for r in sc.fold_spec_methods(tasks, t).where("method = 'hypothesis'").collect()}
    assert info["twist"] == 1 and info["ok"] == 0
    lists = {r["task_id"]: r["findings"] for r in sc.finding_lists(t).collect()}
    assert lists["dup"] == ['{"error":"duplicate topic names","names":["/a"]}']
    assert lists["twist"] == ['{"info":"unsupported_msg_types_for_mvp","types":["geometry_msgs/Twist"]}']
    q = [(r["task_id"], r["topic"]) for r in sc.qos_depth_violations(t).collect()]
    assert q == [("qos", "/a")]


FULL = """import rclpy
from std_msgs.msg import String

class Talker:
    def __init__(self, node):
        self.pub = node.create_publisher(String, 'chatter', 10)
        self.sub = node.create_subscription(String, 'in', self.listener_callback)
        self.pub2 = node.create_publisher(String, 'x', qos_profile=1)

    def listener_callback(self, msg):
        def inner():
            time.sleep(1)
        requests.get('u')

def timer():
    time.sleep(1)

def main(args=None):
    rclpy.init(args=args)
    node = Talker(None)
    node.destroy_node()
    rclpy.shutdown()
"""

CASES = [
    (1, ""),                                                        # empty module
    (2, FULL),                                                      # full lifecycle
    (3, "import rclpy\nrclpy.init()\nrclpy.shutdown()\nn.destroy_node()\nn.create_publisher(String, 't')\n"),
    (4, "def f(:\n"),
    (5, None),
    (6, "import rclpy\nrclpy.init()\nrclpy.shutdown()\n"),
    (7, "import rclpy\nrclpy.init()\nrclpy.shutdown()\nx.destroy_node()\nasync def on_callback():\n    time.sleep(1)\n"),
]


def test_lint_cases(spark):
    df = spark.createDataFrame(CASES, "code_id int, code string")
    got = {}
    for r in cc.lint(df).collect():
        got.setdefault(r["code_id"], []).append((r["rule"], r["line"]))
    assert sorted(got[1]) == [("W9001", 1), ("W9002", 1), ("W9003", 1)]
    assert sorted(got[2]) == [("W9010", 12), ("W9010", 13)]
    assert got[3] == [("W9020", 5)]
    assert got[4][0][0] == "E0001"
    assert 5 not in got
    assert got[6] == [("W9003", 1)]
    assert 7 not in got  # async callbacks are not tracked by default
    gate = {r["code_id"]: r["parses"] for r in cc.syntax_gate(df, ["code_id"]).collect()}
    assert gate == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True}


def test_lint_async_flag():
    rows = list(cc.lint_source(CASES[-1][1], include_async=True))
    assert [r[0] for r in rows] == ["W9010"]


def test_rule_frequency(spark):
    corpus = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate([("a", ""), ("a", FULL), ("b", ""), (None, "")])],
                                   "code_id int, model string, code string")
    freq = {(r["model"], r["rule"]): (r["n_with_rule"], r["n_candidates"]) for r in
            cc.rule_frequency(cc.lint(corpus), corpus, ["code_id"], ["model"]).collect()}
    assert freq[("a", "W9001")] == (1, 2) and freq[("a", "W9010")] == (1, 2) and freq[(None, "W9003")] == (1, 1)


def test_verify_plan(spark):
    iface = "struct<topics_published:array<struct<name:string,type:string,qos:struct<depth:int>>>," \
            "topics_subscribed:array<struct<name:string,type:string,qos:struct<depth:int>>>>"
    cands = spark.createDataFrame(
        [("t1", 0, FULL, ([("/a", "std_msgs/Int32", (0,))], [])), ("t2", 0, "def f(:\n", ([], []))],
        f"task_id string, candidate_idx int, code string, interface_spec {iface}")
    rows, verdicts, unknown = verify(cands, ["task_id", "candidate_idx"], ["ruff", "mypy", "pylint_ros", "z3"],
                                     required=["ruff", "z3"])
    assert unknown == ["mypy"]
    got = {(r["task_id"], r["method"]): (r["passed"], r["method_pos"]) for r in rows.collect()}
    assert got[("t1", "ruff")] == (1, 0) and got[("t1", "pylint_ros")] == (0, 1) and got[("t1", "z3")] == (0, 2)
    assert got[("t2", "ruff")] == (0, 0) and got[("t2", "z3")] == (1, 2)
    assert {r["task_id"]: r["overall_pass"] for r in verdicts.collect()} == {"t1": False, "t2": False}
    assert F is not None and pytest is not None


def test_verify_with_landed_test_logs(spark):
    from passforge.plans.verify import landed_test_check

    cands = spark.createDataFrame([("r1", FULL), ("r2", FULL), ("r3", FULL)], "run_id string, code string")
    logs = spark.createDataFrame([
        ("r1", 0, False, None, '<testsuite><testcase classname="c" name="ok"/></testsuite>'),
        ("r2", 1, False, None, '<testsuite><testcase classname="c" name="bad"><failure message="m"/></testcase></testsuite>'),
    ], "run_id string, exit_code int, timed_out boolean, launch_error string, junit_xml string")
    rows, verdicts, unknown = verify(cands, ["run_id"], ["ruff", "pytest"], registry={"pytest": landed_test_check(logs)})
    assert unknown == []
    got = {(r["run_id"], r["method"]): (r["passed"], r["status"], r["findings"]) for r in rows.collect()}
    assert got[("r1", "pytest")] == (1, "OK", []) and got[("r2", "pytest")] == (0, "FAIL", ['{"test":"c.bad","message":"m","text":""}'])
    assert got[("r3", "pytest")] == (0, "SKIPPED", [])
    assert {r["run_id"]: r["overall_pass"] for r in verdicts.collect()} == {"r1": True, "r2": False, "r3": False}


def test_crashed_check_does_not_pass(spark):
    deep = "x = " + "-" * 20000 + "1\n"          # the parser gives up
    long_sum = FULL + "\ny = " + " + ".join(["1"] * 3000) + "\n"  # deep tree, no recursion in the rules
    cands = spark.createDataFrame([("r1", deep), ("r2", long_sum), ("r3", None)], "run_id string, code string")
    rows, verdicts, _ = verify(cands, ["run_id"], ["ruff", "pylint_ros"], required=["ruff"])
    got = {(r["run_id"], r["method"]): (r["status"], r["passed"]) for r in rows.collect()}
    assert got == {("r1", "ruff"): ("CRASH", 0), ("r1", "pylint_ros"): ("CRASH", 0), ("r2", "ruff"): ("OK", 1),
                   ("r2", "pylint_ros"): ("FAIL", 0), ("r3", "ruff"): ("CRASH", 0), ("r3", "pylint_ros"): ("CRASH", 0)}
    assert {r["run_id"]: r["overall_pass"] for r in verdicts.collect()} == {"r1": False, "r2": True, "r3": False}


def test_spec_findings_are_stored(spark):
    iface = "struct<topics_published:array<struct<name:string,type:string,qos:struct<depth:int>>>," \
            "topics_subscribed:array<struct<name:string,type:string,qos:struct<depth:int>>>>"
    cands = spark.createDataFrame([("t1", FULL, ([("/a", "geometry_msgs/Twist", (0,)), ("/a", "std_msgs/Int32", None)],
                                                 [("/b", None, (-1,))]))],
                                  f"task_id string, code string, interface_spec {iface}")
    rows, _, _ = verify(cands, ["task_id"], ["hypothesis", "z3"])
    got = {r["method"]: [json.loads(f) for f in r["findings"]] for r in rows.collect()}
    assert got == {"hypothesis": [{"error": "duplicate topic names", "names": ["/a"]},
                                  {"info": "unsupported_msg_types_for_mvp", "types": ["geometry_msgs/Twist"]}],
                   "z3": [{"violation": "duplicate_publisher_topic"}, {"violation": "qos_depth_lt_1", "topic": "/a"},
                          {"violation": "qos_depth_lt_1", "topic": "/b"}]}


def test_custom_lint_rule(spark):
    def no_print(tree):
        for node in ast.walk(tree):
            if isinstance(node, ast.Call) and getattr(node.func, "id", "") == "print":
                yield node.lineno, "print call"
    df = spark.createDataFrame([(1, "\nprint(1)\n"), (2, "x = 1\n")], "code_id int, code string")
    got = cc.lint(df, rules=[], custom={"W9100": no_print}).collect()
    assert [(r["code_id"], r["rule"], r["line"], r["message"]) for r in got] == [(1, "W9100", 2, "print call")]


def test_lint_rule_registration(spark):
    df = spark.createDataFrame(CASES[:1], "code_id int, code string")
    assert sorted(r["rule"] for r in cc.lint(df, rules=["W9002"]).collect()) == ["W9002"]


def test_lint_crash_isolation(spark, monkeypatch):
    row = cc.LintCode()
    monkeypatch.setattr(cc, "lint_source", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("boom")))
    assert list(row.eval("x = 1")) == [("CRASH", "method-crashed", None, "method crashed: boom")]
    assert cc.lint_row(None) == []


def test_lint_udtf_in_sql(spark):
    spark.udtf.register("lint_code", cc.lint_udtf)
    spark.createDataFrame([(1, "")], "code_id int, code string").createOrReplaceTempView("lint_src")
    got = sorted(r["rule"] for r in spark.sql("SELECT f.rule FROM lint_src, LATERAL lint_code(code) f").collect())
    assert got == ["W9001", "W9002", "W9003"]


def test_lint_table_takes_its_rules_from_sql(spark):
    cc.register_sql(spark)
    code = "import rclpy\nclass A:\n    def timer_callback(self):\n        input()\n"
    spark.createDataFrame([(1, "x", code, None), (2, "y", "def broken(:", 5), (3, "z", None, 6)],
                          "id int, rule_set string, src string, extra long").createOrReplaceTempView("lint_me")
    rows = spark.sql("SELECT * FROM lint_table(TABLE(lint_me), 'src', array('W9010', 'E0001'))")
    assert rows.columns == ["id", "rule_set", "extra", "rule", "symbol", "line", "message"]
    assert sorted((r["id"], r["extra"], r["rule"], r["line"]) for r in rows.collect()) == [(1, None, "W9010", 4), (2, 5, "E0001", 1)]
    every = spark.sql("SELECT id, rule FROM lint_table(TABLE(lint_me), 'src')")
    table = cc.lint(spark.table("lint_me"), "src").select("id", "rule")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, table.collect()))
    for bad in ("array('W0000')", "array('E0001', 'nope')"):
        with pytest.raises(Exception, match="unknown rules"):
            spark.sql(f"SELECT * FROM lint_table(TABLE(lint_me), 'src', {bad})").collect()
    with pytest.raises(Exception, match="must name a column"):
        spark.sql("SELECT * FROM lint_table(TABLE(lint_me), 'nope')").collect()


def test_lint_passes_over_nodes_without_calls(monkeypatch):
    """Names, constants and operators are never visited; calls anywhere else are found."""
    seen = []
    monkeypatch.setattr(cc, "_inner_nodes", lambda node, f=cc._inner_nodes: seen.append(type(node).__name__) or f(node))
    assert [r for r, *_ in cc.lint_source("y = " + " + ".join(["a.b"] * 50))] == ["W9001", "W9002", "W9003"]
    assert seen.count("Attribute") == 50 and not {"Name", "Load", "Add", "Constant", "Store"} & set(seen)
    places = ["@d(input())\nclass A(B(input()), k=input()): pass", "x: t(input()) = [i for i in input() if input()]",
              "match input():\n    case P(a=1) if input(): input()", "with input() as q, input(): pass",
              "try: input()\nexcept E(input()): input()\nfinally: input()", "f'{input()!r:{input()}}'", "g = lambda z=input(): {**input()}"]
    body = "\n".join(places).replace("\n", "\n    ")
    got = [line for r, _, line, _ in cc.lint_source(f"def a_callback(v=input()):\n    {body}\n") if r == "W9010"]
    assert len(got) == sum(p.count("input()") for p in places) + 1


def test_lint_walk_skips_no_field_that_may_hold_nodes():
    """The fields that the walk passes over hold no expression, statement or list of them."""
    from passforge.operators import code_checks as cc

    leaves = ("expr_context", "operator", "cmpop", "boolop", "unaryop", "alias", "type_ignore", "str", "int", "object")
    for t in cc._INNER:
        assert set(cc._NODE_FIELDS[t]) | cc._PLAIN_FIELDS >= set(t._fields)
        skipped = {f: str(k) for f, k in getattr(t, "_field_types", {}).items() if f not in cc._NODE_FIELDS[t]}
        assert all(any(x in k for x in leaves) for f, k in skipped.items() if (t.__name__, f) != ("TypeAlias", "name")), skipped
    code = "type A = f()\nasync def callback():\n    with a(b=input()) as c, d[lambda: g()]:\n        rclpy.init(*[x for x in y])\n"
    seen = {cc._call_name(n.func) for n in _walk(cc, code) if type(n).__name__ == "Call"}
    assert seen == {"f", "a", "input", "g", "rclpy.init"}


def _walk(cc, code):
    import ast

    stack = [ast.parse(code)]
    while stack:
        node = stack.pop()
        yield node
        stack += cc._inner_nodes(node)

"""H2-H3, H6-H18, B5, J5 column expressions against Python references."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passforge.functions import status as s
from passforge.functions import text as tx
from passforge.sources import responses as rs

PY_FENCE = re.compile(r"```(?:python|py)?\s*\n(.*?)```", re.DOTALL | re.IGNORECASE)


def py_extract(text):
    m = PY_FENCE.search(text)
    return m.group(1).strip() if m else text.strip()


REPLIES = [
    "Sure!\n```python\nimport rclpy\nprint(1)\n```\nDone",
    "```py\nx = 1\n```",
    "```\nno tag\n```",
    "```PYTHON\nupper = True\n```",
    "no fence at all  ",
    "```python\nunclosed",
    "```bash\nls\n```\ntext\n```python\nreal = 1\n```",
    "```python\n```",
    "",
    "   \n\t padded \u2003\n",
    "```python   \n  spaced  \n```",
    "a\x1c```python\nb\x1f\n```",
    "```pythonic\nnot python\n```",
]


def test_extract_code_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(REPLIES)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", tx.extract_code("t").alias("c")).collect()}
    assert [got[i] for i in range(len(REPLIES))] == [py_extract(t) for t in REPLIES]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab `\n\tpyPYthon ")), max_size=40), min_size=1, max_size=8))
def test_extract_code_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.extract_code("t")).collect()]
    assert got == [py_extract(t) for t in texts]


def test_tokens_and_gate(spark):
    df = spark.createDataFrame([("", None, ""), ("abcdefghi", "", "x"), ("abc", "err", "y")], "t string, e string, c string")
    r = df.select(tx.estimate_tokens("t").alias("n"), tx.needs_verification("e", "c").alias("v"),
                  tx.stored_code("c").alias("s")).collect()
    assert [x["n"] for x in r] == [1, 2, 1]
    assert [x["v"] for x in r] == [False, True, False]
    assert r[0]["s"] is None


def test_verdict_codes(spark):
    rows = [(0, False, None), (1, False, None), (137, False, None), (0, True, None), (2, False, "api"),
            (5, False, None), (None, False, None), (33, False, None), (4, False, None)]
    df = spark.createDataFrame(rows, "rc int, to boolean, le string")
    sb = s.sandbox_status("rc", "to", "le")
    out = df.select(sb.alias("sb"), s.test_status("rc", sb).alias("t"), s.gate_status("rc").alias("g"),
                    s.lint_status("rc").alias("l")).collect()
    assert [r["sb"] for r in out] == ["OK", "FAIL", "OOM", "TIMEOUT", "CRASH", "FAIL", "FAIL", "FAIL", "FAIL"]
    assert [r["t"] for r in out] == ["OK", "FAIL", "OOM", "TIMEOUT", "CRASH", "FAIL", "CRASH", "CRASH", "CRASH"]
    assert [r["g"] for r in out] == ["OK", "FAIL", "CRASH", "OK", "CRASH", "CRASH", "CRASH", "CRASH", "CRASH"]
    assert [r["l"] for r in out] == ["OK", "FAIL", "FAIL", "OK", "FAIL", "FAIL", "CRASH", "CRASH", "FAIL"]
    resp = spark.createDataFrame([(429, None), (503, None), (400, None), (200, None), (200, "timeout"), (None, "connection")],
                                 "st int, k string")
    got = [r[0] for r in resp.select(s.classify_response("st", "k")).collect()]
    assert got == ["retryable", "retryable", "final", "ok", "retryable", "retryable"]


def test_decode_lossy_and_clip(spark):
    raw = "héllo wörld".encode() * 3
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    tail = df.select(tx.decode_lossy(tx.tail_bytes("b", 7)).alias("t")).first()["t"]
    assert tail == raw[-7:].decode("utf-8", errors="replace") or tail.endswith("wörld")
    full = df.select(tx.decode_lossy(tx.tail_bytes("b")).alias("t")).first()["t"]
    assert full == raw.decode()
    logs = spark.createDataFrame([("x" * 5000, None)], "stdout string, stderr string")
    r = tx.clip_logs(logs).first()
    assert len(r["stdout"]) == 4000 and r["stderr"] is None


def test_parse_findings(spark):
    df = spark.createDataFrame([("",), ("  ",), ("oops",), ("[]",), ('[{"code": "E1"}]',), ('{"a": 1}',)], "s string")
    got = [r[0] for r in df.select(F.size(rs.parse_findings("s"))).collect()]
    assert got == [0, 0, 0, 0, 1, 0]


def test_normalize_responses(spark):
    rows = [("openai", '{"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}'),
            ("anthropic", '{"content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}],'
                          ' "usage": {"input_tokens": 5, "output_tokens": 6}}'),
            ("ollama", '{"response": "r", "prompt_eval_count": 7}'),
            ("openai", '{"choices": []}')]
    df = rs.normalize_responses(spark.createDataFrame(rows, "provider string, body string"))
    got = [(r["text"], r["prompt_tokens"], r["completion_tokens"]) for r in df.collect()]
    assert got == [("hi", 3, 4), ("ab", 5, 6), ("r", 7, 0), ("", 0, 0)]


def test_junit_findings_both_layouts(spark):
    flat = ('<testsuite><testcase classname="c" name="ok"/><testcase name="bad"><failure message="m">trace</failure>'
            '<error message="e"/></testcase><testcase classname="k" name="err"><error message="boom">x</error>'
            '</testcase></testsuite>')
    nested = '<testsuites><testsuite><testcase classname="n" name="f"><failure>t</failure></testcase></testsuite></testsuites>'
    df = spark.createDataFrame([("a", flat), ("b", nested), ("c", "<testsuite><oops"), ("d", None)], "run_id string, xml string")
    out = [(r["run_id"], r["test"], r["message"], r["text"], r["error"])
           for r in rs.junit_findings(df).orderBy("run_id", "finding_pos").collect()]
    assert out == [("a", ".bad", "m", "trace", None), ("a", "k.err", "boom", "x", None), ("b", "n.f", "", "t", None),
                   ("c", None, None, None, "junit parse error")]


def test_assemble_program(spark):
    df = spark.createDataFrame([("class A:\n", "    pass\n", "A"), ("import rclpy\ndef main():\n", "", "B")],
                               "p string, b string, e string")
    out = [r[0] for r in df.select(tx.assemble_program("p", "b", "e")).collect()]
    assert out[0].startswith("import rclpy\nclass A:\n    pass\n") and "node = A()" in out[0]
    assert out[1] == "import rclpy\ndef main():\n"
    compile(out[0], "x", "exec")


@settings(max_examples=10, deadline=None)
@given(st.text(max_size=30), st.lists(st.text(max_size=8), max_size=3))
def test_render_prompt_never_fails(spark, prompt, concepts):
    df = spark.createDataFrame(
        [("t", prompt, "E", None, "Easy", concepts, ("n", [("/a", "std_msgs/Int32", None)], None))],
        "task_id string, prompt string, entry_point string, node_type string, difficulty string, "
        "concepts array<string>, iface struct<node_name:string, topics_published:array<struct<name:string,type:string,"
        "qos:struct<depth:int>>>, topics_subscribed:array<struct<name:string,type:string,qos:struct<depth:int>>>>")
    df = df.withColumn("iface", F.struct("iface.*", F.lit(None).cast("array<string>").alias("services_provided"),
                                         F.lit(None).cast("array<string>").alias("parameters")))
    out = df.select(tx.render_prompt("task_id", "prompt", "entry_point", "node_type", "difficulty", "concepts",
                                     "iface")).first()[0]
    assert out.endswith("\n") and not out.endswith("\n\n") and "`/a` (std_msgs/Int32)" in out
    assert tx.parse_ks(" 1, ,5") == [1, 5] and tx.parse_ks("") == [1, 5, 10]
    pytest.importorskip("math")


def test_junit_findings_any_depth(spark):
    deep = ('<?xml version="1.0"?><testsuites><testsuite name="a"><testsuite name="b">'
            '<testcase classname="x" name="one"><error message="E">e1</error></testcase></testsuite>'
            '<testcase classname="y" name="two"><failure message="F">f2</failure></testcase></testsuite>'
            '<testsuite/></testsuites>')
    bare = '<testcase classname="z" name="solo"><failure message="S"/></testcase>'
    unclosed = "<testsuites><testsuite>"
    df = spark.createDataFrame([("d", deep), ("b", bare), ("u", unclosed)], "run_id string, xml string")
    out = [(r["run_id"], r["test"], r["message"], r["error"])
           for r in rs.junit_findings(df).orderBy("run_id", "finding_pos").collect()]
    assert out == [("b", "z.solo", "S", None), ("d", "x.one", "E", None), ("d", "y.two", "F", None),
                   ("u", None, None, "junit parse error")]


def test_junit_findings_any_document(spark):
    case = '<testcase classname="c" name="n"><failure message="m">{}</failure></testcase>'
    docs = {"foreign": "<report><x/></report>", "wrapped": "<report><testsuite>" + case.format("t") + "</testsuite></report>",
            "doctype": '<!DOCTYPE testsuite><testsuite>' + case.format("t") + "</testsuite>",
            "cdata": "<testsuite>" + case.format("<![CDATA[<testsuite name='x'> ]]>") + "</testsuite>",
            "padded": "<testsuite>" + case.format("  t\n ") + "</testsuite>"}
    df = spark.createDataFrame(list(docs.items()), "run_id string, xml string")
    got = {r["run_id"]: (r["test"], r["text"], r["error"]) for r in rs.junit_findings(df).collect()}
    assert got == {"wrapped": ("c.n", "t", None), "doctype": ("c.n", "t", None),
                   "cdata": ("c.n", "<testsuite name='x'> ", None), "padded": ("c.n", "  t\n ", None)}


def test_strip_is_linear(spark):
    import time
    text = "a" + " " * 1_000_000 + "b\x1f "
    df = spark.createDataFrame([(text,)], "s string")
    t = time.time()
    assert df.select(tx.py_strip("s").alias("x")).first()["x"] == text.strip()
    assert time.time() - t < 10

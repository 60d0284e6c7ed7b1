"""Registered queries for the composed plans: A12, C6, D13, B6, H7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import verdicts as v
from ..operators import work as w
from ..schemas import METHODS
from ..sources.bindings import (method_rows_view, runs_view, sql_run_id, task_lines_view, tasks_meta_view,
                                with_views)
from ..sources import tasks as tk
from . import q_checks, q_metrics, q_sources  # noqa: F401  (the report frames share q_metrics' SQL)
from .catalog import ORACLE, query
from .report import report_tables
from .verify import lint_check, verify


@query("a12_report_by_model", with_views("""
select experiment_id, model, cast(count(*) as bigint) as n, cast(sum(overall_pass) as bigint) as passed,
  round(sum(overall_pass) / greatest(count(*), 1), 9) as pass_rate
from R group by experiment_id, model""", "R"))
def a12(spark, sf):
    tables = report_tables(runs_view(spark, sf), tasks_meta_view(spark, sf), persist=False)
    return tables["by_model"].select("experiment_id", "model", "n", "passed", F.round("pass_rate", 9).alias("pass_rate"))


def _report_frame(name: str, like: str, rounded: dict[str, int]) -> None:
    """Register another frame of the bundle; its SQL is that of the operator's own query."""
    @query(f"a12_report_{name}", ORACLE[like])
    def frame(spark, sf):
        df = report_tables(runs_view(spark, sf), tasks_meta_view(spark, sf), persist=False)[name]
        return df.select(*[F.round(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in df.columns])


_report_frame("by_difficulty", "d2_summarize_by_difficulty", {"pass_rate": 9})
_report_frame("by_node_type", "d3_summarize_by_node_type", {"pass_rate": 9})
_report_frame("pass_at_k_by_model", "d6_pass_at_k_by_model", {f"pass@{k}": 9 for k in (1, 5, 10)})
_report_frame("overall_pass_at_k", "d5_experiment_pass_at_k", {"pass_at_k": 9})
_report_frame("latency", "d7_latency_token_summary", {"mean_latency_ms": 6, "p95_latency_ms": 6})
_report_frame("model_difficulty", "d8_pass_rate_model_difficulty", {"pass_rate": 9})


@query("f2_report_order", with_views("""
select experiment_id, node_type, cast(row_number() over (order by experiment_id, node_type nulls last) - 1 as bigint) as pos
from (select distinct R.experiment_id, M.node_type from R left join M on R.task_id = M.task_id)""", "R", "M"))
def f2(spark, sf):
    """The place of each row in the frame as it is written: groups ascending, no metadata last."""
    frame = report_tables(runs_view(spark, sf), tasks_meta_view(spark, sf), persist=False)["by_node_type"]
    return frame.coalesce(1).select("experiment_id", "node_type", F.monotonically_increasing_id().alias("pos"))


ENABLED = ["ruff", "pytest", "mypy", "z3"]


@query("c6_resolve_methods", with_views("""
select run_id, method, case method when 'ruff' then 0 when 'pytest' then 1 when 'z3' then 2 end as method_pos, passed
from MR where method in ('ruff', 'pytest', 'z3')""", "MR"))
def c6(spark, sf):
    rows, unknown = w.resolve_methods(method_rows_view(spark, sf), ENABLED, METHODS)
    assert unknown == ["mypy"], unknown
    return rows.select("run_id", "method", "method_pos", "passed")


AUDIT_METHODS = ["ruff", "pylint_ros", "hypothesis", "z3", "mypy"]
AUDIT_REQUIRED = ["ruff", "z3"]


def _audit(spark, sf):
    tasks = tk.split_classified(tk.classify_task_lines(task_lines_view(spark, sf)))[0]
    cands = tasks.select("task_id", "interface_spec",
                         tx.assemble_program("prompt", "canonical_solution", "entry_point").alias("code"))
    rows, _, unknown = verify(cands, ["task_id"], AUDIT_METHODS, required=AUDIT_REQUIRED)
    return v.canonical_audit(rows, ["task_id"], required=AUDIT_REQUIRED)


_AUDIT_SQL = q_sources._STATUS_SQL + """,
  a as (select json_extract_string(js, '$.task_id') as task_id, p_size % 3 = 0 as z3_fails
        from (select * from cls where status = 'ok') c
        join part on json_extract_string(js, '$.task_id') = 'T' || cast(p_partkey as varchar))"""


@query("d13_canonical_audit", with_views(_AUDIT_SQL + """
select task_id, case when z3_fails then 'FAIL' else 'PASS' end as verdict,
  'ruff=OK  pylint_ros=OK  hypothesis=OK  z3=' || case when z3_fails then 'FAIL' else 'OK' end as methods
from a""", "J"))
def d13(spark, sf):
    per_task, _ = _audit(spark, sf)
    return per_task.select("task_id", "verdict", "methods")


@query("d13_audit_totals", with_views(_AUDIT_SQL + """
select cast(count(*) as bigint) as total, cast(count(*) filter (where not z3_fails) as bigint) as passed,
  cast(count(*) filter (where z3_fails) as bigint) as failures from a""", "J"))
def d13t(spark, sf):
    _, totals = _audit(spark, sf)
    return totals


@query("b6_failing_findings", """
select p_partkey as code_id, case p_size % 3 when 0 then 'W9020,W9010' else 'E0001' end as first_findings
from part where p_size % 3 <> 1""")
def b6(spark, sf):
    rows = lint_check(q_checks._programs(spark, sf), ["code_id"])
    rows = rows.withColumn("overall_pass", F.col("passed"))
    out = v.failing_findings(rows, n=3)
    rules = F.transform("first_findings", lambda f: F.get_json_object(f, "$.rule"))
    return out.select("code_id", F.array_join(rules, ",").alias("first_findings"))


def _system_text_sql() -> str:
    return tx.system_text().replace("'", "''").replace("\n", "' || chr(10) || '")


@query("h7_render_prompt", with_views(q_sources._STATUS_SQL + f""",
  ok as (select js from cls where status = 'ok'),
  f as (select json_extract_string(js, '$.task_id') as task_id, json_extract_string(js, '$.difficulty') as d,
          json_extract_string(js, '$.node_type') as nt, json_extract_string(js, '$.entry_point') as ep,
          json_extract_string(js, '$.prompt') as pr, json_extract_string(js, '$.interface_spec.node_name') as nn,
          json_extract_string(js, '$.interface_spec.topics_published[0].name') as pn,
          json_extract_string(js, '$.interface_spec.topics_published[0].type') as pt,
          json_extract_string(js, '$.interface_spec.topics_subscribed[0].name') as sn,
          json_extract_string(js, '$.interface_spec.topics_subscribed[0].type') as st,
          array_to_string(from_json(json_extract(js, '$.ros_concepts'), '["VARCHAR"]'), ', ') as rc from ok)
select task_id, md5('{_system_text_sql()}' || chr(10) || chr(10) || 'Task ' || task_id || ' (difficulty ' || d
  || ', node type ' || nt || ')' || chr(10) || chr(10) || 'ROS concepts: ' || rc || chr(10) || chr(10)
  || 'Entry point class: `' || ep || '`' || chr(10) || chr(10) || 'Interface:' || chr(10)
  || '- Node name: `' || nn || '`' || chr(10) || '- Publishes: `' || pn || '` (' || pt || ')' || chr(10)
  || '- Subscribes: `' || sn || '` (' || st || ')' || chr(10) || chr(10) || 'Complete this stub:' || chr(10)
  || '```python' || chr(10) || pr || chr(10) || '```' || chr(10) || chr(10)
  || 'Write the whole node, not only the body.' || chr(10)) as prompt_md5
from f""", "J"))
def h7(spark, sf):
    tasks = tk.split_classified(tk.classify_task_lines(task_lines_view(spark, sf)))[0]
    prompt = tx.render_prompt("task_id", "prompt", "entry_point", "node_type", "difficulty", "ros_concepts",
                              "interface_spec")
    return tasks.select("task_id", F.md5(prompt).alias("prompt_md5"))


# ---------------------------------------------------------------------------
# The write path: ingest landed responses into run-log rows. No test log is landed for these, so
# no candidate has the evidence of the required test method and none passes.
# ---------------------------------------------------------------------------
# Fixed values of the ingest binding: replies of conversation c answer task 'T' || c,
# candidate = turn, model = provider, latency = reply length, a conversation with a
# system turn failed ('provider error'), created_at 2024-01-01.

_INGEST_ID = sql_run_id("'exp-ingest'", "'T' || cast(conv_id as varchar)", "turn")


@query("a11_ingest_generations", f"""
select {_INGEST_ID} as run_id, 'T' || cast(conv_id as varchar) as task_id, cast(turn as integer) as candidate_idx,
  ['openai', 'anthropic', 'ollama'][conv_id % 3 + 1] as model, 0 as overall_pass,
  case when conv_id in (select conv_id from conversations where role = 'system') then 'provider error' end as gen_error,
  conv_id % 3 <> 1 and regexp_full_match(text, '\\s*') as code_is_null
from conversations where role = 'assistant'""")
def ingest(spark, sf):
    from ..sources.bindings import table
    from . import q_text
    from .experiment import ingest_generations

    raw = q_text._raw_responses(spark, sf)
    conv = table(spark, sf, "conversations")
    failed = conv.where(F.col("role") == "system").select("conv_id").distinct().withColumn("_f", F.lit(True))
    resp = raw.join(failed, "conv_id", "left").join(
        conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.length("text").alias("_len")),
        ["conv_id", "turn"]).select(
        F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("task_id"),
        F.col("turn").alias("candidate_idx"), "provider", F.col("provider").alias("model"), "body",
        F.col("_len").cast("double").alias("latency_ms"), F.col("turn").cast("int").alias("seed"),
        F.when(F.col("_f"), F.lit("provider error")).alias("error"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    tasks = tk.split_classified(tk.classify_task_lines(task_lines_view(spark, sf)))[0]
    runs, _ = ingest_generations("exp-ingest", resp, tasks)
    return runs.select("run_id", "task_id", "candidate_idx", "model", "overall_pass", "gen_error",
                       F.col("code").isNull().alias("code_is_null"))


# The same write path with replies of known bodies. Conversation c replies a
# good program (c % 3 = 0), a syntax error (1) or one that makes the parser give up (2);
# a test log exists unless c % 5 = 0, with exit code turn % 2.
_GOOD = "import rclpy\n\ndef main(args=None):\n    rclpy.init(args=args)\n    n.destroy_node()\n    rclpy.shutdown()\n"
_REPLIES = [_GOOD, "def broken(:\n", "x = " + "-" * 20000 + "1\n"]
_INGEST_SQL = """
with failed as (select distinct conv_id from conversations where role = 'system'),
c as (select 'T' || cast(conv_id as varchar) as task_id, cast(turn as integer) as candidate_idx, conv_id % 3 as body,
        conv_id % 5 <> 0 as has_log, turn % 2 as exit_code, conv_id in (select conv_id from failed) as gen_failed
      from conversations where role = 'assistant')"""


def _ingest_known(spark, sf):
    from ..sources.bindings import table
    from .experiment import ingest_generations

    conv = table(spark, sf, "conversations")
    failed = conv.where(F.col("role") == "system").select("conv_id").distinct().withColumn("_f", F.lit(True))
    c = conv.where(F.col("role") == "assistant").join(failed, "conv_id", "left")
    code = F.element_at(F.array(*[F.lit(b) for b in _REPLIES]), (F.col("conv_id") % 3 + 1).cast("int"))
    task = F.concat(F.lit("T"), F.col("conv_id").cast("string"))
    resp = c.select(task.alias("task_id"), F.col("turn").alias("candidate_idx"), F.lit("ollama").alias("provider"),
                    F.lit("m").alias("model"), F.to_json(F.struct(code.alias("response"))).alias("body"),
                    F.lit(1.0).alias("latency_ms"), F.col("turn").cast("int").alias("seed"),
                    F.when(F.col("_f"), F.lit("provider error")).alias("error"),
                    F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"))
    logs = c.where("conv_id % 5 <> 0").select(
        task.alias("task_id"), F.col("turn").alias("candidate_idx"), (F.col("turn") % 2).cast("int").alias("exit_code"),
        F.lit(False).alias("timed_out"), F.lit(None).cast("string").alias("launch_error"),
        F.when(F.col("turn") % 2 == 1, F.lit('<testsuite><testcase name="t"><failure message="m"/></testcase></testsuite>'))
        .alias("junit_xml"))
    tasks = tk.split_classified(tk.classify_task_lines(task_lines_view(spark, sf)))[0]
    return ingest_generations("exp-known", resp, tasks, logs=logs)


@query("a11_ingest_runs", _INGEST_SQL + """
select task_id, candidate_idx, case when not gen_failed and body = 0 and has_log and exit_code = 0 then 1 else 0 end as overall_pass,
  case when gen_failed then 'provider error' end as gen_error from c""")
def ingest_runs(spark, sf):
    return _ingest_known(spark, sf)[0].select("task_id", "candidate_idx", "overall_pass", "gen_error")


@query("a11_ingest_methods", _INGEST_SQL + """
, m as (select unnest(['ruff', 'pylint_ros', 'pytest', 'hypothesis']) as method)
select task_id, candidate_idx, method,
  case when method = 'pytest' then case when has_log and exit_code = 0 then 1 else 0 end
       when method = 'hypothesis' or body = 0 then 1 else 0 end as passed,
  case when method = 'pytest' then case when not has_log then 'SKIPPED' when exit_code = 0 then 'OK' else 'FAIL' end
       when method = 'hypothesis' or body = 0 then 'OK' when body = 1 then 'FAIL' else 'CRASH' end as status,
  case when method = 'pytest' and has_log then cast(exit_code as integer) end as exit_code,
  cast(case when method = 'pytest' then case when has_log and exit_code = 1 then 1 else 0 end
       when method = 'hypothesis' or body = 0 then 0 else 1 end as integer) as n_findings
from c, m where not gen_failed""")
def ingest_methods(spark, sf):
    runs, methods = _ingest_known(spark, sf)
    out = methods.join(runs.select("run_id", "task_id", "candidate_idx"), "run_id")
    return out.select("task_id", "candidate_idx", "method", "passed", "status", "exit_code",
                      F.size(F.from_json("findings_json", "array<string>")).alias("n_findings"))

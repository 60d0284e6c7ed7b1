"""Registered queries for task landing and tool-output verdicts: A1-A4, B1-B5, I5,
H9-H13, H16."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions import status as st
from ..functions import text as tx
from ..session import cut_lineage, remove_at_exit, scratch_path
from ..sources import tasks as tk
from ..sources.bindings import exec_log_view, table, task_lines_view, with_views
from .catalog import query

_STATUS_SQL = """
, s0 as (select line_no, trim(line) as s from J where trim(line) <> ''),
  s as (select line_no, s, case when json_valid(s) then s end as js from s0),
  cls as (select line_no, case when js is null then s else js end as s, case
      when js is null then 'malformed'
      when json_type(js) <> 'OBJECT' then 'not_object'
      when json_extract(js, '$.prompt') is null
        or json_extract_string(js, '$.difficulty') not in ('Easy', 'Medium', 'Hard', 'easy', 'medium', 'hard')
        or coalesce(json_type(js, '$.ros_concepts'), 'ARRAY') <> 'ARRAY' then 'invalid'
      else 'ok' end as status, js from s)"""


def _oracle(sql: str) -> str:
    return with_views(_STATUS_SQL + sql, "J")


def _classified(spark, sf, materialize=True):
    # Queries that read the classified lines once without filtering skip the checkpoint.
    return tk.classify_task_lines(task_lines_view(spark, sf), materialize=materialize)


def _tasks(spark, sf, materialize=True):
    return tk.split_classified(_classified(spark, sf, materialize))[0]


@query("a1_task_line_status", _oracle("""
select line_no, status from cls"""))
def a1(spark, sf):
    return _classified(spark, sf, materialize=False).select("line_no", "status")


@query("a1_first_bad_record", _oracle("""
select line_no, left(s, 200) as raw, status from cls where status <> 'ok' order by line_no limit 1"""))
def a1_first(spark, sf):
    return tk.first_bad_record(_classified(spark, sf)).select("line_no", "raw", "status")


@contextmanager
def _small_splits(spark, size):
    """Read text in splits of ``size`` bytes, as a file of many gigabytes would be."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("e3_line_numbers", with_views("""
select cast(line_no as bigint) as line_no, md5(line) as line_md5 from J""", "J"))
def e3(spark, sf):
    """The J lines in one text file, read in many splits and numbered by them."""
    path = scratch_path(spark, "e3-lines")
    task_lines_view(spark, sf).coalesce(1).sortWithinPartitions("line_no").select("line").write.text(path)
    remove_at_exit(spark, path)
    with _small_splits(spark, "16384"):
        numbered = cut_lineage(tk.read_lines(spark, path))
    return numbered.select("line_no", F.md5("line").alias("line_md5"))


@query("a2_task_errors", _oracle("""
select line_no, left(s, 200) as raw, status from cls where status <> 'ok'"""))
def a2(spark, sf):
    _, errors = tk.split_classified(_classified(spark, sf))
    return errors.select("line_no", "raw", "status")


@query("b4_list_counts", _oracle("""
select cast(count(*) filter (where status = 'ok') as bigint) as shown,
  cast(count(*) filter (where status <> 'ok') as bigint) as skipped from cls"""))
def b4(spark, sf):
    _, counts = tk.list_tasks(_classified(spark, sf, materialize=False))
    return counts


@query("b4_list_tasks", _oracle("""
select json_extract_string(js, '$.task_id') as task_id, json_extract_string(js, '$.difficulty') as difficulty,
  json_extract_string(js, '$.node_type') as node_type, json_extract_string(js, '$.entry_point') as entry_point
from (select * from cls where status = 'ok')"""))
def b4l(spark, sf):
    listing, _ = tk.list_tasks(_classified(spark, sf))
    return listing.select("task_id", "difficulty", "node_type", "entry_point")


_CHECKS_SQL = """,
  ok as (select js as s from cls where status = 'ok'),
  c as (select json_extract_string(s, '$.task_id') as task_id, pos as check_pos,
          json_extract(s, '$.test_oracle.checks[' || cast(pos as varchar) || ']') as c
        from (select s, unnest(range(0, cast(json_array_length(s, '$.test_oracle.checks') as bigint))) as pos from ok)),
  k as (select task_id, check_pos, c, json_extract_string(c, '$.type') as type,
          case when json_extract_string(c, '$.type') = 'node_exists' and json_type(c, '$.node_name') = 'VARCHAR'
                 then 'node_exists'
               when json_extract_string(c, '$.type') in ('topic_published', 'topic_subscribed')
                    and json_type(c, '$.topic') = 'VARCHAR' then json_extract_string(c, '$.type')
               when json_extract_string(c, '$.type') = 'parameter_declared'
                    and json_type(c, '$.node_name') = 'VARCHAR' and json_type(c, '$.param_name') = 'VARCHAR'
                 then 'parameter_declared'
               else 'unknown' end as kind from c)"""


@query("a3_explode_checks", _oracle(_CHECKS_SQL + """
select task_id, cast(check_pos as integer) as check_pos, type, kind,
  case when kind in ('node_exists', 'topic_published', 'topic_subscribed') then cast(5.0 as double) end as timeout_sec,
  case when kind = 'topic_published' then 1 end as min_count
from k"""))
def a3(spark, sf):
    checks = tk.explode_checks(_tasks(spark, sf))
    return checks.select("task_id", "check_pos", "type", "kind", "timeout_sec", "min_count")


@query("i5_oracle_completeness", _oracle(_CHECKS_SQL + """
select task_id, cast(check_pos as integer) as check_pos, type,
  case when type = 'node_exists' then case when coalesce(json_extract_string(c, '$.node_name'), '') <> ''
                                       then 'PASS' else 'FAIL' end
       when type in ('topic_published', 'topic_subscribed')
         then case when coalesce(json_extract_string(c, '$.topic'), '') <> '' then 'PASS' else 'FAIL' end
       else 'XFAIL' end as status
from k"""))
def i5(spark, sf):
    checks = tk.explode_checks(_tasks(spark, sf))
    return tk.oracle_completeness(checks).select("task_id", "check_pos", "type", "status")


@query("b1_filter_tasks", _oracle("""
select json_extract_string(js, '$.task_id') as task_id, json_extract_string(js, '$.node_type') as node_type
from (select * from cls where status = 'ok') where lower(json_extract_string(js, '$.difficulty')) = 'medium'
  and json_extract_string(js, '$.node_type') = 'SMALL'"""))
def b1(spark, sf):
    out = tk.filter_tasks(_tasks(spark, sf, materialize=False), difficulty="MEDIUM", node_type="SMALL")
    return out.select("task_id", "node_type")


@query("b2_select_tasks", _oracle("""
select json_extract_string(js, '$.task_id') as task_id, line_no from (select * from cls where status = 'ok')
where json_extract_string(js, '$.task_id') in (
  select 'T' || cast(c_custkey as varchar) from customer where c_mktsegment = 'MACHINERY')"""))
def b2(spark, sf):
    ids = table(spark, sf, "customer").where(F.col("c_mktsegment") == "MACHINERY") \
        .select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("task_id"))
    return tk.select_tasks(_tasks(spark, sf, materialize=False), ids).select("task_id", "line_no")


@query("b3_get_task", _oracle("""
select json_extract_string(js, '$.task_id') as task_id, line_no, json_extract_string(js, '$.entry_point') as entry_point
from (select * from cls where status = 'ok') where json_extract_string(js, '$.task_id') = 'T1'"""))
def b3(spark, sf):
    hit = tk.find_task(task_lines_view(spark, sf), "T1")
    return hit.select("task_id", "line_no", F.get_json_object("json", "$.entry_point").alias("entry_point"))


# ---------------------------------------------------------------------------
# Execution log verdicts
# ---------------------------------------------------------------------------

_H9 = """case when launch_error is not null then 'CRASH' when timed_out then 'TIMEOUT' when exit_code = 137 then 'OOM'
  when exit_code = 0 then 'OK' else 'FAIL' end"""


@query("h9_sandbox_status", with_views(f"""
select event_id, {_H9} as status from X""", "X"))
def h9(spark, sf):
    x = exec_log_view(spark, sf)
    return x.select("event_id", st.sandbox_status("exit_code", "timed_out", "launch_error").alias("status"))


@query("h10_test_status", with_views(f"""
select event_id, status, cast(status = 'OK' as integer) as passed from (
  select event_id, case when sb = 'TIMEOUT' then 'TIMEOUT' when sb = 'OOM' then 'OOM' when exit_code = 0 then 'OK'
    when exit_code in (1, 5) then 'FAIL' else 'CRASH' end as status
  from (select *, {_H9} as sb from X))""", "X"))
def h10(spark, sf):
    x = exec_log_view(spark, sf)
    sb = st.sandbox_status("exit_code", "timed_out", "launch_error")
    return x.select("event_id", st.test_status("exit_code", sb).alias("status"),
                    st.test_passed("exit_code", sb).cast("int").alias("passed"))


@query("h11_gate_status", with_views("""
select event_id, case when exit_code = 0 then 'OK' when exit_code = 1 then 'FAIL' else 'CRASH' end as status
from X""", "X"))
def h11(spark, sf):
    return exec_log_view(spark, sf).select("event_id", st.gate_status("exit_code").alias("status"))


@query("h12_lint_status", with_views("""
select event_id, case when exit_code is null then 'CRASH' when exit_code = 0 then 'OK'
  when (exit_code & 32) <> 0 then 'CRASH' else 'FAIL' end as status from X""", "X"))
def h12(spark, sf):
    return exec_log_view(spark, sf).select("event_id", st.lint_status("exit_code").alias("status"))


@query("h16_classify_response", with_views("""
select event_id, case when http_status = 429 or (http_status >= 500 and http_status < 600)
    or error_kind in ('rate_limit', 'timeout', 'connection') then 'retryable'
  when error_kind is null and http_status >= 200 and http_status < 300 then 'ok' else 'final' end as outcome
from X""", "X"))
def h16(spark, sf):
    return exec_log_view(spark, sf).select(
        "event_id", st.classify_response("http_status", "error_kind").alias("outcome"))


@query("h13_decode_lossy", with_views("""
select event_id, props as stdout, stderr_text as stderr from X""", "X"))
def h13(spark, sf):
    x = exec_log_view(spark, sf)
    return x.select("event_id", tx.decode_lossy(tx.tail_bytes("stdout")).alias("stdout"),
                    tx.decode_lossy(tx.tail_bytes("stderr")).alias("stderr"))


@query("b5_clip_logs", """
select doc_id, md5(substr(text, 1, 4000)) as stdout_md5, cast(length(substr(text, 1, 4000)) as integer) as stdout_len,
  md5(substr(text, 1, 1000)) as failure_md5, md5(substr(text, 1, 200)) as bad_line_md5,
  cast(octet_length(encode(text)) as bigint) as tail_bytes
from documents""")
def b5(spark, sf):
    d = table(spark, sf, "documents")
    tail = tx.tail_bytes(F.encode("text", "UTF-8"))
    return d.select(
        "doc_id",
        F.md5(tx.head_chars("text", tx.STDOUT_CHARS)).alias("stdout_md5"),
        F.length(tx.head_chars("text", tx.STDOUT_CHARS)).alias("stdout_len"),
        F.md5(tx.head_chars("text", tx.FAILURE_TEXT_CHARS)).alias("failure_md5"),
        F.md5(tx.head_chars("text", tx.BAD_LINE_CHARS)).alias("bad_line_md5"),
        F.octet_length(tail).cast("long").alias("tail_bytes"))


# ---------------------------------------------------------------------------
# A4 closed contracts over execution results
# ---------------------------------------------------------------------------
# Fixed values of the record binding: status from H9, lower-cased when k % 19 = 0
# (bad enum); an extra 'host' key when k % 13 = 0; no status key when k % 29 = 0.

def _exec_records(x):
    sb = st.sandbox_status("exit_code", "timed_out", "launch_error")
    k = F.col("k")
    status = F.when(k % 29 == 0, F.lit("")).otherwise(F.concat(
        F.lit('"status": "'), F.when(k % 19 == 0, F.lower(sb)).otherwise(sb), F.lit('", ')))
    extra = F.when(k % 13 == 0, F.lit(', "host": "w1"')).otherwise(F.lit(""))
    return x.select("event_id", F.concat(F.lit("{"), status, F.lit('"exit_code": '), F.col("exit_code").cast("string"),
                                         F.lit(', "timed_out": '), F.when(F.col("timed_out"), "true").otherwise("false"),
                                         extra, F.lit("}")).alias("json"))


@query("a4_enforce_contract", with_views(f"""
, r as (select event_id, k, {_H9} as sb from X),
  j as (select event_id, k, sb, case when k % 29 = 0 then null when k % 19 = 0 then lower(sb) else sb end as status,
          k % 13 = 0 as extra from r)
select event_id, cast(case when extra or status is null or status not in
    ('OK', 'FAIL', 'CRASH', 'TIMEOUT', 'OOM', 'SKIPPED') then 0 else 1 end as integer) as accepted,
  concat_ws('; ', case when extra then 'unexpected keys: host' end,
    case when status is null then 'missing keys: status' end,
    case when status is not null and status not in ('OK', 'FAIL', 'CRASH', 'TIMEOUT', 'OOM', 'SKIPPED')
         then 'bad status: ' || status end) as reasons
from j""", "X"))
def a4(spark, sf):
    checked = tk.contract_reasons(_exec_records(exec_log_view(spark, sf)), "execution_result")
    return checked.select("event_id", (F.size("reasons") == 0).cast("int").alias("accepted"),
                          F.array_join("reasons", "; ").alias("reasons"))


# Records of the other closed contracts and whether each is accepted; a part
# carries the record p_size % (number of cases).
_CONTRACT_CASES = [
    ("method_result", '{"method": "ruff", "passed": true, "execution": {"status": "OK"}}', 1),
    ("method_result", '{"method": "mypy", "passed": true, "execution": {"status": "OK"}}', 0),
    ("method_result", '{"method": "ruff", "passed": true, "execution": {"status": "OK", "host": "x"}}', 0),
    ("method_result", '{"method": "ruff", "passed": "maybe", "execution": {"status": "OK"}}', 0),
    ("verification_result", '{"task_id": "t", "candidate_idx": 0}', 1),
    ("verification_result", '{"task_id": "t", "candidate_idx": "x"}', 0),
    ("verification_result", '{"task_id": "t", "candidate_idx": 1, "methods": [{"method": "z3"}]}', 0),
    ("generation_result", '{"provider": "p", "model": "m", "task_id": "t", "candidate_idx": 1, "text": "", "seed": null}', 1),
    ("generation_result", '{"provider": "p", "model": "m", "task_id": "t", "candidate_idx": 1, "text": null}', 0),
    ("oracle_check", '{"check_type": "node_exists", "node_name": "a", "timeout_sec": "2.5"}', 1),
    ("oracle_check", '{"check_type": "node_exists", "topic": "/a"}', 0),
    ("oracle_check", '{"check_type": "parameter_declared", "node_name": "a"}', 0),
    ("oracle_check", '{"check_type": "service_called", "service": "s", "srv_type": "S"}', 1),
]


@query("a4_other_contracts", f"""
select p_partkey, contract, cast(accepted as integer) as accepted from part,
  (values {', '.join(f"({i}, '{c}', {ok})" for i, (c, _, ok) in enumerate(_CONTRACT_CASES))}) e(i, contract, accepted)
where p_size % {len(_CONTRACT_CASES)} = e.i""")
def a4_other(spark, sf):
    n = len(_CONTRACT_CASES)
    record = F.element_at(F.array(*[F.lit(j) for _, j, _ in _CONTRACT_CASES]), (F.col("p_size") % n + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(c) for c, _, _ in _CONTRACT_CASES]), (F.col("p_size") % n + 1).cast("int"))
    df = table(spark, sf, "part").select("p_partkey", record.alias("json"), name.alias("contract"))
    parts = [tk.contract_reasons(df.where(F.col("contract") == c), c) for c in sorted({c for c, _, _ in _CONTRACT_CASES})]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("p_partkey", "contract", (F.size("reasons") == 0).cast("int").alias("accepted"))

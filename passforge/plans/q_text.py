"""Registered queries for replies and responses: H2, H3, H6, H14, H15, H18, C5, C7, J5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import work as w
from ..sources import responses as rs
from ..sources.bindings import (exec_log_view, failed_calls_view, generations_view, table, with_views,
                                work_items_view)
from .catalog import query

_PY_CODE = r"""regexp_replace(case when regexp_matches(text, '```(?:python|py)?\s*\n(.*?)```', 'is')
   then regexp_extract(text, '```(?:python|py)?\s*\n(.*?)```', 1, 'is') else text end, '^\s+|\s+$', '', 'g')"""


@query("h2_extract_code", with_views(f"""
select task_id, pos, {_PY_CODE} as code from G""", "G"))
def h2(spark, sf):
    g = generations_view(spark, sf)
    return g.select("task_id", "pos", tx.extract_code("text").alias("code"))


@query("h3_estimate_tokens", with_views("""
select task_id, pos, cast(greatest(1, length(text) // 4) as integer) as est_tokens from G""", "G"))
def h3(spark, sf):
    g = generations_view(spark, sf)
    return g.select("task_id", "pos", tx.estimate_tokens("text").alias("est_tokens"))


@query("h18_needs_verification", with_views(f"""
, f as (select distinct cast(conv_id as varchar) as task_id from conversations where role = 'system'),
  c as (select G.task_id, pos, {_PY_CODE} as code,
          case when f.task_id is not null then 'provider error' end as error
        from G left join f on G.task_id = f.task_id)
select task_id, pos, cast((error is null or error = '') and code <> '' as integer) as verify,
  cast(nullif(code, '') is null as integer) as code_is_null from c""", "G"))
def h18(spark, sf):
    g = generations_view(spark, sf)
    fail = failed_calls_view(spark, sf).dropDuplicates(["task_id"])
    c = g.join(fail, "task_id", "left").select("task_id", "pos", tx.extract_code("text").alias("code"), "error")
    return c.select("task_id", "pos", tx.needs_verification("error", "code").cast("int").alias("verify"),
                    tx.stored_code("code").isNull().cast("int").alias("code_is_null"))


_PAIR_SQL = """
, items as (select cast(conv_id as varchar) as task_id, turn as candidate_idx,
              row_number() over (partition by conv_id order by turn) as p
            from conversations where role = 'user'),
  outs as (select task_id, pos, text, row_number() over (partition by task_id order by pos) as p from G)"""


@query("c5_pair_outputs", with_views(_PAIR_SQL + """
select i.task_id, i.candidate_idx, o.pos as out_pos from items i join outs o on i.task_id = o.task_id and i.p = o.p""",
    "G"))
def c5(spark, sf):
    paired = w.pair_outputs(work_items_view(spark, sf), generations_view(spark, sf))
    return paired.select("task_id", "candidate_idx", F.col("out_pos"))


@query("c7_complete_generations", with_views(_PAIR_SQL + """,
  f as (select distinct cast(conv_id as varchar) as task_id from conversations where role = 'system')
select i.task_id, i.candidate_idx, o.text, 0 as prompt_tokens, 0 as completion_tokens, cast(null as varchar) as error
from items i join outs o on i.task_id = o.task_id and i.p = o.p where i.task_id not in (select task_id from f)
union all
select i.task_id, i.candidate_idx, '' as text, 0, 0, 'provider error' from items i where i.task_id in (select task_id from f)
""", "G"))
def c7(spark, sf):
    out = w.complete_generations(work_items_view(spark, sf), generations_view(spark, sf), failed_calls_view(spark, sf))
    return out.select("task_id", "candidate_idx", "text", "prompt_tokens", "completion_tokens", "error")


# ---------------------------------------------------------------------------
# H15 / H14 response bodies
# ---------------------------------------------------------------------------
# Fixed values of the response binding: provider by conv_id % 3 (0 openai, 1 anthropic,
# 2 ollama); prompt tokens = turn * 10 + 3; completion tokens = length(text) div 4; no
# usage counts when conv_id % 7 = 0; anthropic replies carry a tool block and a closing
# ' (end)' text block after the reply text.

def _raw_responses(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    provider = F.element_at(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("ollama")),
                            (F.col("conv_id") % 3 + 1).cast("int"))
    pt, ct = (F.col("turn") * 10 + 3).cast("int"), F.floor(F.length("text") / 4).cast("int")
    has = F.col("conv_id") % 7 != 0
    openai = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"),
        F.when(has, F.struct(pt.alias("prompt_tokens"), ct.alias("completion_tokens"))).alias("usage")))
    anthropic = F.to_json(F.struct(
        F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
                F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text")),
                F.struct(F.lit("text").alias("type"), F.lit(" (end)").alias("text"))).alias("content"),
        F.when(has, F.struct(pt.alias("input_tokens"), ct.alias("output_tokens"))).alias("usage")))
    ollama = F.to_json(F.struct(F.col("text").alias("response"),
                                F.when(has, pt).alias("prompt_eval_count"), F.when(has, ct).alias("eval_count")))
    body = F.when(provider == "openai", openai).when(provider == "anthropic", anthropic).otherwise(ollama)
    return c.select("conv_id", "turn", provider.alias("provider"), body.alias("body"))


@query("h15_normalize_responses", """
select conv_id, turn, ['openai', 'anthropic', 'ollama'][conv_id % 3 + 1] as provider,
  case when conv_id % 3 = 1 then text || ' (end)' else text end as text,
  cast(case when conv_id % 7 <> 0 then turn * 10 + 3 else 0 end as integer) as prompt_tokens,
  cast(case when conv_id % 7 <> 0 then length(text) // 4 else 0 end as integer) as completion_tokens
from conversations where role = 'assistant'""")
def h15(spark, sf):
    out = rs.normalize_responses(_raw_responses(spark, sf))
    return out.select("conv_id", "turn", "provider", "text", "prompt_tokens", "completion_tokens")


@query("h14_join_text_blocks", """
select conv_id, turn, replace(text, chr(10), '') as joined from conversations where role = 'assistant'""")
def h14(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    blocks = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text")))
    blocks = F.concat(blocks, F.array(F.struct(F.lit("image").alias("type"), F.lit("ignored").alias("text"))))
    return c.select("conv_id", "turn", tx.join_text_blocks(blocks).alias("joined"))


# ---------------------------------------------------------------------------
# H6 tool JSON findings, J5 test reports
# ---------------------------------------------------------------------------
# Fixed values of the lint-output binding (by k = events.props.k): k % 5 = 0 blank,
# 1 not JSON, 2 an empty list, otherwise two findings W<k> (line k % 40) and E1 (line 1).

def _lint_stdout(x):
    k = F.col("k")
    two = F.concat(F.lit('[{"code": "W'), k.cast("string"), F.lit('", "line": '), (k % 40).cast("string"),
                   F.lit('}, {"code": "E1", "line": 1}]'))
    return F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("not json")).when(k % 5 == 2, F.lit("[]")) \
        .otherwise(two)


@query("h6_parse_findings", with_views("""
select event_id, cast(case when k % 5 in (0, 1, 2) then 0 else 2 end as integer) as n_findings,
  case when k % 5 in (0, 1, 2) then null else 'W' || cast(k as varchar) end as first_code,
  case when k % 5 in (0, 1, 2) then null else k % 40 end as first_line
from X""", "X"))
def h6(spark, sf):
    x = exec_log_view(spark, sf)
    f = rs.parse_findings(_lint_stdout(x))
    first = F.get(f, 0)
    return x.select("event_id", F.size(f).alias("n_findings"),
                    F.try_variant_get(first, "$.code", "string").alias("first_code"),
                    F.try_variant_get(first, "$.line", "int").alias("first_line"))


# Fixed values of the test-report binding: one report per order, one test case per line
# item (name test_<linenumber>, class Suite<orderkey>); a line with l_discount >= 0.09
# fails (message 'assert <quantity>'), one with l_tax >= 0.08 errors; orders with
# o_orderstatus 'P' nest the suite under <testsuites>; orders whose key ends in 7 have
# a broken report.

def _reports(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    case = F.concat(
        F.lit('<testcase classname="Suite'), F.col("l_orderkey").cast("string"), F.lit('" name="test_'),
        F.col("l_linenumber").cast("string"), F.lit('">'),
        F.when(F.col("l_discount") >= F.lit(0.09), F.concat(
            F.lit('<failure message="assert '), F.col("l_quantity").cast("int").cast("string"), F.lit('">trace '),
            F.col("l_partkey").cast("string"), F.lit("</failure>"))).otherwise(F.lit("")),
        F.when(F.col("l_tax") >= F.lit(0.08), F.lit('<error message="setup">boom</error>')).otherwise(F.lit("")),
        F.lit("</testcase>"))
    per = li.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_suppkey", "l_partkey", case.alias("x"))))["x"], "").alias("cases"))
    j = per.join(o, per.l_orderkey == o.o_orderkey)
    suite = F.concat(F.lit('<testsuite name="s">'), F.col("cases"), F.lit("</testsuite>"))
    xml = (F.when(F.col("l_orderkey") % 10 == 7, F.concat(F.lit("<testsuite><testcase"), F.col("cases")))
           .when(F.col("o_orderstatus") == "P", F.concat(F.lit("<testsuites>"), suite, F.lit("</testsuites>")))
           .otherwise(suite))
    return j.select(F.col("l_orderkey").cast("string").alias("run_id"), xml.alias("xml"))


@query("j5_junit_findings", """
with li as (select * from lineitem where l_orderkey in (select o_orderkey from orders))
select cast(l_orderkey as varchar) as run_id, 'Suite' || cast(l_orderkey as varchar) || '.test_'
    || cast(l_linenumber as varchar) as test,
  case when l_discount >= cast(0.09 as double) then 'assert ' || cast(cast(l_quantity as integer) as varchar) else 'setup' end
    as message,
  case when l_discount >= cast(0.09 as double) then 'trace ' || cast(l_partkey as varchar) else 'boom' end as text,
  cast(null as varchar) as error
from li where l_orderkey % 10 <> 7 and (l_discount >= cast(0.09 as double) or l_tax >= cast(0.08 as double))
union all
select distinct cast(l_orderkey as varchar), null, null, null, 'junit parse error' from li where l_orderkey % 10 = 7""")
def j5(spark, sf):
    out = rs.junit_findings(_reports(spark, sf))
    return out.select("run_id", "test", "message", "text", "error")


# Bytes that are no UTF-8, and logs longer than the kept tail.
@query("h13_bad_bytes", """
select event_id, event_type || chr(65533) || 'ok' || chr(65533) as text from events""")
def h13_bad(spark, sf):
    ev = table(spark, sf, "events")
    raw = F.concat(F.encode("event_type", "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("ok"), "UTF-8"), F.unhex(F.lit("C3")))
    return ev.select("event_id", tx.decode_lossy(raw).alias("text"))


@query("b5_tail_bytes", """
select event_id, right(props, 6) as tail, left(props, 4) as head from events""")
def b5_tail(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", tx.tail_bytes(F.encode("props", "UTF-8"), 6).cast("string").alias("tail"),
                     tx.head_chars("props", 4).alias("head"))

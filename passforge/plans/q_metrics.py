"""Registered metric queries over the runs (R) and tasks_meta (M) bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..sources.bindings import runs_view, sql_pass_at_k, tasks_meta_view, with_views
from .catalog import query

KS = (1, 5, 10)


def _r9(c):
    return F.round(F.col(c), 9).alias(c)


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _passk_sql(n="n", c="c"):
    return ", ".join(f'round(avg({sql_pass_at_k(n, c, k)}), 9) as "pass@{k}"' for k in KS)


@query("d1_summarize_by_model", with_views("""
select experiment_id, model, cast(count(*) as bigint) as n, cast(sum(overall_pass) as bigint) as passed,
  round(avg(latency_ms), 6) as mean_latency_ms, cast(sum(prompt_tokens) as bigint) as tokens_in,
  cast(sum(completion_tokens) as bigint) as tokens_out,
  round(sum(overall_pass) / greatest(count(*), 1), 9) as pass_rate
from R group by experiment_id, model""", "R"))
def d1(spark, sf):
    out = m.summarize_by_model(runs_view(spark, sf))
    return out.select("experiment_id", "model", "n", "passed", _r6("mean_latency_ms"),
                      "tokens_in", "tokens_out", _r9("pass_rate"))


_BY_DIM_SQL = """
select experiment_id, {dim}, cast(count(*) as bigint) as n, cast(sum(overall_pass) as bigint) as passed,
  round(sum(overall_pass) / greatest(count(*), 1), 9) as pass_rate
from R left join M on R.task_id = M.task_id group by experiment_id, {dim}"""


@query("d2_summarize_by_difficulty", with_views(_BY_DIM_SQL.format(dim="difficulty"), "R", "M"))
def d2(spark, sf):
    out = m.summarize_by_difficulty(runs_view(spark, sf), tasks_meta_view(spark, sf))
    return out.select("experiment_id", "difficulty", "n", "passed", _r9("pass_rate"))


@query("d3_summarize_by_node_type", with_views(_BY_DIM_SQL.format(dim="node_type"), "R", "M"))
def d3(spark, sf):
    out = m.summarize_by_node_type(runs_view(spark, sf), tasks_meta_view(spark, sf))
    return out.select("experiment_id", "node_type", "n", "passed", _r9("pass_rate"))


@query("d4_task_counts", with_views("""
select experiment_id, model, task_id, cast(count(*) as bigint) as n, cast(sum(overall_pass) as bigint) as c
from R group by experiment_id, model, task_id""", "R"))
def d4(spark, sf):
    return m.task_counts(runs_view(spark, sf), by=("experiment_id", "model"))


@query("d5_experiment_pass_at_k", with_views(f"""
, tc as (select experiment_id, task_id, count(*) as n, sum(overall_pass) as c from R group by experiment_id, task_id)
select experiment_id, k, round(avg({sql_pass_at_k('n', 'c', 'k')}), 9) as pass_at_k
from tc, (select unnest([{', '.join(map(str, KS))}]) as k) ks group by experiment_id, k""", "R"))
def d5(spark, sf):
    out = m.experiment_pass_at_k(runs_view(spark, sf), ks=KS)
    return out.select("experiment_id", "k", _r9("pass_at_k"))


@query("d6_pass_at_k_by_model", with_views(f"""
, tc as (select experiment_id, model, task_id, count(*) as n, sum(overall_pass) as c
         from R group by experiment_id, model, task_id)
select experiment_id, model, {_passk_sql()} from tc group by experiment_id, model""", "R"))
def d6(spark, sf):
    out = m.pass_at_k_by_model(runs_view(spark, sf), ks=KS)
    return out.select("experiment_id", "model", *[_r9(f"pass@{k}") for k in KS])


@query("d7_latency_token_summary", with_views("""
select experiment_id, round(avg(latency_ms), 6) as mean_latency_ms,
  round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms,
  cast(sum(prompt_tokens) as bigint) as tokens_in, cast(sum(completion_tokens) as bigint) as tokens_out
from R group by experiment_id""", "R"))
def d7(spark, sf):
    out = m.latency_token_summary(runs_view(spark, sf))
    return out.select("experiment_id", _r6("mean_latency_ms"), _r6("p95_latency_ms"), "tokens_in", "tokens_out")


@query("d8_pass_rate_model_difficulty", with_views("""
select experiment_id, model, difficulty, round(avg(overall_pass), 9) as pass_rate
from R left join M on R.task_id = M.task_id
where model is not null and difficulty is not null group by experiment_id, model, difficulty""", "R", "M"))
def d8(spark, sf):
    out = m.pass_rate_model_difficulty(runs_view(spark, sf), tasks_meta_view(spark, sf))
    return out.select("experiment_id", "model", "difficulty", _r9("pass_rate"))


DIFFICULTIES = ("Easy", "Medium", "Hard")


@query("d9_pass_rate_pivot", with_views("""
, d8 as (select experiment_id, model, difficulty, avg(overall_pass) as pass_rate
         from R left join M on R.task_id = M.task_id
         where model is not null and difficulty is not null group by experiment_id, model, difficulty)
select experiment_id, model,
  round(avg(pass_rate) filter (where difficulty = 'Easy'), 9) as "Easy",
  round(avg(pass_rate) filter (where difficulty = 'Medium'), 9) as "Medium",
  round(avg(pass_rate) filter (where difficulty = 'Hard'), 9) as "Hard"
from d8 group by experiment_id, model""", "R", "M"))
def d9(spark, sf):
    d8_ = m.pass_rate_model_difficulty(runs_view(spark, sf), tasks_meta_view(spark, sf))
    out = m.pass_rate_pivot(d8_, values=DIFFICULTIES)
    return out.select("experiment_id", "model", *[_r9(d) for d in DIFFICULTIES])


@query("d10_latency_histogram", with_views("""
, rng as (select experiment_id,
            case when min(latency_ms) = max(latency_ms) then min(latency_ms) - 0.5 else min(latency_ms) end as lo,
            case when min(latency_ms) = max(latency_ms) then max(latency_ms) + 0.5 else max(latency_ms) end as hi
          from R where latency_ms is not null group by experiment_id),
  cnt as (select R.experiment_id, least(cast(floor(20.0 * (latency_ms - lo) / (hi - lo)) as bigint) + 1, 20) as bin,
            count(*) as c
          from R join rng on R.experiment_id = rng.experiment_id where latency_ms is not null group by all),
  grid as (select experiment_id, lo, hi, unnest(range(1, 21)) as bin from rng)
select grid.experiment_id, cast(grid.bin as integer) as bin,
  round(lo + (grid.bin - 1) * ((hi - lo) / 20), 6) as bin_lo,
  round(case when grid.bin = 20 then hi else lo + grid.bin * ((hi - lo) / 20) end, 6) as bin_hi,
  cast(coalesce(c, 0) as bigint) as count
from grid left join cnt on grid.experiment_id = cnt.experiment_id and grid.bin = cnt.bin""", "R"))
def d10(spark, sf):
    out = m.latency_histogram(runs_view(spark, sf), bins=20)
    return out.select("experiment_id", "bin", _r6("bin_lo"), _r6("bin_hi"), "count")


@query("d11_experiment_status", with_views("""
select experiment_id, cast(count(*) as bigint) as total,
  cast(count(*) filter (where overall_pass <> 0) as bigint) as passed,
  round(count(*) filter (where overall_pass <> 0) / greatest(count(*), 1) * 100, 6) as pct_passed
from R group by experiment_id""", "R"))
def d11(spark, sf):
    out = m.experiment_status(runs_view(spark, sf))
    return out.select("experiment_id", "total", "passed", _r6("pct_passed"))


@query("d16_metrics_by_concept", with_views(f"""
, j as (select R.experiment_id, R.task_id, R.overall_pass, M.ros_concepts from R left join M on R.task_id = M.task_id),
  x as (select experiment_id, task_id, overall_pass,
          unnest(case when ros_concepts is null or len(ros_concepts) = 0 then [cast(null as varchar)]
                      else list_distinct(ros_concepts) end) as ros_concept from j),
  tc as (select experiment_id, ros_concept, task_id, count(*) as n, sum(overall_pass) as c
         from x group by experiment_id, ros_concept, task_id)
select experiment_id, ros_concept, cast(sum(n) as bigint) as n, cast(sum(c) as bigint) as passed,
  cast(count(*) as bigint) as n_tasks, {_passk_sql()}, round(sum(c) / greatest(sum(n), 1), 9) as pass_rate
from tc group by experiment_id, ros_concept""", "R", "M"))
def d16(spark, sf):
    out = m.metrics_by(runs_view(spark, sf), tasks_meta_view(spark, sf), dims=["ros_concept"], ks=KS)
    return out.select("experiment_id", "ros_concept", "n", "passed", "n_tasks",
                      *[_r9(f"pass@{k}") for k in KS], _r9("pass_rate"))


@query("d16_metrics_by_model_difficulty", with_views(f"""
, tc as (select experiment_id, model, difficulty, R.task_id, count(*) as n, sum(overall_pass) as c
         from R left join M on R.task_id = M.task_id group by experiment_id, model, difficulty, R.task_id)
select experiment_id, model, difficulty, cast(sum(n) as bigint) as n, cast(sum(c) as bigint) as passed,
  cast(count(*) as bigint) as n_tasks, {_passk_sql()}, round(sum(c) / greatest(sum(n), 1), 9) as pass_rate
from tc group by experiment_id, model, difficulty""", "R", "M"))
def d16b(spark, sf):
    out = m.metrics_by(runs_view(spark, sf), tasks_meta_view(spark, sf), dims=["model", "difficulty"], ks=KS)
    return out.select("experiment_id", "model", "difficulty", "n", "passed", "n_tasks",
                      *[_r9(f"pass@{k}") for k in KS], _r9("pass_rate"))


@query("c1_with_meta", with_views("""
select R.experiment_id, R.model, R.task_id, R.candidate_idx, R.overall_pass, M.difficulty, M.node_type,
  array_to_string(M.ros_concepts, ' ') as concepts
from R left join M on R.task_id = M.task_id""", "R", "M"))
def c1(spark, sf):
    out = m.with_meta(runs_view(spark, sf), tasks_meta_view(spark, sf))
    return out.select("experiment_id", "model", "task_id", "candidate_idx", "overall_pass", "difficulty",
                      "node_type", F.array_join("ros_concepts", " ").alias("concepts"))

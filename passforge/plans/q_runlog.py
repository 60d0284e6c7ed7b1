"""Registered queries for the run log, resume and verdicts: A5, A8-A10, C3, C4, D12,
D14, D15, E1, E2, H4, H5."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ids import config_hash
from ..operators import metrics as m
from ..operators import verdicts as v
from ..operators import work as w
from ..session import land, remove_at_exit, scratch_path
from ..sources import runlog as rl
from ..sources.bindings import (candidates_view, method_rows_view, run_log_children, run_log_view,
                                runs_view, sql_run_id, table, with_views)
from ..sources.tasks import read_lines, spread
from .catalog import query

N_CANDIDATES = 8
R_KEY = ("experiment_id", "model", "task_id")

_R_ID = sql_run_id("experiment_id", "model || ':' || task_id", "candidate_idx")


def _runs_with_ids(spark, sf):
    return runs_view(spark, sf, with_ids=True)


def _r_methods(runs):
    # Binding rule: runs without a generation error that passed or have an even candidate
    # index were verified and have a method row; the other error-free, failed runs crashed
    # during verification (and are retried on resume).
    verified = F.col("gen_error").isNull() & ((F.col("overall_pass") == 1) | (F.col("candidate_idx") % 2 == 0))
    return runs.where(verified).select("run_id", F.lit("pytest").alias("method"))


@query("a5_scan_runs", with_views("""
select experiment_id, model, task_id, candidate_idx, latency_ms, overall_pass, gen_error from R""", "R"))
def a5(spark, sf):
    return rl.scan_runs(runs_view(spark, sf)).select(
        "experiment_id", "model", "task_id", "candidate_idx", "latency_ms", "overall_pass", "gen_error")


@query("f1_export_order", with_views("""
select model || ':' || task_id as task_id, candidate_idx,
  cast(row_number() over (order by model || ':' || task_id, candidate_idx) as bigint) as pos
from R where experiment_id = 'F'""", "R"))
def f1(spark, sf):
    """The order of an ordered scan as its export holds it: lines numbered through all files in turn."""
    out = scratch_path(spark, "f1-export")
    runs = runs_view(spark, sf).withColumn("task_id", F.concat_ws(":", "model", "task_id"))
    rl.export_runs_csv(runs.select("experiment_id", "task_id", "candidate_idx"), out, experiment_id="F")
    remove_at_exit(spark, out)
    lines = read_lines(spark, out).where("line_no > 1")  # without the headers
    files = lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file_path")) - F.col("n")  # one row a file
    cells = F.split("line", ",")
    return lines.join(files.select("file_path", before.alias("before")), "file_path").select(
        cells[1].alias("task_id"), cells[2].cast("int").alias("candidate_idx"),
        (F.col("before") + F.col("line_no") - 1).cast("long").alias("pos"))


@query("h4_run_ids", with_views(f"""
select experiment_id, model, task_id, candidate_idx, {_R_ID} as run_id from R""", "R"))
def h4(spark, sf):
    return _runs_with_ids(spark, sf).select("experiment_id", "model", "task_id", "candidate_idx", "run_id")


_FIN_SQL = """
, fin as (select experiment_id, model, task_id, candidate_idx from R
          where overall_pass = 1 or gen_error is not null or candidate_idx % 2 = 0)"""


@query("c4_finished_keys", with_views(_FIN_SQL + """
select * from fin""", "R"))
def c4(spark, sf):
    runs = _runs_with_ids(spark, sf)
    return rl.finished_keys(runs, _r_methods(runs), key=("experiment_id", "model", "task_id", "candidate_idx"))


def _pending(spark, sf):
    # numbered once: the tasks, the runs and their method rows are read from files
    runs = land(_runs_with_ids(spark, sf).select(*R_KEY, "candidate_idx", "overall_pass", "gen_error", "run_id"), "runs")
    # both joins keep their left rows by a key that comes once: hashed, nothing is sorted
    done = rl.finished_keys(runs, _r_methods(runs).hint("shuffle_hash"), key=(*R_KEY, "candidate_idx")).hint("shuffle_hash")
    tasks = runs.select(*R_KEY).distinct()
    return tasks, w.pending_work(tasks, N_CANDIDATES, done, base_seed=0, keys=R_KEY)


_PENDING_SQL = _FIN_SQL + f"""
, tasks as (select distinct experiment_id, model, task_id from R),
  grid as (select experiment_id, model, task_id, cast(unnest(range(0, {N_CANDIDATES})) as integer) as candidate_idx
           from tasks),
  pend as (select g.* from grid g where not exists (
           select 1 from fin f where f.experiment_id = g.experiment_id and f.model = g.model
             and f.task_id = g.task_id and f.candidate_idx = g.candidate_idx))"""


@query("c3_pending_work", with_views(_PENDING_SQL + """
select experiment_id, model, task_id, candidate_idx, candidate_idx + 0 as seed from pend""", "R"))
def c3(spark, sf):
    _, pend = _pending(spark, sf)
    return pend.select(*R_KEY, "candidate_idx", "seed")


@query("d15_work_summary", with_views(_PENDING_SQL + f"""
select t.experiment_id, cast(t.k * {N_CANDIDATES} as bigint) as planned, cast(coalesce(p.k, 0) as bigint) as pending,
  cast(t.k * {N_CANDIDATES} - coalesce(p.k, 0) as bigint) as skipped
from (select experiment_id, count(*) as k from tasks group by experiment_id) t
left join (select experiment_id, count(*) as k from pend group by experiment_id) p
  on t.experiment_id = p.experiment_id""", "R"))
def d15(spark, sf):
    tasks, pend = _pending(spark, sf)
    return w.work_summary(tasks, N_CANDIDATES, pend, by=["experiment_id"])


@query("e2_assign_seeds", with_views(_PENDING_SQL + """
select experiment_id, model, task_id, candidate_idx, candidate_idx as planned_seed,
  cast(min(candidate_idx) over (partition by experiment_id, model, task_id)
       + row_number() over (partition by experiment_id, model, task_id order by candidate_idx) - 1 as integer)
    as recorded_seed
from pend""", "R"))
def e2(spark, sf):
    _, pend = _pending(spark, sf)
    out = w.assign_seeds(pend.drop("seed"), base_seed=0, keys=R_KEY)
    return out.select(*R_KEY, "candidate_idx", "planned_seed", "recorded_seed")


_RL_ID = sql_run_id("experiment_id", "task_id", "candidate_idx")


@query("a10_upsert_runs", with_views(f"""
select experiment_id, task_id, candidate_idx, ingest_seq, model, overall_pass, latency_ms, {_RL_ID} as run_id
from (select *, row_number() over (partition by experiment_id, task_id, candidate_idx order by ingest_seq desc) as rk
      from RL) where rk = 1""", "RL"))
def a10(spark, sf):
    cur = rl.upsert_runs(run_log_view(spark, sf))
    return cur.select("experiment_id", "task_id", "candidate_idx", "ingest_seq", "model", "overall_pass",
                      "latency_ms", "run_id")


@query("a10_current_methods", with_views(f"""
, cur as (select experiment_id, task_id, candidate_idx, max(ingest_seq) as ingest_seq from RL
          group by experiment_id, task_id, candidate_idx),
  kids as (select {_RL_ID} as run_id, ingest_seq, 'ruff' as method, overall_pass as passed from RL
           union all
           select {_RL_ID} as run_id, ingest_seq, 'pytest' as method,
                  case when l_tax < cast(0.04 as double) then 1 else 0 end as passed from RL)
select k.run_id, k.ingest_seq, k.method, k.passed from kids k
where exists (select 1 from cur c where {sql_run_id('c.experiment_id', 'c.task_id', 'c.candidate_idx')} = k.run_id
              and c.ingest_seq = k.ingest_seq)""", "RL"))
def a10m(spark, sf):
    # the attempts are numbered once: current runs and method rows both read them from files
    log = land(run_log_view(spark, sf).select(*rl.RUN_KEY, "ingest_seq", "run_id", "overall_pass", "l_tax"), "a10-attempts")
    cur = rl.upsert_runs(rl.with_row_address(log))
    return rl.current_methods(run_log_children(log), cur).select("run_id", "ingest_seq", "method", "passed")


_VERDICT_SQL = """
, ver as (select run_id,
            coalesce(bool_and(passed = 1) filter (where method in ('ruff', 'pytest')), false) as overall_pass
          from MR group by run_id),
  qual as (select run_id, count(*) filter (where passed <> 0) as n_passed, coalesce(avg(score), 0.0) as mean_score
           from MR group by run_id),
  cand as (select CD.task_id, CD.candidate_idx, CD.run_id, coalesce(ver.overall_pass, false) as overall_pass,
             coalesce(qual.n_passed, 0) as n_passed, coalesce(qual.mean_score, 0.0) as mean_score
           from CD left join ver on CD.run_id = ver.run_id left join qual on CD.run_id = qual.run_id)"""


@query("d12_overall_pass", with_views(_VERDICT_SQL + """
select run_id, cast(overall_pass as integer) as overall_pass from cand""", "MR", "CD"))
def d12(spark, sf):
    out = v.overall_pass(method_rows_view(spark, sf), candidates=candidates_view(spark, sf))
    return out.select("run_id", F.col("overall_pass").cast("int").alias("overall_pass"))


@query("d14_candidate_quality", with_views("""
select run_id, cast(count(*) filter (where passed <> 0) as bigint) as n_passed,
  round(coalesce(avg(score), 0.0), 9) as mean_score from MR group by run_id""", "MR"))
def d14(spark, sf):
    out = m.candidate_quality(method_rows_view(spark, sf))
    return out.select("run_id", "n_passed", F.round("mean_score", 9).alias("mean_score"))


@query("e1_select_best", with_views(_VERDICT_SQL + """
select task_id, candidate_idx, cast(overall_pass as integer) as overall_pass, cast(n_passed as bigint) as n_passed,
  round(mean_score, 9) as mean_score
from (select *, row_number() over (partition by task_id
        order by overall_pass desc, n_passed desc, mean_score desc, candidate_idx asc) as rk from cand)
where rk = 1""", "MR", "CD"))
def e1(spark, sf):
    full = v.candidate_summary(method_rows_view(spark, sf), candidates=candidates_view(spark, sf))
    best = v.select_best(full)
    return best.select("task_id", "candidate_idx", F.col("overall_pass").cast("int").alias("overall_pass"),
                       F.col("n_passed").cast("long").alias("n_passed"), F.round("mean_score", 9).alias("mean_score"))


# Fixed values of the config binding: unsorted keys, nesting, a number with a spare zero, one in
# exponent form and a name beyond ASCII; the SQL has the canonical text.
@query("h5_config_hash", r"""
select p_partkey, substr(sha256('{"A": 1e-05, "k": ' || cast(p_partkey as varchar) || ', "z": {"a": null, "b": ['
  || cast(p_size as varchar) || ', 2.5, "\u00e9\u6f22 ' || p_name || '"], "c": {}}}'), 1, 12) as config_hash
from part""")
def h5(spark, sf):
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_name"))
    cfg = F.concat(F.lit('{"z" :{"c":{}, "b":['), F.col("p_size").cast("string"), F.lit(',2.50,  "\u00e9漢 '), F.col("p_name"),
                   F.lit('"],"a":null},\n"k":'), F.col("p_partkey").cast("string"), F.lit(', "A": 1E-5}'))
    return p.select("p_partkey", config_hash(cfg).alias("config_hash"))


@query("e1_select_best_replayed", with_views(_VERDICT_SQL + """
, twice as (select * from cand union all select * from cand where candidate_idx % 3 = 0
            union all select task_id, candidate_idx, run_id, false, 0, 0.0 from cand where candidate_idx % 2 = 0)
select task_id, candidate_idx, cast(overall_pass as integer) as overall_pass, cast(n_passed as bigint) as n_passed,
  round(mean_score, 9) as mean_score
from (select *, row_number() over (partition by task_id
        order by overall_pass desc, n_passed desc, mean_score desc, candidate_idx asc) as rk from twice)
where rk = 1""", "MR", "CD"))
def e1_replayed(spark, sf):
    """Candidates that come again: every third as it is, every second without a verdict."""
    full = v.candidate_summary(method_rows_view(spark, sf), candidates=candidates_view(spark, sf))
    crashed = full.where(F.col("candidate_idx") % 2 == 0).select(
        "task_id", "candidate_idx", "run_id", F.lit(False).alias("overall_pass"),
        F.lit(0).cast("long").alias("n_passed"), F.lit(0.0).alias("mean_score"))
    best = v.select_best(full.unionByName(full.where(F.col("candidate_idx") % 3 == 0)).unionByName(crashed))
    return best.select("task_id", "candidate_idx", F.col("overall_pass").cast("int").alias("overall_pass"),
                       F.col("n_passed").cast("long").alias("n_passed"), F.round("mean_score", 9).alias("mean_score"))


@query("a10_current_runs", with_views(f"""
select experiment_id, task_id, candidate_idx, ingest_seq, model, overall_pass, {_RL_ID} as run_id,
  cast(json_extract(json_object('latency', latency_ms), '$.latency') as double) as latency
from (select *, row_number() over (partition by experiment_id, task_id, candidate_idx order by ingest_seq desc) as rk
      from RL) where rk = 1""", "RL"))
def a10_stored(spark, sf):
    """The stored log, a third of it appended twice, with a VARIANT payload."""
    path = scratch_path(spark, "a10-log")
    log = run_log_view(spark, sf).select(
        "experiment_id", "task_id", "candidate_idx", "ingest_seq", "model", "overall_pass", "run_id",
        F.parse_json(F.to_json(F.struct(F.col("latency_ms").alias("latency")))).alias("payload"))
    rl.write_append(log, path)
    again = spark.read.parquet(path).select(*log.columns)  # the attempts as they were written, not numbered anew
    rl.write_append(again.where(F.col("ingest_seq") % 3 == 1), path)
    remove_at_exit(spark, path)
    cur = rl.current_runs(spark, path)
    return cur.select("experiment_id", "task_id", "candidate_idx", "ingest_seq", "model", "overall_pass", "run_id",
                      F.variant_get("payload", "$.latency", "double").alias("latency"))


def _experiment_batch(spark, sf):
    o = table(spark, sf, "orders")
    cfg = F.concat(F.lit('{"priority": "'), F.col("o_orderpriority"), F.lit('"}'))
    return o.select(
        F.col("o_custkey").cast("string").alias("experiment_id"),
        config_hash(cfg).alias("config_hash"), cfg.alias("config_json"),
        F.col("o_orderdate").alias("started_at"), F.col("o_orderkey"), F.col("o_orderstatus"))


@query("a8_register_experiments", """
with batch as (select cast(o_custkey as varchar) as experiment_id,
                 '{"priority": "' || o_orderpriority || '"}' as config_json, o_orderdate as started_at, o_orderkey
               from orders where o_orderstatus <> 'F'),
     first as (select *, row_number() over (partition by experiment_id order by started_at, o_orderkey) as rk
               from batch)
select experiment_id, substr(sha256(config_json), 1, 12) as config_hash, config_json,
  cast(started_at as varchar) as started_at, o_orderkey
from first where rk = 1 and experiment_id not in (
  select cast(o_custkey as varchar) from orders where o_orderstatus = 'F')""")
def a8(spark, sf):
    batch = _experiment_batch(spark, sf)
    existing = batch.where(F.col("o_orderstatus") == "F").select("experiment_id")
    new = batch.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    out = rl.register_experiments(existing, new, order=("started_at", "o_orderkey"))
    return out.select("experiment_id", "config_hash", "config_json",
                      F.col("started_at").cast("string").alias("started_at"), "o_orderkey")


@query("a9_finalize_experiments", """
with ex as (select cast(o_custkey as varchar) as experiment_id,
              max(o_orderdate) filter (where o_orderstatus = 'F') as finished_at
            from orders group by o_custkey),
     ids as (select cast(c_custkey as varchar) as experiment_id from customer where c_mktsegment = 'BUILDING')
select experiment_id,
  cast(case when experiment_id in (select experiment_id from ids) then timestamp '2030-01-01 00:00:00'
            else finished_at end as varchar) as finished_at
from ex""")
def a9(spark, sf):
    o = table(spark, sf, "orders")
    ex = o.groupBy(F.col("o_custkey").cast("string").alias("experiment_id")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("finished_at"))
    ids = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").cast("string").alias("experiment_id"))
    out = rl.finalize_experiments(ex, ids, "2030-01-01 00:00:00")
    return out.select("experiment_id", F.col("finished_at").cast("string").alias("finished_at"))


@query("a11_append_method_results", with_views("""
select run_id, method, passed,
  cast(case when passed = 0 then to_json([method]) else '[]' end as varchar) as findings_json,
  sha256(run_id || chr(0) || method || chr(0) || case when passed = 0 then to_json([method]) else '[]' end) as id
from MR""", "MR"))
def a11(spark, sf):
    rows = method_rows_view(spark, sf).withColumn(
        "findings", F.when(F.col("passed") == 0, F.array(F.col("method"))))
    out = rl.append_method_results(rows)
    return out.select("run_id", "method", "passed", "findings_json", "id")


@query("a7_export_runs_csv", with_views("""
select experiment_id, model, task_id, candidate_idx, latency_ms, gen_error, overall_pass from R""", "R"))
def a7(spark, sf):
    cols = ["experiment_id", "model", "task_id", "candidate_idx", "latency_ms", "gen_error", "overall_pass"]
    out = scratch_path(spark, "a7-export")
    rl.export_runs_csv(runs_view(spark, sf).select(*cols), out)
    remove_at_exit(spark, out)
    schema = ("experiment_id string, model string, task_id string, candidate_idx int, latency_ms double, "
              "gen_error string, overall_pass int")
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(out)


def _store(spark, sf, buckets=0):
    """A database of the store in the shared folder, tables made twice (safe to repeat)."""
    root = scratch_path(spark, "store")
    db = os.path.basename(root).replace("-", "_")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{root}'")
    for _ in range(2):
        locs = rl.init_store(spark, root, database=db, buckets=buckets)
    remove_at_exit(spark, os.path.dirname(locs["runs"]))
    return db, locs


@query("a6_init_store", with_views("""
select run_id_key as run_id, experiment_id, task_id, candidate_idx, overall_pass from (
  select experiment_id, model || ':' || task_id as task_id, candidate_idx, overall_pass,
    experiment_id || '/' || model || ':' || task_id || '/' || cast(candidate_idx as varchar) as run_id_key from R)""",
    "R"))
def a6(spark, sf):
    db, locs = _store(spark, sf)
    runs = runs_view(spark, sf)
    rows = runs.select(
        F.concat_ws("/", "experiment_id", F.concat_ws(":", "model", "task_id"), F.col("candidate_idx").cast("string"))
        .alias("run_id"), "experiment_id", F.concat_ws(":", "model", "task_id").alias("task_id"), "candidate_idx",
        F.lit("driver").alias("provider"), "model", "prompt_tokens", "completion_tokens", "latency_ms",
        F.col("candidate_idx").alias("seed"), F.lit(None).cast("string").alias("code"), "gen_error", "overall_pass",
        "created_at", F.lit(0).cast("long").alias("ingest_seq"))
    target = spark.table(f"{db}.runs").columns
    rl.write_append(rows.select(*target), locs["runs"])
    spark.catalog.recoverPartitions(f"{db}.runs")
    return spark.table(f"{db}.runs").select("run_id", "experiment_id", "task_id", "candidate_idx", "overall_pass")


# Fixed values of the store binding: the RL log in a store of 8 buckets, more above 4,000,000 rows; experiments exp-1 and
# exp-3 have the config 'odd'. Method rows exist for attempts that passed or have an even candidate index.
_ODD_SQL = """
, cur as (select * from (select *, row_number() over (partition by experiment_id, task_id, candidate_idx
                                                      order by ingest_seq desc) as rk from RL) where rk = 1)"""


def _filled_store(spark, sf):
    buckets = rl.buckets_for(table(spark, sf, "lineitem").count())
    db, _ = _store(spark, sf, buckets=buckets)
    log = run_log_view(spark, sf)
    names = log.select("experiment_id").distinct()
    odd = F.substring("experiment_id", -1, 1).cast("int") % 2 == 1
    rl.append_rows(names.select("experiment_id", F.when(odd, F.lit("odd")).otherwise(F.lit("even")).alias("config_hash"),
                                F.lit("{}").alias("config_json"), F.lit("2024-01-01").cast("timestamp").alias("started_at")),
                   f"{db}.experiments")
    more = {"provider": F.lit("driver"), "created_at": F.lit("2024-01-01").cast("timestamp")}
    rl.append_rows(log.withColumns(more), f"{db}.runs", buckets)
    kids = run_log_children(log.where((F.col("overall_pass") == 1) | (F.col("candidate_idx") % 2 == 0)))
    rl.append_rows(kids.withColumn("id", rl.method_result_id("run_id", "method", "ingest_seq")), f"{db}.method_results", buckets)
    return spark.table(f"{db}.runs"), spark.table(f"{db}.method_results"), spark.table(f"{db}.experiments")


@query("a5_scan_experiments", with_views(f"""
select {_RL_ID} as run_id, experiment_id, task_id, candidate_idx, ingest_seq, overall_pass from RL
where experiment_id in ('exp-1', 'exp-3')""", "RL"))
def a5_experiments(spark, sf):
    runs, _, experiments = _filled_store(spark, sf)
    rows = rl.scan_experiments(runs, experiments.where("config_hash = 'odd'"))
    return rows.select("run_id", "experiment_id", "task_id", "candidate_idx", "ingest_seq", "overall_pass")


@query("c4_finished_in_store", with_views(_ODD_SQL + """
select experiment_id, task_id, candidate_idx from cur
where experiment_id in ('exp-1', 'exp-3') and (overall_pass = 1 or gen_error is not null or candidate_idx % 2 = 0)""", "RL"))
def c4_store(spark, sf):
    runs, methods, experiments = _filled_store(spark, sf)
    return rl.finished_in_store(runs, methods, experiments.where("config_hash = 'odd'"))


@query("a6_compact_changed", with_views(_ODD_SQL + """
select experiment_id, task_id, candidate_idx, ingest_seq, overall_pass from cur""", "RL"))
def a6_compact(spark, sf):
    """Compacted once, then again for the experiment that got further attempts in a second batch."""
    path, out = scratch_path(spark, "a6-log"), scratch_path(spark, "a6-current")
    log = run_log_view(spark, sf).select("experiment_id", "task_id", "candidate_idx", "ingest_seq", "overall_pass")
    late = (F.col("experiment_id") == "exp-0") & (F.col("ingest_seq") > 1)
    for batch, rows in enumerate((log.where(~late), log.where(late))):
        rl.write_append(rows, os.path.join(path, f"batch_id={batch}"))
        rl.compact_runs(spark, path, out, since=f"batch_id >= {batch}")
    remove_at_exit(spark, path)
    remove_at_exit(spark, out)
    return spark.read.parquet(out).select("experiment_id", "task_id", "candidate_idx", "ingest_seq", "overall_pass")

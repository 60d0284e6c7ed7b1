"""Bindings of the operators' input tables to the driver's parquet tables.

The operators take any DataFrame with the right columns. To exercise them on the
driver's data (and to let DuckDB check them) each input table is defined here twice:
once with the DataFrame API, once as DuckDB SQL (``SQL_VIEWS``) that the oracle
queries put in a WITH clause. Both sides must stay in step.

Fixed values of the bindings (ours, not the reference's):
  runs R: experiment = l_linestatus, model = l_returnflag, task = l_partkey,
          candidate_idx = position within (experiment, model, task) by all other columns,
          gen_error 'rate limited' when l_tax >= 0.08, pass when l_discount >= 0.05.
  tasks_meta M: parts whose name mentions 'anvil' have no metadata (NULL groups on join);
          difficulty Easy (p_size <= 16), Medium (<= 33), Hard; node_type = p_type;
          ros_concepts = words of p_name.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import run_id as run_id_expr
from .tasks import spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Order that makes lineitem rows unique (no exact duplicate rows in the table).
LINEITEM_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate",
                  "l_extendedprice", "l_quantity", "l_discount", "l_tax")

# Method names in the order the verification plan knows them.
METHOD_NAMES = ["ruff", "pylint_ros", "pytest", "hypothesis", "z3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# ---------------------------------------------------------------------------
# R: runs, M: tasks_meta
# ---------------------------------------------------------------------------

def runs_view(spark: SparkSession, sf_dir: str, with_ids: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_linestatus", "l_returnflag", "l_partkey").orderBy(*LINEITEM_ORDER)
    # numbered as they are; columns made before the window would be shuffled and sorted with it
    numbered = li.select("l_partkey", "l_returnflag", "l_linestatus", *LINEITEM_ORDER,
                         (F.row_number().over(w) - 1).cast("int").alias("candidate_idx"))
    df = numbered.select(
        F.col("l_linestatus").alias("experiment_id"),
        F.col("l_returnflag").alias("model"),
        F.col("l_partkey").cast("string").alias("task_id"),
        "candidate_idx",
        F.col("l_extendedprice").alias("latency_ms"),
        F.col("l_quantity").cast("int").alias("prompt_tokens"),
        (F.col("l_linenumber") * 10).cast("int").alias("completion_tokens"),
        F.when(F.col("l_tax") >= F.lit(0.08), F.lit("rate limited")).alias("gen_error"),
        F.when(F.col("l_discount") >= F.lit(0.05), 1).otherwise(0).alias("overall_pass"),
        F.col("l_shipdate").alias("created_at"),
    )
    if with_ids:
        df = df.withColumn("run_id", run_id_expr(
            "experiment_id", F.concat_ws(":", "model", "task_id"), "candidate_idx"))
    return df


def tasks_meta_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where(~F.col("p_name").contains("anvil")).select(
        F.col("p_partkey").cast("string").alias("task_id"),
        F.when(F.col("p_size") <= 16, "Easy").when(F.col("p_size") <= 33, "Medium")
        .otherwise("Hard").alias("difficulty"),
        F.col("p_type").alias("node_type"),
        F.split(F.col("p_name"), " ").alias("ros_concepts"),
    )


SQL_VIEWS: dict[str, str] = {}

SQL_VIEWS["R"] = """
select l_linestatus as experiment_id, l_returnflag as model, cast(l_partkey as varchar) as task_id,
  cast(row_number() over (partition by l_linestatus, l_returnflag, l_partkey
       order by l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
                l_discount, l_tax) - 1 as integer) as candidate_idx,
  l_extendedprice as latency_ms, cast(l_quantity as integer) as prompt_tokens,
  cast(l_linenumber * 10 as integer) as completion_tokens,
  case when l_tax >= cast(0.08 as double) then 'rate limited' end as gen_error,
  case when l_discount >= cast(0.05 as double) then 1 else 0 end as overall_pass,
  l_shipdate as created_at
from lineitem
"""

SQL_VIEWS["M"] = """
select cast(p_partkey as varchar) as task_id,
  case when p_size <= 16 then 'Easy' when p_size <= 33 then 'Medium' else 'Hard' end as difficulty,
  p_type as node_type, string_split(p_name, ' ') as ros_concepts
from part where p_name not like '%anvil%'
"""


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the WITH clause defining the named binding views."""
    ctes = ",\n".join(f"{n} as ({SQL_VIEWS[n]})" for n in names)
    return f"with {ctes}\n{sql}"


def sql_pass_at_k(n: str, c: str, k: int) -> str:
    """DuckDB pass@k by log-gamma, an independent formula from the Spark product."""
    return (f"(case when {n} <= 0 or {c} <= 0 then 0.0 when {c} >= {n} or {k} >= {n} then 1.0 "
            f"when {n} - {c} < {k} then 1.0 else 1 - exp(lgamma({n} - {c} + 1) + lgamma({n} - {k} + 1)"
            f" - lgamma({n} - {c} - {k} + 1) - lgamma({n} + 1)) end)")


# ---------------------------------------------------------------------------
# Run log with replays (A10), method rows per candidate (D12, D14, E1), candidates
# ---------------------------------------------------------------------------
# The run log key is (l_orderkey, l_linenumber), which repeats in
# lineitem; experiment = 'exp-' || (l_orderkey % 4); an attempt's ingest_seq is its
# position among the key's rows ordered by the remaining columns. Method rows: one per
# lineitem, candidate = l_orderkey, method = METHOD_NAMES[l_suppkey % 5],
# passed = l_discount >= 0.05, score = l_tax. Candidates: orders, task = o_custkey.

LOG_ORDER = ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def run_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LOG_ORDER)
    # numbered as they are; columns made before the window would be shuffled and sorted with it
    numbered = li.select("l_orderkey", "l_linenumber", *LOG_ORDER, F.row_number().over(w).cast("long").alias("ingest_seq"))
    df = numbered.select(
        F.concat(F.lit("exp-"), (F.col("l_orderkey") % 4).cast("string")).alias("experiment_id"),
        F.col("l_orderkey").cast("string").alias("task_id"),
        F.col("l_linenumber").alias("candidate_idx"),
        F.col("l_returnflag").alias("model"),
        F.col("l_extendedprice").alias("latency_ms"),
        F.when(F.col("l_discount") >= F.lit(0.05), 1).otherwise(0).alias("overall_pass"),
        F.when(F.col("l_tax") >= F.lit(0.08), F.lit("rate limited")).alias("gen_error"),
        F.col("l_tax"),
        "ingest_seq",
    )
    return df.withColumn("run_id", run_id_expr("experiment_id", "task_id", "candidate_idx"))


def run_log_children(log: DataFrame) -> DataFrame:
    """Two method rows per attempt: ruff passes when the run passed, pytest when tax < 0.04."""
    return log.select(
        "run_id", "ingest_seq", "experiment_id",
        F.explode(F.array(
            F.struct(F.lit("ruff").alias("method"), F.col("overall_pass").alias("passed")),
            F.struct(F.lit("pytest").alias("method"),
                     F.when(F.col("l_tax") < F.lit(0.04), 1).otherwise(0).alias("passed")),
        )).alias("m"),
    ).select("run_id", "ingest_seq", "experiment_id", "m.method", "m.passed")


def method_rows_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(m) for m in METHOD_NAMES])
    return li.select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.element_at(names, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("method"),
        F.when(F.col("l_discount") >= F.lit(0.05), 1).otherwise(0).alias("passed"),
        F.col("l_tax").alias("score"),
    )


def candidates_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("task_id"),
                    F.col("o_orderkey").alias("candidate_idx"),
                    F.col("o_orderkey").cast("string").alias("run_id"))


SQL_VIEWS["RL"] = """
select 'exp-' || cast(l_orderkey % 4 as varchar) as experiment_id, cast(l_orderkey as varchar) as task_id,
  l_linenumber as candidate_idx, l_returnflag as model, l_extendedprice as latency_ms,
  case when l_discount >= cast(0.05 as double) then 1 else 0 end as overall_pass,
  case when l_tax >= cast(0.08 as double) then 'rate limited' end as gen_error, l_tax,
  cast(row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate,
       l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as bigint) as ingest_seq
from lineitem
"""

SQL_VIEWS["MR"] = """
select cast(l_orderkey as varchar) as run_id,
  ['ruff', 'pylint_ros', 'pytest', 'hypothesis', 'z3'][cast(l_suppkey % 5 as integer) + 1] as method,
  case when l_discount >= cast(0.05 as double) then 1 else 0 end as passed, l_tax as score
from lineitem
"""

SQL_VIEWS["CD"] = """
select cast(o_custkey as varchar) as task_id, o_orderkey as candidate_idx, cast(o_orderkey as varchar) as run_id
from orders
"""


def sql_run_id(e: str, t: str, i: str) -> str:
    return f"({e} || '-' || substr(sha1({e} || chr(0) || {t} || chr(0) || cast({i} as varchar)), 1, 16))"


# ---------------------------------------------------------------------------
# J: JSON-lines task records (A1-A3, B1-B4, I5), X: execution log
# ---------------------------------------------------------------------------
# Fixed values of the J binding: one line per part, line number = p_partkey + 1.
#   difficulty Easy (p_size <= 16), medium (<= 33), EASY (p_size = 49, invalid), else Hard;
#   ros_concepts null (invalid) for 'old ...' parts with p_size <= 3; no prompt when p_partkey % 29 = 0;
#   an extra key when p_size = 7; second check kind by p_size % 4: topic_published,
#   topic_subscribed, parameter_declared, custom_probe.
#   Line damage by p_partkey: % 23 blank, % 17 cut to 40 chars, % 31 a JSON array,
#   % 37 trailing junk, % 41 single quotes, % 43 padded with spaces.

def _task_line_cols():
    k = F.col("p_partkey").cast("string")
    diff = (F.when(F.col("p_size") == 49, "EASY").when(F.col("p_size") <= 16, "Easy")
            .when(F.col("p_size") <= 33, "medium").otherwise("Hard"))
    concepts = F.when(F.col("p_name").startswith("old ") & (F.col("p_size") <= 3), F.lit("null")) \
        .otherwise(F.concat(F.lit('["'), F.array_join(F.split("p_name", " "), '", "'), F.lit('"]')))
    prompt = F.when(F.col("p_partkey") % 29 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"prompt": "class Node'), k, F.lit(':\\n    pass", ')))
    topic = F.concat(F.lit("/t"), (F.col("p_size") % 5).cast("string"))
    chk = F.element_at(F.array(*[F.lit(x) for x in ("topic_published", "topic_subscribed",
                                                     "parameter_declared", "custom_probe")]),
                       (F.col("p_size") % 4 + 1).cast("int"))
    extra = F.when(F.col("p_size") == 7, F.lit(', "owner": "qa"')).otherwise(F.lit(""))
    line = F.concat(
        F.lit('{"task_id": "T'), k, F.lit('", "node_type": "'), F.col("p_type"), F.lit('", "difficulty": "'), diff,
        F.lit('", "ros_concepts": '), concepts, F.lit(", "), prompt,
        F.lit('"entry_point": "Node'), k, F.lit('", "interface_spec": {"node_name": "node_'), k,
        F.lit('", "topics_published": [{"name": "'), topic, F.lit('", "type": "std_msgs/String", "qos": {"depth": '),
        (F.col("p_size") % 3).cast("string"), F.lit('}}], "topics_subscribed": [{"name": "/s'),
        (F.col("p_size") % 4).cast("string"), F.lit('", "type": "std_msgs/Int32"}]}, "test_oracle": {"checks": '
                                                     '[{"type": "node_exists", "node_name": "node_'),
        k, F.lit('"}, {"type": "'), chk, F.lit('", "topic": "'), topic, F.lit('"}]}'), extra, F.lit("}"))
    key = F.col("p_partkey")
    damaged = (F.when(key % 23 == 0, F.lit(""))
               .when(key % 17 == 0, F.substring(line, 1, 40))
               .when(key % 31 == 0, F.concat(F.lit("["), k, F.lit("]")))
               .when(key % 37 == 0, F.concat(line, F.lit(" x")))
               .when(key % 41 == 0, F.translate(line, '"', "'"))
               .when(key % 43 == 0, F.concat(F.lit("  "), line, F.lit("  ")))
               .otherwise(line))
    return (key + 1).alias("line_no"), damaged.alias("line")


def task_lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A part is short and its line costs something to make: parts of one split are dealt to all tasks first. Out of a
    # generator, so that a filter on the line is not pushed back into the task that reads the split.
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"))
    line_no, line = _task_line_cols()
    return part.select(line_no, F.explode(F.array(line)).alias("line"))


SQL_VIEWS["J"] = """
select p_partkey + 1 as line_no, case
  when p_partkey % 23 = 0 then ''
  when p_partkey % 17 = 0 then substr(line, 1, 40)
  when p_partkey % 31 = 0 then '[' || cast(p_partkey as varchar) || ']'
  when p_partkey % 37 = 0 then line || ' x'
  when p_partkey % 41 = 0 then replace(line, '"', '''')
  when p_partkey % 43 = 0 then '  ' || line || '  '
  else line end as line
from (select p_partkey,
  '{"task_id": "T' || cast(p_partkey as varchar) || '", "node_type": "' || p_type || '", "difficulty": "'
  || case when p_size = 49 then 'EASY' when p_size <= 16 then 'Easy' when p_size <= 33 then 'medium' else 'Hard' end
  || '", "ros_concepts": '
  || case when p_name like 'old %' and p_size <= 3 then 'null'
          else '["' || replace(p_name, ' ', '", "') || '"]' end
  || ', ' || case when p_partkey % 29 = 0 then '' else '"prompt": "class Node' || cast(p_partkey as varchar)
                                                      || ':\\n    pass", ' end
  || '"entry_point": "Node' || cast(p_partkey as varchar) || '", "interface_spec": {"node_name": "node_'
  || cast(p_partkey as varchar) || '", "topics_published": [{"name": "/t' || cast(p_size % 5 as varchar)
  || '", "type": "std_msgs/String", "qos": {"depth": ' || cast(p_size % 3 as varchar)
  || '}}], "topics_subscribed": [{"name": "/s' || cast(p_size % 4 as varchar)
  || '", "type": "std_msgs/Int32"}]}, "test_oracle": {"checks": [{"type": "node_exists", "node_name": "node_'
  || cast(p_partkey as varchar) || '"}, {"type": "'
  || ['topic_published', 'topic_subscribed', 'parameter_declared', 'custom_probe'][p_size % 4 + 1]
  || '", "topic": "/t' || cast(p_size % 5 as varchar) || '"}]}'
  || case when p_size = 7 then ', "owner": "qa"' else '' end || '}' as line
  from part)
"""

# Fixed values of the X binding: exit code by event type (view 0, click 1, signup 5,
# purchase 32, error 137); k = props.k; timed out when k % 10 = 0; a launch error for
# 'error' events with k % 7 = 0; HTTP status 429 when k % 9 = 0, 503 when k % 11 = 0,
# 400 when k % 13 = 0, else 200; error kind 'timeout' when k % 15 = 0, 'connection'
# when k % 16 = 0.

def exec_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    code = F.create_map(*[x for p in (("view", 0), ("click", 1), ("signup", 5), ("purchase", 32), ("error", 137))
                          for x in (F.lit(p[0]), F.lit(p[1]))])
    return ev.select(
        "event_id", "event_type", k.alias("k"),
        code[F.col("event_type")].alias("exit_code"),
        (k % 10 == 0).alias("timed_out"),
        F.when((F.col("event_type") == "error") & (k % 7 == 0), F.lit("docker API error")).alias("launch_error"),
        F.when(k % 9 == 0, 429).when(k % 11 == 0, 503).when(k % 13 == 0, 400).otherwise(200).alias("http_status"),
        F.when(k % 15 == 0, F.lit("timeout")).when(k % 16 == 0, F.lit("connection")).alias("error_kind"),
        F.col("props").cast("binary").alias("stdout"),
        F.col("event_type").cast("binary").alias("stderr"),
    )


SQL_VIEWS["X"] = """
select event_id, event_type, k,
  case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 5 when 'purchase' then 32
                  when 'error' then 137 end as exit_code,
  k % 10 = 0 as timed_out,
  case when event_type = 'error' and k % 7 = 0 then 'docker API error' end as launch_error,
  case when k % 9 = 0 then 429 when k % 11 = 0 then 503 when k % 13 = 0 then 400 else 200 end as http_status,
  case when k % 15 = 0 then 'timeout' when k % 16 = 0 then 'connection' end as error_kind,
  props, event_type as stderr_text
from (select *, cast(json_extract(props, '$.k') as integer) as k from events)
"""


# ---------------------------------------------------------------------------
# G: generations
# ---------------------------------------------------------------------------
# Fixed values of the G binding: assistant turns are model replies; replies of every
# third conversation are wrapped as prose + a python fence + prose; a conversation with
# a system turn is a failed generation call ('provider error'). Work items are the user
# turns (position = turn), outputs the assistant turns.
FENCE_OPEN = "Here is the node:\n```python\n"
FENCE_CLOSE = "\n```\nHope it helps."


def generations_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(FENCE_OPEN), F.col("text"), F.lit(FENCE_CLOSE))) \
        .otherwise(F.col("text"))
    return c.select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn").alias("pos"),
                    text.alias("text"))


def work_items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(F.col("conv_id").cast("string").alias("task_id"), F.col("turn").alias("candidate_idx"))


def failed_calls_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "system")
    return c.select(F.col("conv_id").cast("string").alias("task_id"), F.lit("provider error").alias("error"))


SQL_VIEWS["G"] = """
select cast(conv_id as varchar) as task_id, turn as pos,
  case when conv_id % 3 = 0 then 'Here is the node:' || chr(10) || '```python' || chr(10) || text || chr(10)
       || '```' || chr(10) || 'Hope it helps.' else text end as text
from conversations where role = 'assistant'
"""


# ---------------------------------------------------------------------------
# S: spec topics
# ---------------------------------------------------------------------------
# Fixed values of the S binding: task = l_orderkey; returnflag 'A' lines are published
# topics, others subscribed; position = l_linenumber; name = '/t' || (l_partkey % 20),
# missing when l_quantity >= 49; depth = l_linenumber - 1; message type by p_type:
# SMALL Int32, MEDIUM Float64, LARGE String, STANDARD Bool (std_msgs), else geometry_msgs/Twist.

def spec_topics_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    typ = (F.when(F.col("p_type") == "SMALL", "std_msgs/Int32").when(F.col("p_type") == "MEDIUM", "std_msgs/Float64")
           .when(F.col("p_type") == "LARGE", "std_msgs/String").when(F.col("p_type") == "STANDARD", "std_msgs/Bool")
           .otherwise("geometry_msgs/Twist"))
    j = li.join(part, li.l_partkey == part.p_partkey, "left")
    return j.select(
        F.col("l_orderkey").cast("string").alias("task_id"),
        F.when(F.col("l_returnflag") == "A", "published").otherwise("subscribed").alias("grp"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_quantity") >= F.lit(49.0), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("/t"), (F.col("l_partkey") % 20).cast("string"))).alias("name"),
        typ.alias("type"),
        (F.col("l_linenumber") - 1).alias("depth"),
    )


SQL_VIEWS["S"] = """
select cast(l_orderkey as varchar) as task_id,
  case when l_returnflag = 'A' then 'published' else 'subscribed' end as grp, l_linenumber as pos,
  case when l_quantity >= cast(49.0 as double) then null else '/t' || cast(l_partkey % 20 as varchar) end as name,
  case p_type when 'SMALL' then 'std_msgs/Int32' when 'MEDIUM' then 'std_msgs/Float64'
              when 'LARGE' then 'std_msgs/String' when 'STANDARD' then 'std_msgs/Bool'
              else 'geometry_msgs/Twist' end as type,
  l_linenumber - 1 as depth
from lineitem left join part on l_partkey = p_partkey
"""

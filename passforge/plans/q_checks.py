"""Registered queries for spec checks: I1-I4, I6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spec_checks as sc
from ..sources.bindings import spec_topics_view, with_views
from .catalog import query

_KNOWN = ", ".join(f"'{t}'" for t in sc.KNOWN_MSG_TYPES)


@query("i1_duplicate_topic_names", with_views("""
select task_id, name from S where name is not null and name <> '' group by task_id, name having count(*) > 1""", "S"))
def i1(spark, sf):
    return sc.duplicate_topic_names(spec_topics_view(spark, sf))


@query("i2_unsupported_msg_types", with_views(f"""
select distinct task_id, type from S
where grp = 'published' and type is not null and type <> '' and type not in ({_KNOWN})""", "S"))
def i2(spark, sf):
    return sc.unsupported_msg_types(spec_topics_view(spark, sf))


@query("i3_duplicate_publishers", with_views("""
select task_id from S where grp = 'published' group by task_id
having count(*) > count(distinct coalesce(name, '<none>'))""", "S"))
def i3(spark, sf):
    return sc.duplicate_publishers(spec_topics_view(spark, sf))


@query("i4_qos_depth_violations", with_views("""
select task_id, grp, pos, name as topic, case when grp = 'published' then 0 else 1 end as grp_order
from S where depth is not null and depth < 1""", "S"))
def i4(spark, sf):
    return sc.qos_depth_violations(spec_topics_view(spark, sf))


@query("i6_fold_spec_methods", with_views(f"""
, t as (select distinct task_id from S),
  dup as (select task_id, count(*) as n from (select task_id, name from S where name is not null and name <> ''
          group by task_id, name having count(*) > 1) group by task_id),
  unk as (select task_id, count(*) as n from (select distinct task_id, type from S where grp = 'published'
          and type is not null and type <> '' and type not in ({_KNOWN})) group by task_id),
  pubd as (select task_id from S where grp = 'published' group by task_id
           having count(*) > count(distinct coalesce(name, '<none>'))),
  qos as (select task_id, count(*) as n from S where depth < 1 group by task_id),
  j as (select t.task_id, coalesce(dup.n, 0) as n_dup, coalesce(unk.n, 0) as n_unk,
          case when pubd.task_id is null then 0 else 1 end as n_pub, coalesce(qos.n, 0) as n_qos
        from t left join dup on t.task_id = dup.task_id left join unk on t.task_id = unk.task_id
        left join pubd on t.task_id = pubd.task_id left join qos on t.task_id = qos.task_id)
select task_id, 'hypothesis' as method, cast(case when n_dup > 0 then 1 else 0 end as bigint) as n_failing,
  cast(case when n_unk > 0 then 1 else 0 end as bigint) as n_info,
  cast(n_dup = 0 as integer) as passed, case when n_dup = 0 then 'OK' else 'FAIL' end as status from j
union all
select task_id, 'z3', cast(n_pub + n_qos as bigint), cast(0 as bigint), cast(n_pub + n_qos = 0 as integer),
  case when n_pub + n_qos = 0 then 'OK' else 'FAIL' end from j""", "S"))
def i6(spark, sf):
    topics = spec_topics_view(spark, sf)
    return sc.fold_spec_methods(topics.select("task_id"), topics)


@query("i6_spec_findings", with_views(f"""
, dup as (select task_id, string_agg(name, '","' order by name) as names from (
            select task_id, name from S where name is not null and name <> '' group by task_id, name having count(*) > 1)
          group by task_id),
  unk as (select task_id, string_agg(type, '","' order by type) as types from (
            select distinct task_id, type from S where grp = 'published' and type is not null and type <> ''
              and type not in ({_KNOWN})) group by task_id),
  f as (select task_id, 'hypothesis' as method, 0 as o, 0 as pos,
          '{{"error":"duplicate topic names","names":["' || names || '"]}}' as finding from dup
        union all select task_id, 'hypothesis', 1, 0,
          '{{"info":"unsupported_msg_types_for_mvp","types":["' || types || '"]}}' from unk
        union all select task_id, 'z3', -1, 0, '{{"violation":"duplicate_publisher_topic"}}' from S where grp = 'published'
          group by task_id having count(*) > count(distinct coalesce(name, '<none>'))
        union all select task_id, 'z3', case when grp = 'published' then 0 else 1 end, pos,
          '{{"violation":"qos_depth_lt_1","topic":' || coalesce('"' || name || '"', 'null') || '}}' from S where depth < 1)
select task_id, method, cast(count(*) as bigint) as n, string_agg(finding, chr(10) order by o, pos, finding) as findings
from f group by task_id, method""", "S"))
def i6_findings(spark, sf):
    """The stored findings of both spec methods, in the order of the checks."""
    out = sc.spec_findings(spec_topics_view(spark, sf))
    return out.select("task_id", "method", F.size("findings").cast("long").alias("n"),
                      F.array_join("findings", "\n").alias("findings"))


# ---------------------------------------------------------------------------
# Code corpus: H8 programs, J1-J4 lint findings, J7 rule frequency
# ---------------------------------------------------------------------------
# Fixed values of the corpus binding: one program per part, assembled (H8) from the
# scaffold 'class Node<k>:' and a body chosen by p_size % 3: 0 a publisher without depth
# and a sleeping timer callback, 1 a publisher with depth 10, 2 a syntax error.

from ..functions import text as tx  # noqa: E402
from ..operators import code_checks as cc  # noqa: E402
from ..sources.bindings import table  # noqa: E402

_BODIES = [
    "    def __init__(self):\n        self.pub = self.create_publisher(String, 'chatter')\n"
    "    def timer_callback(self):\n        time.sleep(0.1)\n",
    "    def __init__(self):\n        self.pub = self.create_publisher(String, 'chatter', 10)\n",
    "    def broken(self:\n",
]
_MAIN = tx.MAIN_TEMPLATE.replace("{entry_point}", "{ep}")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _programs(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    body = F.element_at(F.array(*[F.lit(b) for b in _BODIES]), (F.col("p_size") % 3 + 1).cast("int"))
    scaffold = F.concat(F.lit("class Node"), k, F.lit(":\n"))
    entry = F.concat(F.lit("Node"), k)
    return p.select(F.col("p_partkey").alias("code_id"), F.col("p_type").alias("node_type"),
                    tx.assemble_program(scaffold, body, entry).alias("code"))


_SQL_PROGRAM = ("'import rclpy' || chr(10) || 'class Node' || cast(p_partkey as varchar) || ':' || chr(10) || "
                f"[{', '.join(_sql_text(b) for b in _BODIES)}][p_size % 3 + 1] || "
                + _sql_text(_MAIN).replace("{ep}", "' || 'Node' || cast(p_partkey as varchar) || '"))


@query("h8_assemble_program", f"""
select p_partkey as code_id, md5({_SQL_PROGRAM}) as code_md5 from part""")
def h8(spark, sf):
    return _programs(spark, sf).select("code_id", F.md5("code").alias("code_md5"))


_EXPECTED_FINDINGS = """
select p_partkey as code_id, p_type as node_type, rule, cast(line as integer) as line from part,
  (select 0 as b, 'W9020' as rule, 4 as line union all select 0, 'W9010', 6 union all select 2, 'E0001', 3) e
where p_size % 3 = e.b"""


@query("j1_lint_findings", _EXPECTED_FINDINGS)
def j1(spark, sf):
    return cc.lint(_programs(spark, sf)).select("code_id", "node_type", "rule", "line")


@query("l3_sql_lint", f"""
select * from ({_EXPECTED_FINDINGS}) where rule in ('W9010', 'E0001')""")
def l3(spark, sf):
    cc.register_sql(spark)
    _programs(spark, sf).createOrReplaceTempView("lint_programs")
    return spark.sql("""
        SELECT code_id, node_type, rule, line
        FROM lint_table(TABLE(SELECT /*+ REPARTITION */ * FROM lint_programs), 'code', array('W9010', 'E0001'))""")


@query("j4_syntax_gate", """
select p_partkey as code_id, p_size % 3 <> 2 as parses from part""")
def j4(spark, sf):
    return cc.syntax_gate(_programs(spark, sf), ["code_id"])


@query("j7_rule_frequency", f"""
with f as ({_EXPECTED_FINDINGS}), t as (select p_type as node_type, count(*) as n from part group by p_type)
select f.node_type, rule, cast(count(distinct code_id) as bigint) as n_with_rule, cast(t.n as bigint) as n_candidates,
  round(count(distinct code_id) / t.n, 9) as share
from f join t on f.node_type = t.node_type group by f.node_type, rule, t.n""")
def j7(spark, sf):
    progs = _programs(spark, sf)
    out = cc.rule_frequency(cc.lint(progs), progs, ["code_id"], ["node_type"])
    return out.select("node_type", "rule", "n_with_rule", "n_candidates", F.round("share", 9).alias("share"))


# Bodies without main() by p_size % 4: nothing, init only, all three calls, a
# sum of 2,000 terms in a callback-free module.
_MODULES = ["x = 1\n", "import rclpy\nrclpy.init()\n", "import rclpy\nrclpy.init()\nn.destroy_node()\nrclpy.shutdown()\n",
            "y = " + " + ".join(["1"] * 2000) + "\n"]


@query("j1_module_rules", """
select p_partkey as code_id, rule, 1 as line from part,
  (select unnest([0, 0, 0, 1, 1, 3, 3, 3]) as b, unnest(['W9001', 'W9002', 'W9003', 'W9002', 'W9003', 'W9001', 'W9002', 'W9003']) as rule) e
where p_size % 4 = e.b""")
def j1_modules(spark, sf):
    body = F.element_at(F.array(*[F.lit(b) for b in _MODULES]), (F.col("p_size") % 4 + 1).cast("int"))
    corpus = table(spark, sf, "part").select(F.col("p_partkey").alias("code_id"), body.alias("code"))
    return cc.lint(corpus).select("code_id", "rule", "line")

"""Set-based interface-spec checks: I1-I4 and the fold I6.

Input is the long form of a task's topics, one row per (task, group, position):
``task_id, grp ('published'|'subscribed'), pos, name, type, depth``. Findings are
rows, not per-task lists, so a task with an enormous spec is still a hash aggregate
(combined map-side); ``finding_lists`` builds the sorted per-task lists only for
display or storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Message types the property check knows how to generate.
KNOWN_MSG_TYPES = ["std_msgs/Int32", "std_msgs/Float64", "std_msgs/String", "std_msgs/Bool"]
_MISSING = "\u0000<missing>"


def spec_topics(tasks: DataFrame) -> DataFrame:
    """Long form of interface_spec.topics_published / topics_subscribed."""
    def one(field, grp):
        return tasks.select("task_id", F.posexplode(F.coalesce(F.col(f"interface_spec.{field}"), F.array()))
                            .alias("pos", "t")).select(
            "task_id", F.lit(grp).alias("grp"), "pos", F.col("t.name").alias("name"),
            F.col("t.type").alias("type"), F.col("t.qos.depth").alias("depth"))
    return one("topics_published", "published").unionByName(one("topics_subscribed", "subscribed"))


def duplicate_topic_names(topics: DataFrame) -> DataFrame:
    """(task_id, name) for every non-empty name used more than once across both groups."""
    named = topics.where(F.col("name").isNotNull() & (F.col("name") != ""))
    return named.groupBy("task_id", "name").agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") > 1).select("task_id", "name")


def unsupported_msg_types(topics: DataFrame, known=KNOWN_MSG_TYPES) -> DataFrame:
    """Distinct (task_id, type) of published topics whose type is outside the known set."""
    pub = topics.where((F.col("grp") == "published") & F.col("type").isNotNull() & (F.col("type") != ""))
    return pub.where(~F.col("type").isin(list(known))).select("task_id", "type").distinct()


def duplicate_publishers(topics: DataFrame) -> DataFrame:
    """Tasks whose published names repeat; missing names count as equal to each other."""
    pub = topics.where(F.col("grp") == "published")
    return pub.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct(F.coalesce(F.col("name"), F.lit(_MISSING))).alias("_d"),
    ).where(F.col("_n") > F.col("_d")).select("task_id")


def qos_depth_violations(topics: DataFrame) -> DataFrame:
    """I4: topics with an explicit QoS depth below 1 (absent depth is fine); ordered
    published before subscribed, then by position, via ``grp_order``."""
    return topics.where(F.col("depth").isNotNull() & (F.col("depth") < 1)).select(
        "task_id", "grp", "pos", F.col("name").alias("topic"),
        F.when(F.col("grp") == "published", 0).otherwise(1).alias("grp_order"))


def fold_spec_methods(tasks: DataFrame, topics: DataFrame, known=KNOWN_MSG_TYPES) -> DataFrame:
    """One method row per task and method: 'hypothesis' fails on I1 (I2 is only
    informational), 'z3' fails on I3 or I4. ``n_failing`` / ``n_info`` count findings.

    Two aggregations instead of one per rule: (task, name) -> per-task counts gives I1,
    I3 and I4; (task, type) gives I2. ``tasks`` is the full task list (task_id): a task
    without topics passes both.
    """
    named = F.col("name").isNotNull() & (F.col("name") != "")
    pub = F.col("grp") == "published"
    per_name = topics.groupBy("task_id", F.coalesce(F.col("name"), F.lit(_MISSING)).alias("_name")).agg(
        F.count_if(named).alias("_n_named"),
        F.count_if(pub).alias("_n_pub"),
        F.count_if(F.col("depth").isNotNull() & (F.col("depth") < 1)).alias("_n_qos"))
    per_task = per_name.groupBy("task_id").agg(
        F.count_if(F.col("_n_named") > 1).alias("n_dup"),
        (F.sum("_n_pub") > F.count_if(F.col("_n_pub") > 0)).cast("int").alias("n_pub"),
        F.sum("_n_qos").alias("n_qos"))
    unknown = pub & F.col("type").isNotNull() & (F.col("type") != "") & ~F.col("type").isin(list(known))
    unk = topics.where(unknown).groupBy("task_id", "type").count().groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_unk"))
    base = tasks.select("task_id").distinct()
    j = base.join(per_task, "task_id", "left").join(unk, "task_id", "left") \
        .fillna(0, ["n_dup", "n_unk", "n_pub", "n_qos"])
    # Both method rows of a task come from one pass (a generator, not a union of two plans).
    rows = F.array(
        F.struct(F.lit("hypothesis").alias("method"),
                 F.when(F.col("n_dup") > 0, 1).otherwise(0).cast("long").alias("n_failing"),
                 F.when(F.col("n_unk") > 0, 1).otherwise(0).cast("long").alias("n_info")),
        F.struct(F.lit("z3").alias("method"), (F.col("n_pub") + F.col("n_qos")).cast("long").alias("n_failing"),
                 F.lit(0).cast("long").alias("n_info")))
    out = j.select("task_id", F.explode(rows).alias("_m")).select("task_id", "_m.method", "_m.n_failing",
                                                                  "_m.n_info")
    return out.withColumn("passed", (F.col("n_failing") == 0).cast("int")) \
        .withColumn("status", F.when(F.col("n_failing") == 0, "OK").otherwise("FAIL"))


def finding_lists(topics: DataFrame) -> DataFrame:
    """Per-task JSON findings in the reference's order (for storage via A11): failing
    findings first, then the informational one. Use at the sink only: the lists are
    as long as a task's distinct duplicate names / types."""
    dup = duplicate_topic_names(topics).groupBy("task_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    unk = unsupported_msg_types(topics).groupBy("task_id").agg(F.array_sort(F.collect_list("type")).alias("types"))
    return dup.join(unk, "task_id", "full").select(
        "task_id",
        F.filter(F.array(
            F.when(F.col("names").isNotNull(), F.to_json(F.struct(
                F.lit("duplicate topic names").alias("error"), F.col("names").alias("names")))),
            F.when(F.col("types").isNotNull(), F.to_json(F.struct(
                F.lit("unsupported_msg_types_for_mvp").alias("info"), F.col("types").alias("types"))))),
            lambda x: x.isNotNull()).alias("findings"))


def spec_findings(topics: DataFrame) -> DataFrame:
    """(task_id, method, findings) for storage: JSON objects as text, in the order in which
    the checks report them. Rows only for tasks that have findings; the lists are as long
    as a task's distinct duplicate names, types and bad depths."""
    keep = {"ignoreNullFields": "false"}
    hyp = finding_lists(topics).withColumn("method", F.lit("hypothesis"))
    twice = duplicate_publishers(topics).select("task_id", F.lit(-1).alias("grp_order"), F.lit(0).alias("pos"), F.to_json(
        F.struct(F.lit("duplicate_publisher_topic").alias("violation"))).alias("f"))
    depth = qos_depth_violations(topics).select("task_id", "grp_order", "pos", F.to_json(
        F.struct(F.lit("qos_depth_lt_1").alias("violation"), "topic"), keep).alias("f"))
    z3 = twice.unionByName(depth).groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("grp_order", "pos", "f"))).alias("l"))
    z3 = z3.select("task_id", F.lit("z3").alias("method"), F.transform("l", lambda x: x["f"]).alias("findings"))
    return hyp.select("task_id", "method", "findings").unionByName(z3)

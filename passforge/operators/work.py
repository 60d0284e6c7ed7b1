"""Planned work, resume and pairing: C3, C5, C6, C7, D15, E2.

The work grid is built by exploding ``sequence(0, n-1)`` on every task row (a
generator, not a join), and the finished set is removed with a left anti join, which
the planner broadcasts only when the finished set measures small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from .ranking import positions


def pending_work(tasks: DataFrame, n: int, done: DataFrame | None = None, base_seed: int | None = 0,
                 keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Tasks x candidates 0..n-1 minus finished keys; ``seed`` = base_seed + idx (NULL base: NULL).

    ``keys`` identify a task (add experiment_id / model when the grid spans several).
    Any other task columns are carried along. n <= 0 gives no work.
    """
    keys = list(keys)
    if n <= 0:
        grid = tasks.select("*", F.lit(None).cast("int").alias("candidate_idx")).where(F.lit(False))
    else:
        grid = tasks.select("*", F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1))).alias("candidate_idx"))
    if done is not None:
        grid = grid.join(done.select(*keys, "candidate_idx"), [*keys, "candidate_idx"], "left_anti")
    seed = F.lit(None).cast("int") if base_seed is None else (F.lit(int(base_seed)) + F.col("candidate_idx"))
    return grid.withColumn("seed", seed.cast("int"))


def work_summary(tasks: DataFrame, n: int, pending: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Planned, pending and skipped (= planned - pending) counts."""
    by = list(by)
    planned = tasks.groupBy(*by).agg((F.count(F.lit(1)) * max(int(n), 0)).cast("long").alias("planned"))
    pend = pending.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("pending"))
    if by:
        out = planned.join(pend, by, "left")
    else:
        out = planned.withColumn("_k", F.lit(1)).join(pend.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    out = out.withColumn("pending", F.coalesce("pending", F.lit(0)).cast("long"))
    return out.withColumn("skipped", (F.col("planned") - F.col("pending")).cast("long"))


def assign_seeds(work: DataFrame, base_seed: int | None = 0, honours_seed: bool = True,
                 keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """``planned_seed`` = base + idx; ``recorded_seed`` = first pending seed of the task +
    position among the task's pending items (what a provider that numbers seeds from the
    first item records); NULL for a provider that ignores seeds or a NULL base.

    Positions come from ``ranking.positions``: no task is sorted in a single task. The work is landed
    first, so its plan (a grid less what is done, as a rule) is computed once.
    """
    keys = list(keys)
    planned = (F.lit(None).cast("int") if base_seed is None
               else (F.lit(int(base_seed)) + F.col("candidate_idx")).cast("int"))
    out = work.withColumn("planned_seed", planned)
    if base_seed is None or not honours_seed:
        return out.withColumn("recorded_seed", F.lit(None).cast("int"))
    # First pending seed and position of a task come from the same skew-safe counts.
    numbered = positions(land(out, "seeds"), keys, ["candidate_idx"], out="_pos", least=["planned_seed"])
    return numbered.withColumn(
        "recorded_seed", (F.col("_least_planned_seed") + F.col("_pos") - 1).cast("int")).drop("_least_planned_seed", "_pos")


def pair_outputs(items: DataFrame, outputs: DataFrame, keys: Sequence[str] = ("task_id",),
                 item_order: str = "candidate_idx", output_order: str = "pos") -> DataFrame:
    """Pair work items with outputs by position within a task; surplus on either side dropped.

    Both sides go through one range partitioning and one checkpoint as tagged rows, so each side's
    running numbers (``ranking.positions``, skew-safe) come from the same pass; equal numbers of a task
    then meet in one join."""
    keys = list(keys)
    item, out = F.struct(*items.columns), F.struct(*outputs.columns)
    none = {c: F.lit(None).cast(t) for c, t in (
        ("_item", items.select(item).schema[0].dataType), ("_out", outputs.select(out).schema[0].dataType),
        ("_io", items.schema[item_order].dataType), ("_oo", outputs.schema[output_order].dataType))}
    left = items.select(*keys, F.lit(0).alias("_side"), F.col(item_order).alias("_io"), none["_oo"].alias("_oo"),
                        item.alias("_item"), none["_out"].alias("_out"))
    right = outputs.select(*keys, F.lit(1).alias("_side"), none["_io"].alias("_io"), F.col(output_order).alias("_oo"),
                           none["_item"].alias("_item"), out.alias("_out"))
    numbered = positions(left.unionByName(right), [*keys, "_side"], ["_io", "_oo"], out="_pos")
    a = numbered.where("_side = 0").select(*keys, "_pos", "_item")
    b = numbered.where("_side = 1").select(*keys, "_pos", "_out")
    pairs = a.join(b, [*keys, "_pos"])
    return pairs.select(*keys, *[F.col(f"_item.`{c}`").alias(c) for c in items.columns if c not in keys],
                        *[F.col(f"_out.`{c}`").alias(f"out_{c}") for c in outputs.columns if c not in keys])


def complete_generations(items: DataFrame, outputs: DataFrame, failures: DataFrame,
                         keys: Sequence[str] = ("task_id",), item_order: str = "candidate_idx",
                         output_order: str = "pos", text: str = "text") -> DataFrame:
    """A task whose generation call failed yields one error row per planned item
    (empty text, zero tokens, the error message); other tasks pair by position (C5).

    ``failures`` holds (keys..., error). Output: item columns + text, prompt_tokens,
    completion_tokens, error.
    """
    keys = list(keys)
    fail = failures.select(*keys, F.col("error").alias("_task_error")).dropDuplicates(keys)
    ok_items = items.join(fail, keys, "left_anti")
    paired = pair_outputs(ok_items, outputs, keys, item_order, output_order)
    paired = paired.select(
        *items.columns,
        F.coalesce(F.col(f"out_{text}"), F.lit("")).alias("text"),
        F.coalesce(F.col("out_prompt_tokens"), F.lit(0)).cast("int").alias("prompt_tokens")
        if "prompt_tokens" in outputs.columns else F.lit(0).alias("prompt_tokens"),
        F.coalesce(F.col("out_completion_tokens"), F.lit(0)).cast("int").alias("completion_tokens")
        if "completion_tokens" in outputs.columns else F.lit(0).alias("completion_tokens"),
        (F.col("out_error") if "error" in outputs.columns else F.lit(None).cast("string")).alias("error"),
    )
    failed = items.join(fail, keys, "inner").select(
        *items.columns, F.lit("").alias("text"), F.lit(0).alias("prompt_tokens"),
        F.lit(0).alias("completion_tokens"), F.col("_task_error").alias("error"))
    return paired.unionByName(failed)


def resolve_methods(results: DataFrame, enabled: Sequence[str], registry: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keep method rows of enabled methods known to the registry, with their config
    position ``method_pos``; also return the enabled names the registry does not know.

    The enabled list is a parameter (a handful of names), so it is a literal map.
    """
    known = [m for m in enabled if m in set(registry)]
    unknown = [m for m in enabled if m not in set(registry)]
    if not known:
        return results.where(F.lit(False)).withColumn("method_pos", F.lit(None).cast("int")), unknown
    pos = F.create_map(*[x for i, m in enumerate(known) for x in (F.lit(m), F.lit(i))])
    out = results.where(F.col("method").isin(known)).withColumn("method_pos", pos[F.col("method")])
    return out, unknown

"""The experiment write path as two Spark jobs around the (external) generation step.

``plan_experiment``: tasks -> B1/B2 selection -> prompts rendered once per task (H7) ->
the pending work grid (C3, resume via C4) with seeds (E2). The model calls happen
outside Spark; their raw responses are landed as a table.

``ingest_generations``: landed responses -> normalized text and tokens (H15) -> code
(H2) -> the verification gate (H18) -> checks and verdicts for the gated candidates
(L1-L3, D12) -> ``runs`` rows with ids (H4) and ``method_results`` rows (A11), ready to
append to the run log, whose last-write-wins read (A10) makes re-ingesting idempotent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ids import run_id
from ..operators import work as w
from ..session import cut_lineage
from ..schemas import DEFAULT_ENABLED_METHODS, DEFAULT_REQUIRED_METHODS
from ..sources import runlog as rl
from ..sources import responses as rs
from ..sources import tasks as tk
from .verify import DEFAULT_REGISTRY, Check, landed_test_check, missing_check, verify


def plan_experiment(tasks: DataFrame, n: int, done: DataFrame | None = None, base_seed: int | None = 0,
                    difficulty: str | None = None, node_type: str | None = None, ids=None,
                    honours_seed: bool = True) -> DataFrame:
    """Work items (task_id, candidate_idx, planned_seed, recorded_seed, prompt) still to run."""
    selected = tk.select_tasks(tk.filter_tasks(tasks, difficulty, node_type), ids)
    prompts = selected.select("task_id", tx.render_prompt(
        "task_id", "prompt", "entry_point", "node_type", "difficulty", "ros_concepts", "interface_spec")
        .alias("prompt"))
    grid = w.pending_work(selected.select("task_id"), n, done, base_seed)
    seeded = w.assign_seeds(grid.drop("seed"), base_seed, honours_seed)
    return seeded.join(prompts, "task_id")


def ingest_generations(experiment_id: str, responses: DataFrame, tasks: DataFrame,
                       methods: Sequence[str] = tuple(DEFAULT_ENABLED_METHODS),
                       required: Sequence[str] = tuple(DEFAULT_REQUIRED_METHODS),
                       ingest_seq: int = 0, logs: DataFrame | None = None,
                       registry: Mapping[str, Check] | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs rows, method_results rows) for landed responses.

    ``responses``: task_id, candidate_idx, provider, model, body, latency_ms, seed, error,
    created_at. Candidates with an error or no code are stored without method rows and
    with overall_pass = 0, as finished (C4) only when they carry the error.

    ``logs``: landed test runs (task_id, candidate_idx, exit_code, timed_out, launch_error,
    junit_xml and, if at hand, duration_ms, stdout, stderr) are the evidence of the pytest
    method; ``registry`` may name further checks. An enabled required method without
    evidence counts as not passed; any other unknown method is refused.
    """
    gen = rs.normalize_responses(responses)
    gen = gen.withColumn("code", tx.extract_code("text")) \
        .withColumn("_verify", tx.needs_verification("error", "code")) \
        .withColumn("run_id", run_id(F.lit(experiment_id), "task_id", "candidate_idx"))
    gen = cut_lineage(gen)  # both results read it, and the checks
    cands = gen.where("_verify").join(tasks.select("task_id", "interface_spec"), "task_id", "left") \
        .select("run_id", "task_id", "candidate_idx", "code", "interface_spec")
    checks = dict(registry or {})
    if logs is not None:
        checks.setdefault("pytest", landed_test_check(
            logs.withColumn("run_id", run_id(F.lit(experiment_id), "task_id", "candidate_idx"))))
    for name in methods:
        if name not in checks and name not in DEFAULT_REGISTRY and name in required:
            checks[name] = missing_check(name)
    refused = [m for m in methods if m not in checks and m not in DEFAULT_REGISTRY]
    if refused:
        raise ValueError(f"no check registered for {refused}")
    rows, verdicts, _ = verify(cands, ["run_id"], list(methods), registry=checks, required=required, materialize=True)
    runs = gen.join(verdicts, "run_id", "left").select(
        "run_id", F.lit(experiment_id).alias("experiment_id"), "task_id",
        F.col("candidate_idx").cast("int").alias("candidate_idx"), "provider", "model",
        F.col("prompt_tokens").cast("int").alias("prompt_tokens"),
        F.col("completion_tokens").cast("int").alias("completion_tokens"),
        F.col("latency_ms").cast("double").alias("latency_ms"), F.col("seed").cast("int").alias("seed"),
        tx.stored_code("code").alias("code"), F.nullif(F.col("error"), F.lit("")).alias("gen_error"),
        F.coalesce(F.col("overall_pass"), F.lit(False)).cast("int").alias("overall_pass"),
        "created_at", F.lit(int(ingest_seq)).cast("long").alias("ingest_seq"))
    kinds = {"score": "double", "exit_code": "int", "duration_ms": "double", "stdout": "string", "stderr": "string"}
    extra = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    method_rows = rl.append_method_results(
        tx.clip_logs(rows.select("run_id", F.lit(experiment_id).alias("experiment_id"), "method", "passed", "status", *extra,
                                 F.concat(F.lit("["), F.array_join("findings", ","), F.lit("]")).alias("findings_json"),
                                 F.lit(int(ingest_seq)).cast("long").alias("ingest_seq"))))
    return runs, method_rows

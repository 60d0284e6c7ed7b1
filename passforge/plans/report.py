"""Every report table of an experiment from one scan of the run log.

The reference re-reads all runs six times for one report. Here the runs are pruned
to the columns the tables need, scanned once and persisted (memory, spilling to disk;
a lost block is recomputed from lineage), and the frames are built lazily on it; those by
model, difficulty, node type, and model and difficulty are parts of one GROUPING SETS shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as m

REPORT_COLUMNS = ("experiment_id", "task_id", "model", "overall_pass", "latency_ms", "prompt_tokens",
                  "completion_tokens")


def report_tables(runs: DataFrame, meta: DataFrame | None, experiment_id: str | None = None,
                  ks: Sequence[int] = (1, 5, 10), persist: bool = True) -> dict[str, DataFrame]:
    """The report frames of A12. ``tables["runs"]`` is the persisted, pruned scan that
    every frame reads, ``tables["sets"]`` the persisted grouping behind the summaries; call
    ``unpersist()`` on both when the report is written."""
    scoped = runs if experiment_id is None else runs.where(F.col("experiment_id") == F.lit(experiment_id))
    pruned = scoped.select(*[c for c in REPORT_COLUMNS if c in runs.columns])
    if persist:
        pruned = pruned.persist(StorageLevel.MEMORY_AND_DISK)

    def sink_order(df: DataFrame, *keys: str) -> DataFrame:
        # group keys ascending, NULL last; these frames have one row per group.
        present = [k for k in ("experiment_id", *keys) if k in df.columns]
        return df.orderBy(*[F.col(k).asc_nulls_last() for k in present])

    tables = _summaries(pruned, meta, persist)
    tables = {name: sink_order(df, *m.SUMMARY_SETS[name]) if name in m.SUMMARY_SETS else df for name, df in tables.items()}
    tables |= {
        "pass_at_k_by_model": sink_order(m.pass_at_k_by_model(pruned, ks=ks), "model"),
        "overall_pass_at_k": m.experiment_pass_at_k(pruned, ks=ks, experiment_id=experiment_id),
        "latency": m.latency_token_summary(pruned),
        "latency_histogram": m.latency_histogram(pruned),
    }
    tables["runs"] = pruned
    return tables


def _summaries(runs: DataFrame, meta: DataFrame | None, persist: bool) -> dict[str, DataFrame]:
    """The frames grouped by model, difficulty, node type and both; from one grouping where the
    metadata has both columns."""
    if meta is not None and {"difficulty", "node_type"} <= set(meta.columns) and set(REPORT_COLUMNS) <= set(runs.columns):
        sets = m.summary_sets(runs, meta)
        if persist:
            sets = sets.persist(StorageLevel.MEMORY_AND_DISK)
        return {name: m.summary_frame(sets, name) for name in m.SUMMARY_SETS} | {"sets": sets}
    tables = {"by_model": m.summarize_by_model(runs), "by_difficulty": m.summarize_by_difficulty(runs, meta),
              "by_node_type": m.summarize_by_node_type(runs, meta)}
    if meta is not None and "difficulty" in meta.columns:
        tables["model_difficulty"] = m.pass_rate_model_difficulty(runs, meta)
    return tables

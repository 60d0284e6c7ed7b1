"""Metrics over the run log: C1, C2, D1-D11, D14, D16.

Every operator takes ordinary DataFrames and returns one. Grouping always starts
with ``by`` (default: ``experiment_id``) so that one pass reports every experiment of
a run log; pass ``experiment_id=...`` to restrict to one (a partition filter on a
table partitioned by experiment_id).

Scale notes: all aggregates are hash aggregates with partial (map-side) combine, so
a key holding a third of the rows costs one partial row per input partition. Task
metadata is joined without a broadcast hint: the planner broadcasts it only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-checks the
real size at run time); a large task table falls back to a sort-merge join, with AQE
splitting a skewed task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.passk import pass_at_k
from .quantile import exact_percentile

DEFAULT_KS = (1, 5, 10)
SALTS = 16


def _by(by) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)


def _scope(runs: DataFrame, experiment_id: str | None) -> DataFrame:
    if experiment_id is None:
        return runs
    return runs.where(F.col("experiment_id") == F.lit(experiment_id))


def _pass_rate(passed: str = "passed", n: str = "n") -> Column:
    return (F.col(passed) / F.greatest(F.col(n), F.lit(1))).cast("double")


def require_columns(df: DataFrame, cols: Sequence[str], what: str) -> None:
    """Column-set inclusion test before grouping or pivoting."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; have {df.columns}")


# ---------------------------------------------------------------------------
# C1, C2 joins
# ---------------------------------------------------------------------------

def with_meta(runs: DataFrame, meta: DataFrame | None, cols: Sequence[str] | None = None) -> DataFrame:
    """C1 (and C2 with ``cols``): runs left-joined to task metadata on task_id.

    Unmatched runs keep NULL metadata; duplicate metadata rows multiply runs;
    no metadata returns the runs unchanged.
    """
    if meta is None:
        return runs
    if cols is not None:
        meta = meta.select("task_id", *[c for c in cols if c != "task_id"])
    return runs.join(meta, on="task_id", how="left")


# ---------------------------------------------------------------------------
# D1-D4 summaries
# ---------------------------------------------------------------------------

def summarize_by_model(runs: DataFrame, by=("experiment_id",), experiment_id: str | None = None) -> DataFrame:
    """Per model n, passed, mean latency, token sums, pass_rate. NULL model is a group."""
    keys = _by(by) + ["model"]
    return (
        _scope(runs, experiment_id).groupBy(*keys).agg(
            F.count(F.lit(1)).cast("long").alias("n"),
            F.sum("overall_pass").cast("long").alias("passed"),
            F.avg("latency_ms").alias("mean_latency_ms"),
            F.sum("prompt_tokens").cast("long").alias("tokens_in"),
            F.sum("completion_tokens").cast("long").alias("tokens_out"),
        ).withColumn("pass_rate", _pass_rate())
    )


def _summarize_by_dim(runs: DataFrame, meta: DataFrame | None, dim: str, by, experiment_id) -> DataFrame:
    df = _scope(runs, experiment_id)
    keys = _by(by) + [dim]
    if meta is None or dim not in meta.columns:
        df = with_meta(df, meta)
        if dim not in df.columns:
            return df
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("overall_pass").alias("_c"))
    else:  # runs collapse to one row per task before the metadata is joined
        counts = with_meta(_per_task(df, _by(by)), meta, cols=[dim])
    return counts.groupBy(*keys).agg(
        F.sum("_n").cast("long").alias("n"),
        F.sum("_c").cast("long").alias("passed"),
    ).withColumn("pass_rate", _pass_rate())


#: The sets that ``summary_sets`` groups by, and the columns of each.
SUMMARY_SETS = {"by_model": ("model",), "by_difficulty": ("difficulty",), "by_node_type": ("node_type",),
                "model_difficulty": ("model", "difficulty")}


def summary_sets(runs: DataFrame, meta: DataFrame, by=("experiment_id",)) -> DataFrame:
    """D1, D2, D3 and D8 in one: runs collapse to one row per (model, task), metadata joins them once,
    and one shuffle groups by all four sets. ``set`` names the set of a row; see ``summary_frame``."""
    keys, dims = _by(by), ["model", "difficulty", "node_type"]
    require_columns(meta, dims[1:], "summary_sets")
    per = runs.groupBy(*keys, "model", "task_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("overall_pass").alias("_c"), F.count("overall_pass").alias("_k"),
        F.sum("latency_ms").alias("_l"), F.count("latency_ms").alias("_ln"),
        F.sum("prompt_tokens").alias("_in"), F.sum("completion_tokens").alias("_out"))
    per = with_meta(per, meta, cols=dims[1:])
    names = F.create_map(*[x for name, own in SUMMARY_SETS.items() for x in (
        F.lit(sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in own)).cast("long"), F.lit(name))])
    return per.groupingSets([[*keys, *own] for own in SUMMARY_SETS.values()], *keys, *dims).agg(
        F.sum("_n").cast("long").alias("n"), F.sum("_c").cast("long").alias("passed"), F.sum("_k").alias("known"),
        F.try_divide(F.sum("_l"), F.sum("_ln")).alias("mean_latency_ms"),
        F.sum("_in").cast("long").alias("tokens_in"), F.sum("_out").cast("long").alias("tokens_out"),
        names[F.grouping_id().cast("long")].alias("set"))


def summary_frame(sets: DataFrame, name: str, by=("experiment_id",)) -> DataFrame:
    """One frame of ``summary_sets`` with the columns of D1, D2, D3 or D8."""
    keys, own = _by(by), SUMMARY_SETS[name]
    rows = sets.where(F.col("set") == name)
    if name == "model_difficulty":
        rate = F.try_divide(F.col("passed").cast("double"), F.col("known").cast("double"))
        return rows.dropna(subset=list(own)).select(*keys, *own, rate.alias("pass_rate"))
    more = ["mean_latency_ms", "tokens_in", "tokens_out"] if name == "by_model" else []
    return rows.select(*keys, *own, "n", "passed", *more, _pass_rate().alias("pass_rate"))


def _per_task(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, passes and non-null verdicts per task within ``keys``: what joins need of raw runs."""
    return runs.groupBy(*keys, "task_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("overall_pass").alias("_c"), F.count("overall_pass").alias("_k"))


def summarize_by_difficulty(runs: DataFrame, meta: DataFrame | None = None, by=("experiment_id",),
                            experiment_id: str | None = None) -> DataFrame:
    """Per difficulty n, passed, pass_rate; NULL difficulty (no metadata) is a group."""
    return _summarize_by_dim(runs, meta, "difficulty", by, experiment_id)


def summarize_by_node_type(runs: DataFrame, meta: DataFrame | None = None, by=("experiment_id",),
                           experiment_id: str | None = None) -> DataFrame:
    """D3: per node type n, passed, pass_rate; NULL kept."""
    return _summarize_by_dim(runs, meta, "node_type", by, experiment_id)


def task_counts(runs: DataFrame, by=("experiment_id",)) -> DataFrame:
    """Candidates n and passes c per task (within ``by``)."""
    keys = _by(by) + ["task_id"]
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum("overall_pass").cast("long").alias("c"),
    )


# ---------------------------------------------------------------------------
# D5, D6 pass@k
# ---------------------------------------------------------------------------

def experiment_pass_at_k(runs: DataFrame, ks: Sequence[int] = DEFAULT_KS, by=("experiment_id",),
                         experiment_id: str | None = None) -> DataFrame:
    """Mean over tasks of pass@k, one row per (experiment, k). Models are pooled in a task.

    With ``experiment_id`` given and no runs, every k reports 0.0.
    """
    keys = _by(by)
    counts = task_counts(_scope(runs, experiment_id), by=keys)
    per_task = counts.select(*keys, "n", "c", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    out = per_task.groupBy(*keys, "k").agg(F.avg(pass_at_k("n", "c", "k")).alias("pass_at_k"))
    if experiment_id is None:
        return out
    spark = runs.sparkSession
    grid = spark.createDataFrame([(experiment_id, int(k)) for k in ks], "experiment_id string, k int")
    return grid.join(out.drop(*[c for c in keys if c != "experiment_id"]), ["experiment_id", "k"], "left") \
        .select("experiment_id", "k", F.coalesce("pass_at_k", F.lit(0.0)).alias("pass_at_k"))


def pass_at_k_by_model(runs: DataFrame, ks: Sequence[int] = DEFAULT_KS, by=("experiment_id",),
                       experiment_id: str | None = None) -> DataFrame:
    """Per model, one column ``pass@k`` per k (mean over the model's tasks)."""
    keys = _by(by) + ["model"]
    counts = task_counts(_scope(runs, experiment_id), by=keys)
    return counts.groupBy(*keys).agg(
        *[F.avg(pass_at_k("n", "c", int(k))).alias(f"pass@{k}") for k in ks])


# ---------------------------------------------------------------------------
# D7-D11
# ---------------------------------------------------------------------------

def latency_token_summary(runs: DataFrame, by=("experiment_id",), experiment_id: str | None = None,
                          p: float = 0.95) -> DataFrame:
    """Mean latency, exact p95 (linear interpolation), token sums per experiment.

    The percentile is computed by a distributed exact selection (see quantile.py), so
    no group's values are ever gathered into one task.
    """
    keys = _by(by)
    df = _scope(runs, experiment_id)
    sums = df.groupBy(*keys).agg(
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.sum("prompt_tokens").cast("long").alias("tokens_in"),
        F.sum("completion_tokens").cast("long").alias("tokens_out"),
    )
    p95 = exact_percentile(df, "latency_ms", p, keys, alias="p95_latency_ms")
    if not keys:
        return _join_one_row(sums, p95)
    return sums.join(p95, keys, "left")


def _join_one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    # Both sides are single-row aggregates; join on a constant key.
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def pass_rate_model_difficulty(runs: DataFrame, meta: DataFrame | None, by=("experiment_id",),
                               experiment_id: str | None = None) -> DataFrame:
    """Mean pass per (model, difficulty); rows with NULL model or difficulty are dropped."""
    keys = _by(by) + ["model", "difficulty"]
    df = _scope(runs, experiment_id)
    if meta is None or "difficulty" not in meta.columns:
        require_columns(with_meta(df, meta), keys, "pass_rate_model_difficulty")
        per = df.groupBy(*keys).agg(F.sum("overall_pass").alias("_c"), F.count("overall_pass").alias("_k"))
    else:
        require_columns(df, keys[:-1], "pass_rate_model_difficulty")
        per = with_meta(_per_task(df.dropna(subset=["model"]), keys[:-1]), meta, cols=["difficulty"])
    return (per.dropna(subset=["model", "difficulty"]).groupBy(*keys)
            .agg(F.try_divide(F.sum("_c").cast("double"), F.sum("_k").cast("double")).alias("pass_rate")))


def pass_rate_pivot(d8: DataFrame, values: Sequence[str] | None = None, by=("experiment_id",)) -> DataFrame:
    """D8 pivoted, rows model, one column per difficulty; a missing cell is NULL."""
    keys = [c for c in _by(by) if c in d8.columns] + ["model"]
    require_columns(d8, keys + ["difficulty", "pass_rate"], "pass_rate_pivot")
    g = d8.groupBy(*keys)
    g = g.pivot("difficulty", list(values)) if values is not None else g.pivot("difficulty")
    return g.agg(F.avg("pass_rate"))


def latency_histogram(runs: DataFrame, bins: int = 20, by=("experiment_id",),
                      experiment_id: str | None = None, value: str = "latency_ms") -> DataFrame:
    """Equal-width histogram over [min, max], last bin right-closed, NULLs dropped.

    When min = max the range is [min - 0.5, max + 0.5]. Empty bins are reported as 0.
    """
    keys = _by(by)
    vals = _scope(runs, experiment_id).where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    rng = vals.groupBy(*keys).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    rng = rng.select(
        *keys,
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"),
    )
    # Equal values collapse first; one experiment may hold most of them, so its values are
    # spread over SALTS join keys (the range side has one row per experiment).
    collapsed = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")) \
        .withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    salted = rng.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    bucketed = collapsed.join(salted, [*keys, "_salt"])
    counts = bucketed.select(
        *keys, "_c", F.least(F.width_bucket(F.col("_v"), F.col("lo"), F.col("hi"), F.lit(bins)),
                             F.lit(bins)).cast("int").alias("bin"),
    ).groupBy(*keys, "bin").agg(F.sum("_c").cast("long").alias("count"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    grid = rng.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    grid = grid.select(*keys, "bin",
                       (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"),
                       F.when(F.col("bin") == bins, F.col("hi"))
                       .otherwise(F.col("lo") + F.col("bin") * width).alias("bin_hi"))
    return grid.join(counts, keys + ["bin"], "left").select(
        *keys, "bin", "bin_lo", "bin_hi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def experiment_status(runs: DataFrame, by=("experiment_id",), experiment_id: str | None = None) -> DataFrame:
    """Total runs, passed, percent passed = passed / max(1, total) * 100."""
    keys = _by(by)
    out = _scope(runs, experiment_id).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.count_if(F.col("overall_pass") != 0).cast("long").alias("passed"),
    ).withColumn("pct_passed", (F.col("passed") / F.greatest(F.col("total"), F.lit(1)) * 100).cast("double"))
    if experiment_id is not None:
        spark = runs.sparkSession
        one = spark.createDataFrame([(experiment_id,)], "experiment_id string")
        out = one.join(out, "experiment_id", "left").select(
            "experiment_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"),
            F.coalesce("passed", F.lit(0)).cast("long").alias("passed"),
            F.coalesce("pct_passed", F.lit(0.0)).alias("pct_passed"))
    return out


# ---------------------------------------------------------------------------
# D14, D16
# ---------------------------------------------------------------------------

def candidate_quality(methods: DataFrame, key: Sequence[str] | str = ("run_id",)) -> DataFrame:
    """Per candidate the number of passed methods and the mean of non-null scores (0.0 if none)."""
    keys = _by(key)
    return methods.groupBy(*keys).agg(
        F.count_if(F.col("passed") != 0).cast("long").alias("n_passed"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
    )


def metrics_by(runs: DataFrame, meta: DataFrame | None, dims: Sequence[str], ks: Sequence[int] = DEFAULT_KS,
               by=("experiment_id",), experiment_id: str | None = None) -> DataFrame:
    """N, passed, pass_rate and pass@k by any dimensions.

    ``ros_concept`` as a dimension explodes the task's concept list (distinct, outer):
    a task counts once under each of its concepts and once under NULL when it has none.
    """
    keys, dims = _by(by), list(dims)
    df = _scope(runs, experiment_id)
    of_meta = {"ros_concept", *([] if meta is None else [c for c in meta.columns if c != "task_id"])}
    own = [d for d in dims if d not in of_meta]
    carried = [] if meta is not None or "ros_concepts" not in df.columns else ["ros_concepts"]
    require_columns(df, keys + own + ["task_id", "overall_pass"], "metrics_by")
    # runs collapse to one row per task before metadata and concepts multiply them
    needed = [d for d in dims if d in of_meta and d != "ros_concept"] + (["ros_concepts"] if "ros_concept" in dims else [])
    df = with_meta(_per_task(df, [*keys, *own, *carried]), meta,
                   cols=None if meta is None else [c for c in needed if c in meta.columns])
    if "ros_concept" in dims:
        concepts = F.col("ros_concepts") if "ros_concepts" in df.columns else F.lit(None).cast("array<string>")
        df = df.withColumn("ros_concept", F.explode_outer(F.array_distinct(concepts)))
    require_columns(df, keys + dims, "metrics_by")
    counts = df.groupBy(*keys, *dims, "task_id").agg(
        F.sum("_n").cast("long").alias("_tn"), F.sum("_c").cast("long").alias("_tc"))
    return counts.groupBy(*keys, *dims).agg(
        F.sum("_tn").cast("long").alias("n"),
        F.sum("_tc").cast("long").alias("passed"),
        F.count(F.lit(1)).cast("long").alias("n_tasks"),
        *[F.avg(pass_at_k("_tn", "_tc", int(k))).alias(f"pass@{k}") for k in ks],
    ).withColumn("pass_rate", _pass_rate())

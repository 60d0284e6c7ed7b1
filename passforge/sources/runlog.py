"""The run log at rest: A5-A11 and C4.

Layout: three parquet tables under one root, ``experiments``, ``runs`` and
``method_results``, the latter two partitioned by ``experiment_id``. Writes are
append-only; a row carries ``ingest_seq`` (the attempt), and the current state is a
last-write-wins read on the run key. Re-running a job appends the same rows again,
which the read collapses, so replays are idempotent and a lost executor only causes
a task retry of a deterministic write.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import land

RUN_KEY = ("experiment_id", "task_id", "candidate_idx")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def init_store(spark: SparkSession, root: str, database: str | None = None, buckets: int = 0) -> dict[str, str]:
    """Create the three tables if absent (safe to repeat). Returns table -> location.

    With ``buckets`` the run and method tables are bucketed by ``run_id`` inside their experiment's
    partitions, so joins and aggregates by run need no exchange; such tables are written with
    ``append_rows``."""
    prefix = f"{database}." if database else ""
    locs = {}
    for name, schema, part in (("experiments", schemas.EXPERIMENTS, None),
                               ("runs", schemas.RUNS, "experiment_id"),
                               ("method_results", schemas.METHOD_RESULTS, "experiment_id")):
        loc = os.path.join(root, name)
        partition = f" PARTITIONED BY ({part})" if part else ""
        clustered = f" CLUSTERED BY (run_id) INTO {int(buckets)} BUCKETS" if part and buckets else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({_ddl(schema)}) USING parquet"
                  f"{partition}{clustered} LOCATION '{loc}'")
        locs[name] = loc
    return locs


#: Rows of a bucket that one task sorts or aggregates in some hundred MB.
BUCKET_ROWS = 500_000


def buckets_for(rows: int, least: int = 8) -> int:
    """Buckets of a store for about ``rows`` runs: a bucket is written and read by one task, so their
    number follows the rows."""
    return max(least, -(-rows // BUCKET_ROWS))


def append_rows(df: DataFrame, table: str, buckets: int = 0) -> None:
    """Append rows to a table of the store by column name; absent columns are NULL. With ``buckets`` the
    rows are dealt by run first, so a write makes one file per bucket and experiment."""
    target = df.sparkSession.table(table).schema.fields
    rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])
    (rows.repartition(buckets, "run_id") if buckets else rows).write.insertInto(table)


def scan_runs(runs: DataFrame, experiment_id: str | None = None, ordered: bool = True) -> DataFrame:
    """A5: runs of one experiment (a partition filter), ordered by task then candidate."""
    df = runs if experiment_id is None else runs.where(F.col("experiment_id") == F.lit(experiment_id))
    return df.orderBy("task_id", "candidate_idx") if ordered else df


def scan_experiments(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """A5 for a table of experiments: their rows only. On a store partitioned by experiment the
    planner prunes partitions by the experiments found when the query runs. The ids are broadcast:
    dealt by experiment, all runs of one would meet in one task."""
    return runs.join(F.broadcast(experiments.select("experiment_id")), "experiment_id", "left_semi")


def finished_in_store(runs: DataFrame, methods: DataFrame, experiments: DataFrame,
                      key: Sequence[str] = RUN_KEY) -> DataFrame:
    """C4 over the stored tables for a table of experiments: last attempt of each run (A10), method
    rows of that attempt only (the cascade), finished or not.

    Every step works by ``run_id``: on tables bucketed by it there is no exchange. So the attempt
    stands beside the join key as a difference of zero, not as a second key."""
    runs, methods = scan_experiments(runs, experiments), scan_experiments(methods, experiments)
    last = runs.groupBy(F.col("run_id").alias("_run")).agg(F.max("ingest_seq").alias("_seq"))
    current = runs.join(last, (F.col("run_id") == F.col("_run")) & (F.col("ingest_seq") - F.col("_seq") == 0), "left_semi")
    done = current.groupBy("run_id", "ingest_seq", *key).agg(  # replays of the attempt collapse
        F.max((F.col("overall_pass") == 1) | F.col("gen_error").isNotNull()).alias("_done"))
    verified = methods.select(F.col("run_id").alias("_run"), F.col("ingest_seq").alias("_seq"))
    same = (F.col("run_id") == F.col("_run")) & (F.col("ingest_seq") - F.col("_seq") == 0)
    open_ = done.where(~F.coalesce(F.col("_done"), F.lit(False)))
    return done.where("_done").select(*key).unionByName(open_.join(verified, same, "left_semi").select(*key))


def export_runs_csv(runs: DataFrame, path: str, experiment_id: str | None = None) -> str:
    """CSV with a header, NULL and empty both written as empty fields, quotes doubled.

    Spark writes a directory of part files (one per task), each with the header; no
    single task is made to hold the whole export.
    """
    (scan_runs(runs, experiment_id, ordered=True).write.mode("overwrite")
     .option("header", True).option("nullValue", "").option("emptyValue", "")
     .option("quote", '"').option("escape", '"').csv(path))
    return path


#: Column that names a row of a stored table, see ``with_row_address``.
ROW = "_row"


def with_row_address(stored: DataFrame) -> DataFrame:
    """Add ``ROW``, a hash of file and row number, to a frame read straight from Parquet files.

    Files of the store are never changed, so a re-run task and a second scan see the same
    addresses. Not for frames behind a join or an explode, where rows share an address."""
    return stored.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(ROW))


def _as_long(df: DataFrame, column: str) -> Column | None:
    """An order-keeping whole number for columns that have one."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return F.col(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    return F.unix_date(column).cast("long") if isinstance(kind, T.DateType) else None


def _rank(df: DataFrame, order: Sequence[str]) -> Column:
    """The order columns and the row's address as one comparable value, nulls lowest.

    One column with whole-number order packs with 60 bits of the address into a decimal, which a
    hash aggregate can hold; else a struct."""
    number = _as_long(df, order[0]) if len(order) == 1 else None
    if number is None:
        return F.struct(*[F.col(c) for c in order], F.col(ROW))
    low = F.col(ROW).bitwiseAND((1 << 60) - 1).cast("decimal(19,0)")
    return F.coalesce(number, F.lit(-(1 << 63))).cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + low


def _first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key, the first (or last) by ``order``; rows alike in key and order are replays
    and one of them stays.

    A narrow reduction: only key, order and row address are aggregated, map-side first, so a key
    replayed a third of the time costs one partial row per input partition. The winning rows
    are then fetched by key and rank; ranks are all different, so that join is even too. Payload columns,
    of any type, are never sorted. A frame without row addresses is landed first."""
    keys = list(keys)
    if ROW not in df.columns:
        df = with_row_address(land(df, "last-write-wins"))
    ranked = df.select("*", _rank(df, order).alias("_rank"))
    best = ranked.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        (F.max("_rank") if last else F.min("_rank")).alias("_best")).hint("shuffle_hash")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return ranked.join(best, [*same, F.col("_rank") == F.col("_best")], "left_semi").drop("_rank", ROW)


def register_experiments(existing: DataFrame, new: DataFrame, order: Sequence[str] = ("started_at",)) -> DataFrame:
    """Rows of ``new`` to append; an id already present (or earlier in the batch) wins."""
    first = _first_by(new, ["experiment_id"], order)
    return first.join(existing.select("experiment_id"), "experiment_id", "left_anti")


def finalize_experiments(experiments: DataFrame, ids: DataFrame, finished_at) -> DataFrame:
    """Stamp ``finished_at`` on the listed experiments; unknown ids are a no-op."""
    ts = finished_at if isinstance(finished_at, Column) else F.lit(finished_at).cast("timestamp")
    marks = ids.select("experiment_id").distinct().withColumn("_hit", F.lit(True))
    out = experiments.join(marks, "experiment_id", "left")
    return out.withColumn("finished_at", F.when(F.col("_hit"), ts).otherwise(F.col("finished_at"))).drop("_hit")


def upsert_runs(log: DataFrame, key: Sequence[str] = RUN_KEY, order: str | Sequence[str] = "ingest_seq") -> DataFrame:
    """A10: current runs = last write per key (INSERT OR REPLACE), by one or more order columns."""
    return _first_by(log, key, [order] if isinstance(order, str) else list(order), last=True)


def current_runs(spark: SparkSession, path: str, experiment_id: str | None = None) -> DataFrame:
    """A10 on the stored log: two scans of its files, nothing is landed again."""
    log = with_row_address(spark.read.parquet(path))
    return upsert_runs(log if experiment_id is None else log.where(F.col("experiment_id") == F.lit(experiment_id)))


def current_methods(methods: DataFrame, current: DataFrame, attempt: Sequence[str] = ("run_id", "ingest_seq")) -> DataFrame:
    """A10 cascade: keep only method rows of the winning attempt of each run."""
    return methods.join(current.select(*attempt), list(attempt), "left_semi")


def method_result_id(*cols) -> Column:
    """Deterministic row id (stable under task retries), never a global counter."""
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def append_method_results(df: DataFrame) -> DataFrame:
    """Method rows ready to append: findings as JSON text ('[]' when none; a ready
    ``findings_json`` is taken as it is) and an id."""
    out = df
    if "findings_json" not in df.columns:
        findings = F.col("findings") if "findings" in df.columns else F.lit(None)
        out = df.withColumn("findings_json", F.when(findings.isNull(), F.lit("[]")).otherwise(F.to_json(findings)))
    out = out.drop("findings")
    seq = ["ingest_seq"] if "ingest_seq" in out.columns else []
    return out.withColumn("id", method_result_id("run_id", "method", *seq, "findings_json"))


def write_append(df: DataFrame, path: str, partition_by: str | None = "experiment_id") -> None:
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def compact_runs(spark: SparkSession, runs_path: str, out_path: str, since: str | None = None,
                 key: Sequence[str] = RUN_KEY, order: str | Sequence[str] = "ingest_seq") -> None:
    """Rewrite the current state of the experiments that changed under ``out_path``.

    ``since`` is a condition on the log's rows, such as ``"batch_id > 41"`` on a landed stream; only
    experiments with such rows are read and written, by default all in the log. Partitions of other
    experiments keep their files (dynamic partition overwrite). Files are rebalanced: a large
    experiment is split, small ones share a task, whatever the number of runs a key had."""
    log = with_row_address(spark.read.parquet(runs_path))
    if since is not None:
        log = scan_experiments(log, spark.read.parquet(runs_path).where(since).select("experiment_id").distinct())
    (upsert_runs(log, key, order).hint("rebalance", "experiment_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("experiment_id").parquet(out_path))


def finished_keys(runs: DataFrame, methods: DataFrame, experiment_id: str | None = None,
                  key: Sequence[str] = ("experiment_id", "task_id", "candidate_idx")) -> DataFrame:
    """C4: keys of runs that finished: passed, OR recorded a generation error, OR have a
    method row. A run with none of these crashed during verification and is retried.

    The EXISTS is a left semi join to the (experiment, run, attempt) of ``methods``, as far as
    both tables carry those columns, so method rows of a replaced attempt do not count. Only runs
    that did not finish by themselves are joined.
    """
    scope = [c for c in ("experiment_id", "run_id", "ingest_seq") if c in runs.columns and c in methods.columns]
    if experiment_id is not None:  # a partition filter on both tables
        runs = runs.where(F.col("experiment_id") == F.lit(experiment_id))
        if "experiment_id" in methods.columns:
            methods = methods.where(F.col("experiment_id") == F.lit(experiment_id))
    by_itself = F.coalesce((F.col("overall_pass") == 1) | F.col("gen_error").isNotNull(), F.lit(False))
    verified = runs.where(~by_itself).join(methods.select(*scope), scope, "left_semi")
    return runs.where(by_itself).select(*key).unionByName(verified.select(*key))


def resume_keys(run_log: DataFrame, method_log: DataFrame, experiment_id: str) -> DataFrame:
    """Finished keys straight from the store: last write per run (A10), method rows of the
    winning attempt only, then C4, so a replaced run that crashed counts as unfinished."""
    mine = F.col("experiment_id") == F.lit(experiment_id)
    current = upsert_runs(run_log.where(mine))
    methods = current_methods(method_log.where(mine), current)
    return finished_keys(current, methods, experiment_id)

"""Structured Streaming for the run log: K1 (idempotent landing) and K2 (live status).

K1: a stream of finished runs is appended, micro-batch by micro-batch, to a parquet
run log. Each batch is written to its own ``batch_id=<n>`` partition in overwrite mode,
so a batch replayed after a failure replaces its own earlier output instead of adding
a copy; the pair (batch_id, pos) orders attempts, batch first, and the
current state is the last-write-wins read of A10. ``pos`` keeps the type of its column, so
timestamps order to the microsecond. Files that a source delivers again can be kept out by
a state store under a watermark (``replay_key``); without it no state is kept.

K2: a streaming aggregate of totals and passes per experiment (state = one row per
experiment), written in complete mode; on the same rows it equals D11.

Checkpoints and outputs live under the session's ``spark.checkpoint.dir`` (a shared
folder on a cluster) unless a location is given.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove_at_exit, scratch_path


#: Columns that order attempts of a landed run log.
ATTEMPT = ("batch_id", "pos")
#: Status folders that stay while an experiment runs.
KEPT = 3


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder that goes when the application ends."""
    path = scratch_path(spark, name)
    spark.range(0).write.parquet(os.path.join(path, "_new"))
    return remove_at_exit(spark, path)


def read_run_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                    glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the files landing under ``path`` (explicit schema, never inferred)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(path)


def dedupe_replays(stream: DataFrame, key: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Drop replays of a key whose event times lie within ``delay`` of each other.

    The state store holds a key until the watermark (the latest event time less ``delay``) has
    passed its event time by ``delay``; rows older than the watermark are dropped, so ``delay`` must
    cover the longest a source may lag. Only for exact replays: ``key`` names a delivery (an
    event id), not a run; a correction of a run has a key of its own and lands."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def land_runs(stream: DataFrame, out_path: str, order_by: str, checkpoint: str | None = None,
              available_now: bool = True, partition_by: str | None = "experiment_id",
              replay_key: Sequence[str] | None = None, event_time: str | None = None, delay: str = "1 hour"):
    """K1: append every micro-batch to ``out_path`` with ``batch_id`` and ``pos``.

    ``order_by`` (any orderable column of the rows, e.g. an event id or a timestamp) is the
    order inside a batch and becomes ``pos`` as it is: it comes with the row, so a replayed batch
    gets the same values. With ``replay_key`` and ``event_time``, rows of a key that has landed
    before are dropped (``dedupe_replays``). Attempts are ordered by the pair (batch_id, pos), as in
    ``upsert_runs(log, order=ATTEMPT)``; no width of either limits the other.
    Returns the started query (already finished when ``available_now``).
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or _scratch(spark, "k1-checkpoint")
    if replay_key:
        stream = dedupe_replays(stream, list(replay_key), event_time, delay)

    def write_batch(df: DataFrame, batch_id: int) -> None:
        out = df.withColumn("pos", F.col(order_by))
        target = os.path.join(out_path, f"batch_id={int(batch_id)}")
        w = out.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(target)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def landed_schema(stream: DataFrame, order_by: str) -> T.StructType:
    """Schema of what ``land_runs`` writes (stream columns + pos + batch_id)."""
    return T.StructType(stream.schema.fields + [T.StructField("pos", stream.schema[order_by].dataType),
                                                T.StructField("batch_id", T.LongType())])


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a K1 folder back with its schema, so partition values keep their types."""
    return spark.read.schema(schema).parquet(path)


def status_stream(stream: DataFrame, passed: str = "overall_pass") -> DataFrame:
    """K2: running totals and passes per experiment (same definition as D11)."""
    return stream.groupBy("experiment_id").agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.count_if(F.col(passed) != 0).cast("long").alias("passed"),
    ).withColumn("pct_passed", (F.col("passed") / F.greatest(F.col("total"), F.lit(1)) * 100).cast("double"))


def run_status(stream: DataFrame, out_path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """K2 to completion on what is available now; returns the final status table."""
    spark = stream.sparkSession
    out_path = out_path or _scratch(spark, "k2-status")
    watch_status(stream, out_path, checkpoint, available_now=True).awaitTermination()
    return read_status(spark, out_path)


def watch_status(stream: DataFrame, out_path: str, checkpoint: str | None = None, available_now: bool = False,
                 every: str = "10 seconds"):
    """K2 while an experiment runs: each micro-batch writes its complete result to a folder of
    its own (``batch_id=<n>``), so a reader never sees a half-written status. The last ``KEPT``
    folders stay for readers that are at it, older ones are removed. Returns the query."""
    spark = stream.sparkSession
    checkpoint = checkpoint or _scratch(spark, "k2-checkpoint")

    def write_batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={int(batch_id)}"))
        fs, folder = _folder(spark, out_path)
        for old in sorted(_batches(fs, folder))[:-KEPT]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"batch_id={old}"), True)

    writer = status_stream(stream).writeStream.outputMode("complete").foreachBatch(write_batch) \
        .option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _batches(fs, folder) -> list[int]:
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]


def read_status(spark: SparkSession, out_path: str) -> DataFrame:
    """The totals of the last complete micro-batch under ``out_path``. A folder counts only
    once its write has committed (it holds the success marker)."""
    fs, folder = _folder(spark, out_path)
    done = [n for n in _batches(fs, folder)
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"batch_id={n}/_SUCCESS"))]
    return spark.read.parquet(os.path.join(out_path, f"batch_id={max(done)}"))

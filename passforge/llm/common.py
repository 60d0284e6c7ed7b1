"""Helpers shared by the operators of this package.

Conventions: a null text counts as the empty text; "words" are maximal runs of
characters other than blank and the controls tab .. carriage return; lower-casing
touches A-Z only, so the JVM, Python bytes and SQL agree on every input.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, remove_at_exit

WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also change other letters)."""
    return F.translate(col, _UPPER, _UPPER.lower())


def id_text(col: str | Column) -> Column:
    """doc_id as text; a null id counts as the empty text."""
    return text_or_empty(col)


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(F.encode(id_text(col), "UTF-8")) % n


def bound_batches(spark: SparkSession) -> None:
    """Cap an Arrow batch by bytes: ten thousand very long texts must not meet in one batch.

    Set only where the session has not chosen a bound itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key, "2147483647").rstrip("b")) >= 2**31 - 1:
            spark.conf.set(key, BATCH_BYTES)
    except ValueError:
        return  # the session names a bound with a unit


def release_memory() -> None:
    """Give the memory that a task has freed back to the system: Python workers are used again, and
    what their allocators keep counts beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim is not None:  # only some C libraries have it
        trim(0)


def stored(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the table's real
    size, so it broadcasts the side only when that is below the session's threshold.
    ``rows_per_file`` bounds what a writer or reader holds where single rows are large. The
    table is removed when the application ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def largest(df: DataFrame, value: str, most: int) -> DataFrame:
    """The rows with the largest positive whole ``value``, at most ``most`` of them.

    Cut by a histogram of value sizes (a few hundred rows reach the driver); a size that
    would exceed the bound is left out whole, so the choice does not depend on ties."""
    size = F.when(F.col(value) < 64, F.col(value)).otherwise(F.floor(F.log2(value) * 16)).cast("int")
    bins = df.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("size")).collect()
    cut, held = None, 0
    for row in bins:
        held += row["k"]
        if held > most:
            break
        cut = row["size"]
    return df.filter(F.lit(False)) if cut is None else df.filter(size >= cut)


def bounded_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """About ``n`` rows (never above 2 n) chosen by a hash of ``key``; all rows if there are
    no more than n. A filter, not a sort: tasks pass on only what is chosen."""
    total = df.count()
    if total <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(2**31)) < int(2**31 * n / total)).limit(2 * n)

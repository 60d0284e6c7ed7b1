"""Positions within a group without sorting a whole group in one task.

``row_number() over (partition by key order by o)`` sends every row of a key to one
task. When one key may hold a third of all rows, that task sorts a third of the data.
``positions`` gives the same numbers with balanced work:

1. range-partition by (key, order) -- balanced as long as (key, order) is unique --
   and checkpoint, so partition ids are fixed;
2. count rows per (partition, key) and prefix-sum those small counts per key to give
   each partition its starting offset inside the key;
3. number rows within (partition, key) -- at most one partition's worth of rows -- and
   add the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos",
              num_partitions: int | None = None, least: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = 1-based position of each row within ``keys`` ordered by ``order``
    (which must be unique within a key, as for row_number to be deterministic), and for each column
    of ``least`` its smallest value within the key, as ``_least_<column>``, from the same counts.

    Ranges are found by a first pass over ``df``: hand in a landed frame when it is costly to compute."""
    keys, order = list(keys), list(order)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_cnt"),
                                               *[F.min(c).alias(f"_least_{c}") for c in least])
    counts = counts.select(
        "_pid", *keys, (F.sum("_cnt").over(Window.partitionBy(*keys).orderBy("_pid")) - F.col("_cnt")).alias("_off"),
        *[F.min(f"_least_{c}").over(Window.partitionBy(*keys)).alias(f"_least_{c}") for c in least])
    local = F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order))
    numbered = ranged.withColumn("_local", local)
    return numbered.join(counts, ["_pid", *keys]).withColumn(out, (F.col("_off") + F.col("_local")).cast("long")) \
        .drop("_pid", "_off", "_local")

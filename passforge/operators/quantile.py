"""Exact percentile with linear interpolation, without gathering a group into one task.

Spark's ``percentile`` is exact but keeps every distinct value of a group in one
aggregation buffer. For a run log where one experiment holds billions of latencies
that buffer is unbounded, so the selection here is distributed:

1. collapse duplicates: (group, value) -> multiplicity, with partial aggregation, so a
   value repeated a third of the time becomes one row;
2. bracket the rank r = p * (n - 1) by two approximate quantiles of a bounded sketch per group,
   p less and p plus a few times the sketch's error, so a few thousandths of the rows lie between;
3. sum the multiplicities below the bracket, which gives its first value's exact rank;
4. sort only the values inside the bracket, with a running count, and read off the values at
   ranks floor(r) and ceil(r).

The counts make the result exact; the sketch only decides how much is sorted. One plan for
every size; nothing runs until the result is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's accuracy, and how many times its error the bracket reaches to either side.
ACCURACY, REACH = 2_000, 4


def exact_percentile(df: DataFrame, value: str, p: float, by: Sequence[str] = (),
                     alias: str = "percentile", accuracy: int = ACCURACY) -> DataFrame:
    keys = list(by)
    if not keys:
        df = df.withColumn("_g", F.lit(0))
        keys = ["_g"]
    vals = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    reach = REACH / accuracy
    shares = [max(0.0, float(p) - reach), min(1.0, float(p) + reach)]
    cuts = vals.groupBy(*keys).agg(F.percentile_approx("_v", shares, accuracy).alias("_q"), F.count(F.lit(1)).alias("_n"),
                                   F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # a bracket that reaches over an end of the ranks takes the end itself
    low = F.col("_min") if shares[0] == 0.0 else F.col("_q")[0]
    high = F.col("_max") if shares[1] == 1.0 else F.col("_q")[1]
    cuts = cuts.select(*keys, low.alias("_low"), high.alias("_high"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_r"))
    distinct = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = distinct.join(cuts, keys)
    # one row per group for what lies below, one per value inside the bracket
    narrow = placed.where(F.col("_v") <= F.col("_high")).groupBy(
        *keys, F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(
        F.sum("_c").alias("_c"), F.first("_r").alias("_r"))
    running = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    cand = narrow.withColumn("_end", F.sum("_c").over(running)).withColumn("_start", F.col("_end") - F.col("_c"))

    def at(rank):
        return F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))

    lo, hi = at(F.floor("_r")), at(F.ceil("_r"))
    out = cand.groupBy(*keys).agg((lo + F.max(F.col("_r") - F.floor("_r")) * (hi - lo)).alias(alias))
    return out.drop("_g") if "_g" in keys else out

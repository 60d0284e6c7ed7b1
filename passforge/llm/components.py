"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label = least node of its component.

    Each round takes the least label among a node's neighbours, then follows labels one
    step further, so long chains need few rounds. Every round is written to the shared
    folder; nothing but a count of changes reaches the driver. Links are first collapsed
    to distinct pairs; the shuffled rows carry two longs each."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stored(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
                  .distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("label").alias("seen"))
        near = both.join(of_other, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        new = stored(least.join(jump, "new").select("node", F.col("label").alias("was"),
                                                    F.least("new", "further").alias("label")), "labels")
        if new.filter("label < was").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")

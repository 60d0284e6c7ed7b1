"""Mixing sources to target weights by Pareto order sampling (operator 5, DataFrame functions only).

Each source gets a target number of words. With r = target / words of the source, every
document is certain of floor(r) whole copies; the remaining words are filled by one more
copy of a Pareto order sample with unequal probabilities: a document's inclusion probability pi_i
goes with the square root of its size (longer documents are likelier), scaled so that the
words expected over the source are the remaining ones; where that gives 1 or more the copy is
certain. Document i draws u_i (a hash of seed and id, so reruns agree) and ranks by
odds(u_i) / odds(pi_i). The sample is of fixed size: documents are taken in rank order until
the source's remaining words are used up, the last one when more than half of it still fits.

A source may hold a third of all rows, so its rank order is never sorted in one task: the
rank q is cut into slices of q / (1 + q); words are first summed per (source, slice), 256 wide
slices and then the 256 narrow ones of one of them; prefix sums over the slices find where the
budget ends, and only that narrow slice is ranked row by row. The result per source is one
threshold row; joining it back is a join with one row per source.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating; together they
share 150% of all words; a target stops at twice its source's words and the excess is
shared again by weight until no target is above.

Defined cases: null text has no words; a document without words is never more than
listed (taken 0, but its whole copies are kept by ``mix``); a null source is a source of
its own; rows with equal doc_id share one draw and are taken or left together; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import positions
from .common import WORD, id_text, stored, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SLICES = 2**16
_WIDE = 2**8
SEED = "mix-1"
_DRAW_RANGE = float(2**52)


def _draw(doc_id: Column, seed: str) -> Column:
    """u in (0, 1): 52 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), id_text(doc_id)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(_DRAW_RANGE)


def _measure(size: Column) -> Column:
    """What the inclusion probability goes with: the square root of the size, as a whole number."""
    return F.floor(F.sqrt(size) * 1024).cast("long")


def _with_rank(rows: DataFrame) -> DataFrame:
    """Add the Pareto rank q (odds of the draw over the odds of inclusion; null where there is nothing to
    fill or to take) and its slice to rows with size, u and their source's rest and weighed size."""
    pi = F.try_divide(F.col("rest") * _measure(F.col("size")), F.col("weighed"))
    odds = F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(F.col("pi"), 1 - F.col("pi")))
    out = rows.withColumn("pi", pi).withColumn("q", F.when(F.col("pi") >= 1, F.lit(0.0)).when(F.col("pi") > 0, odds)).drop("pi")
    part = F.when(F.col("q") < 1e15, F.col("q") / (1 + F.col("q"))).when(F.col("q").isNotNull(), F.lit(1.0))
    return out.withColumn("slice", F.least(F.floor(part * SLICES), F.lit(SLICES - 1)).cast("long"))


def _draws(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        _draw(F.col(id_col), seed).alias("u"), *more)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, weighed, target): capped targets by resharing the excess by weight; weighed is
    the sum of size times measure, by which the expected words of the sample come to what is left to fill."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * _measure(F.col("size"))).alias("weighed"))
    per = positions(per.withColumn("last", F.col("source").isNull()), [], ["last", "source"]).drop("last")
    ws = F.array(*[F.lit(float(w)) for w in weights])
    per = stored(per.withColumn("w", F.element_at(ws, ((F.col("pos") - 1) % len(weights) + 1).cast("int")))
                 .withColumn("cap", F.col("source_size") * F.lit(float(most))), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, F.lit(False)
    while True:  # each round fills up at least one more source; two or three rounds are usual
        row = per.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("used"),
                      F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not row["w"]:
            break
        new = (share * total - row["used"]) / row["w"]
        if new == level:
            break
        level = new
        full = F.lit(level) * F.col("w") > F.col("cap")
    target = F.least(F.col("cap"), F.lit(level or 0.0) * F.col("w"))
    return per.select("source", "source_size", "weighed", target.alias("target"))


def _where_it_ends(rows: DataFrame, t: DataFrame, same: Column) -> DataFrame:
    """Per source the slice (``cut``) in which the words from ``start`` on reach ``rest``."""
    t = t.select("__s", "rest", "start")
    per = rows.groupBy("source", "cut").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("sum", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(t, same)
    per = per.withColumn("before", F.col("start") + F.col("sum"))
    ends = per.filter((F.col("rest") > 0) & (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    return ends.groupBy("source").agg(F.min(F.struct("cut", "before", "rest")).alias("e")).select(
        F.col("source").alias("__s"), F.col("e.cut").alias("end"), "e.before", "e.rest")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: certain copies and the last (slice, rank, id) taken once more."""
    t = targets.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    t = t.withColumnRenamed("source", "__s")
    same = F.col("source").eqNullSafe(F.col("__s"))
    sized = _with_rank(sized.join(t.select("__s", "rest", "weighed"), same)).select("doc_id", "source", "size", "q", "slice") \
        .filter(F.col("q").isNotNull())
    # 256 wide slices, then the 256 narrow ones in the wide slice where the budget ends: no
    # prefix sum runs over more than 256 rows, whatever the source holds
    wide = _where_it_ends(sized.withColumn("cut", F.floor(F.col("slice") / _WIDE)), t.withColumn("start", F.lit(0)), same)
    narrow = sized.join(wide, same & (F.floor(F.col("slice") / _WIDE) == F.col("end"))).select(
        "source", "size", F.col("slice").alias("cut"))
    end = _where_it_ends(narrow, wide.withColumn("start", F.col("before")), same).withColumnRenamed("end", "end_slice")
    inside = sized.join(end, same & (F.col("slice") == F.col("end_slice")))
    ranked = inside.groupBy("source", "q", "doc_id", "before", "rest").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = (ranked.withColumn("middle", F.col("before") + F.sum("size").over(upto) - F.col("size") / 2)
            .filter(F.col("middle") <= F.col("rest"))
            .groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("last"))
            .select(F.col("source").alias("__s2"), "last"))
    t = t.join(end.select(F.col("__s").alias("__s1"), "end_slice"), F.col("__s").eqNullSafe(F.col("__s1")), "left")
    return t.join(last, F.col("__s").eqNullSafe(F.col("__s2")), "left").drop("__s1", "__s2")


def _copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Join the threshold row of each row's source and add long ``copies``."""
    out = _with_rank(rows.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left"))
    inside = (F.col("slice") == F.col("end_slice")) & F.col("last").isNotNull() \
        & (F.struct("q", "doc_id") <= F.col("last"))
    # no end slice: the remaining words are not used up by the source (or are zero)
    extra = F.when((F.col("rest") <= 0) | F.col("q").isNull(), F.lit(False)).when(F.col("end_slice").isNull(), F.col("rest") > 0) \
        .otherwise((F.col("slice") < F.col("end_slice")) | inside)
    return out.withColumn("copies", F.col("whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0))


def plan_mix(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document."""
    sized = stored(_draws(docs, seed, id_col, text_col, source_col), "sizes")  # texts are read once
    cuts = stored(thresholds(sized, source_targets(sized)), "cuts")
    return _copies(sized, cuts).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies")


def mix(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """The mixed documents with their own columns, each repeated as often as it is taken."""
    sized = stored(_draws(docs, seed, id_col, text_col, source_col), "sizes")
    cuts = stored(thresholds(sized, source_targets(sized)), "cuts")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    taken = _copies(_draws(docs, seed, id_col, text_col, source_col, row), cuts).filter("copies > 0")
    return taken.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * floor(sqrt(size) * 1024)::BIGINT)::BIGINT AS weighed, row_number() OVER (ORDER BY source NULLS LAST) AS pos
      FROM d GROUP BY source),
w AS (SELECT source, source_size, weighed, (CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w,
             2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source) AS k FROM w),
lv AS (SELECT k, cap / w AS ratio,
              (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM o),
l AS (SELECT arg_min(lev, k) AS lev FROM lv WHERE lev <= ratio),
t AS (SELECT source, source_size, weighed, least(cap, lev * w)::DOUBLE AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
             target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM t),
p AS (SELECT d.doc_id, d.size, d.u, d.source, r.source_size, r.target, r.whole, r.rest,
             r.rest * floor(sqrt(d.size) * 1024)::BIGINT / nullif(r.weighed, 0) AS pi
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, CASE WHEN pi >= 1 THEN 0.0 WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q FROM p),
c AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING)
                                             - size / 2.0::DOUBLE END AS middle FROM q)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c
"""

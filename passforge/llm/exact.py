"""Exact dedup by two-pass Bloom filtering (operator 8, DataFrame functions only).

Pass 1 hashes every normalised text to two slots of a counting Bloom filter and keeps
the slots that at least two rows hit, packed as 64-bit words. Pass 2 tests every row
against that filter: a row whose two slots are both marked is *possibly* repeated, and
only such rows are shuffled by their SHA-256; all other rows pass straight through.
A false positive costs a shuffled row, never a wrong result.

Size of the broadcast: at most ``filter_bits / 64`` rows of two longs, whatever the
data (64 MB for the default). When far more rows than ``filter_bits`` arrive, the
filter fills up and more rows take the shuffled way; the result stays the same.

Defined cases: a null text equals the empty text; texts differ unless identical after
lower-casing A-Z; a null doc_id ranks below every id; of rows that repeat the kept
doc_id within a group exactly one is kept; an empty table gives an empty result; other
columns are never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, text_or_empty

FILTER_BITS = 2**28
SALTS = 16


def _slots(filter_bits: int) -> list[Column]:
    return [F.pmod("__h", F.lit(filter_bits)), F.pmod(F.xxhash64("__h"), F.lit(filter_bits))]


def _bit_of(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))


def repeated_slots(hashed: DataFrame, filter_bits: int) -> DataFrame:
    """Pass 1: (word, bits) of the slots that two or more rows hit."""
    slots = hashed.select(F.explode(F.array(*_slots(filter_bits))).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return twice.groupBy(F.floor(F.col("slot") / 64).cast("long").alias("word")).agg(
        F.bit_or(_bit_of(F.col("slot"))).alias("bits"))


def flag_possible_repeats(hashed: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Pass 2: add boolean ``__maybe`` to rows that carry a long ``__h``."""
    words = repeated_slots(hashed.select("__h"), filter_bits)
    out = hashed
    tests = []
    for i, slot in enumerate(_slots(filter_bits)):
        side = F.broadcast(words.select(F.col("word").alias(f"__w{i}"), F.col("bits").alias(f"__b{i}")))
        out = out.join(side, F.floor(slot / 64).cast("long") == F.col(f"__w{i}"), "left")
        tests.append(F.coalesce(F.col(f"__b{i}").bitwiseAND(_bit_of(slot)) != 0, F.lit(False)))
    return out.withColumn("__maybe", tests[0] & tests[1]).drop("__w0", "__b0", "__w1", "__b1")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = ascii_lower(text_or_empty(text_col))
    # texts are read and hashed once; both passes run on the narrow table
    hashed = stored(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(norm).alias("__h"),
                                F.sha2(F.encode(norm, "UTF-8"), 256).alias("text_sha256")), "hashes")
    flagged = flag_possible_repeats(hashed, filter_bits)
    alone = flagged.filter(~F.col("__maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    # equal (text, id) rows collapse first, map-side; a hot text is then one row per id
    ids = flagged.filter("__maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("__n"))
    groups = ids.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"),
                                            F.sum("__n").alias("group_size"))
    # a group may hold a third of all rows: spread its rows over SALTS join keys
    groups = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = ids.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = ids.join(groups, ["text_sha256", "__salt"])
    each = joined.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    repeated = each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__i") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(repeated)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          filter_bits: int = FILTER_BITS) -> DataFrame:
    """The kept rows with all their columns: one row per distinct normalised text."""
    norm = ascii_lower(text_or_empty(text_col))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                         F.col(id_col).alias("__id"), F.xxhash64(norm).alias("__h"),
                         F.sha2(F.encode(norm, "UTF-8"), 256).alias("__sha"))
    flagged = flag_possible_repeats(packed, filter_bits)
    alone = flagged.filter(~F.col("__maybe")).select("__row.*")
    best = flagged.filter("__maybe").groupBy("__sha").agg(
        F.max_by("__row", F.struct(F.col("__id"), F.col("__h"))).alias("__row"))
    return alone.unionByName(best.select("__row.*"))


ORACLE = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     s AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM s GROUP BY text_sha256)
SELECT s.doc_id, g.keep_id, g.group_size, s.doc_id = g.keep_id AS kept, s.text_sha256
FROM s JOIN g USING (text_sha256)
"""

"""Document fingerprints from Lempel-Ziv phrases (operator 10).

A text is parsed the LZ78 way: each phrase is the shortest piece, from where the last one
ended, that is not yet a phrase. The phrases are hashed, dealt into ``SLOTS`` classes by
their hash, and summarised by the least hash of each class (minimum hashing with one
permutation); the share of equal slots estimates the Jaccard likeness of two phrase sets,
which follows how well one text would help to compress the other.

``compare_with_next`` also fingerprints an edited version of each text whose last half
comes from the next document (descending id; after the last, the first). Neighbours are
found without a global window: ids are cut into ranges, every row goes to its range, and
the first row of each range is also sent to the range before it. One shuffle of the
texts, and no task sees more than its ranges.

Defined cases: a null text equals the empty text; the fingerprint of an empty text is all
``f`` and two empty texts are alike to 1, an empty and another to 0; one document alone
is its own next; rows with equal ids follow each other by text hash; a null id sorts
after all others; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty

SLOTS = 64
SEED = 11
_EMPTY = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
_OF_BYTE = np.random.default_rng(SEED).integers(1, 2**63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Parse:
    """State of an LZ78 parse: the trie of phrases, the node reached, and where phrases ended."""

    def __init__(self):
        self.trie: dict[int, int] = {}
        self.node, self.at = 0, 0
        self.ends: list[int] = []

    def copy(self) -> Parse:
        other = Parse()
        other.trie, other.node, other.at, other.ends = self.trie.copy(), self.node, self.at, self.ends.copy()
        return other

    def feed(self, data: bytes) -> Parse:
        """A phrase ends with the first byte that leads out of the trie; it becomes a new node."""
        trie, node, at, ends = self.trie, self.node, self.at, self.ends
        known = trie.get
        size = len(trie) + 1
        for b in data:
            key = node << 8 | b
            node = known(key)
            at += 1
            if node is None:
                trie[key] = size
                size += 1
                node = 0
                ends.append(at)
        self.node, self.at = node, at
        return self


def _signature(data: bytes, parse: Parse) -> np.ndarray:
    """Least hash of the parse's phrases in each of ``SLOTS`` classes (u32)."""
    n = len(data)
    if not n:
        return _EMPTY
    ends = parse.ends if parse.ends and parse.ends[-1] == n else [*parse.ends, n]
    stops = np.array(ends)
    starts = np.concatenate([[0], stops[:-1]])
    lengths = stops - starts
    powers = np.cumprod(np.full(int(lengths.max()), _BASE))
    place = np.arange(n) - np.repeat(starts, lengths)
    h = np.add.reduceat(_OF_BYTE[np.frombuffer(data, np.uint8)] * powers[place], starts)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mul)
    h ^= h >> np.uint64(31)
    low = np.full(SLOTS, 2**32, np.uint64)
    np.minimum.at(low, (h % np.uint64(SLOTS)).astype(np.int64), h >> np.uint64(32))
    filled = np.flatnonzero(low < 2**32)
    if len(filled) < SLOTS:  # an empty class borrows from the next filled one, marked by the distance
        slots = np.arange(SLOTS)
        nearest = filled[np.searchsorted(filled, slots) % len(filled)]
        low = low[nearest] + ((nearest - slots) % SLOTS).astype(np.uint64) * np.uint64(0x9E3779B1)
    return low.astype(np.uint32)


def signature(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass")
    return _signature(data, Parse().feed(data))


def phrases(text: str) -> list[bytes]:
    """The phrases of a text in order (the last may repeat an earlier one)."""
    data = text.encode("utf-8", "surrogatepass")
    ends = Parse().feed(data).ends
    if data and (not ends or ends[-1] != len(data)):
        ends.append(len(data))
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column (hex)."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        for texts in batches:
            yield pd.Series([as_text(signature(t)) for t in texts], dtype=object)
    return docs.withColumn(out, run(text_or_empty(text_col)))


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range after the other, each in descending id order; a range ends with the
    copy of the row that comes next (``extra``), which is not reported itself."""
    held = None  # (range, doc_id, text, head, parse of the head, signature)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in _RESULT.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for part, doc_id, text, extra in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            # the edited text shares its head with the text: that part is parsed once
            head = text[:len(text) - len(text) // 2].encode("utf-8", "surrogatepass")
            tail = text[len(text) - len(text) // 2:].encode("utf-8", "surrogatepass")
            begun = Parse().feed(head)
            sig = _signature(head + tail, begun.copy().feed(tail))
            if held is not None and held[0] == part:
                rows.append(_pair(*held[1:], text, sig))
            held = None if extra else (part, doc_id, text, head, begun, sig)
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _pair(doc_id, text: str, head: bytes, begun: Parse, sig: np.ndarray, next_text: str,
          next_sig: np.ndarray) -> tuple:
    tail = next_text[:len(text) // 2].encode("utf-8", "surrogatepass")
    edited = head + tail
    new = _signature(edited, begun.feed(tail))
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), as_text(sig), as_text(new),
            likeness(sig, new), likeness(sig, next_sig))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the two likenesses.

    ``ranges``: number of id ranges; the session's shuffle partitions by default. Their
    bounds come from one small aggregation (ranges + 1 ids reach the driver)."""
    spark = docs.sparkSession
    bound_batches(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ids = rows.select("doc_id")
    cut = ids.agg(F.approx_percentile("doc_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] \
        if n > 1 else None
    bounds = sorted(set(cut or []), reverse=True)
    # range 0 holds the largest ids; null ids come last
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)) \
        .otherwise(F.lit(len(bounds)) - _at_or_below(bounds)).cast("int")
    keyed = rows.withColumn("part", part).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.col("doc_id"), F.col("tie"))
    first = keyed.groupBy("part").agg(F.max(order).alias("top")).orderBy("part").collect()  # a row per range
    parts = [r["part"] for r in first]
    before = {p: parts[i - 1] for i, p in enumerate(parts)}  # the last range is followed by the first
    top = spark.createDataFrame([(r["part"], r["top"]["doc_id"], r["top"]["tie"], before[r["part"]]) for r in first],
                                "p int, top_id long, top_tie long, goes_to int")
    # a range's first row also closes the range before; of equal rows one copy is enough
    copies = (keyed.join(F.broadcast(top), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("top_id"))
                         & (F.col("tie") == F.col("top_tie")))
              .groupBy("goes_to").agg(F.max(F.struct("doc_id", "tie", "text")).alias("r"))
              .select(F.col("goes_to").alias("part"), "r.doc_id", "r.text", F.lit(True).alias("extra"), "r.tie"))
    both = keyed.select("part", "doc_id", "text", F.lit(False).alias("extra"), "tie").unionByName(copies)
    dealt = both.repartitionByRange(max(n, 1), "part").sortWithinPartitions(
        F.col("part"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return dealt.select("part", "doc_id", "text", "extra").mapInArrow(_compare, _RESULT)


def _at_or_below(bounds: list[int]):
    """How many of the descending ``bounds`` are at or below doc_id, by binary search."""
    asc = F.array(*[F.lit(b).cast("long") for b in reversed(bounds)]) if bounds else None
    if asc is None:
        return F.lit(0)
    return F.size(F.filter(asc, lambda b: b <= F.col("doc_id")))

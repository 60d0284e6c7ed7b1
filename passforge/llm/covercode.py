"""Vector code compression by Lloyd rounds over cover trees (operator 13).

A vector is cut into equal consecutive parts, and each part is coded by the nearest entry of
its part's codebook. The codebooks come from a fixed number of Lloyd rounds.

Every task builds cover trees over the vectors it holds, one tree for each part, block by
block, and writes them as a table once. A node has a centre that is one of its points;
its children's centres lie more than a power of two apart, every point of a child lies
within that power of the child's centre, and the first child keeps its parent's centre. The
points of a node are consecutive in the tree's order, so cumulative sums give the count
and the sum of any node by two look-ups.

A round sends only the codebooks to the tasks. For a frontier of nodes the distances of
the centres to all entries of their part are taken at once. If the nearest entry is nearer
than any other by more than twice the node's radius, the triangle inequality gives the
whole subtree to it; the other nodes' children make the next frontier. Points of an
ambiguous leaf are compared one by one, in whole numbers; ties go to the lower index.
The sums for each part, entry and position are added by Spark; what comes to the driver
are the codebooks' own numbers (parts x entries x width), whatever the table's size.

Components are whole numbers ``floor(scale * x)``, saturated at 2^24 in size.

Defined cases: vectors that are null, hold null or non-finite components or have another
length than most kept vectors of a length that divides into the parts (ties: the shortest) are
dropped. Of rows that share a vec_id, the least vector is the seed; a null vec_id is never a
seed, its row is coded like any other. With fewer vec_ids than entries the codebooks are
shorter; with none they start as one entry of zeros. Repeated rows stay repeated. Equal labels, nulls together, share one label error.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, stored
from .vectors import dimension, finite, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24
BLOCK_VALUES = 1 << 19
LEAF = 8
BLOCKS_PER_FILE = 8
_STEP = 1 << 13


@dataclass
class CoverTree:
    """Trees over the parts of a block; the points of node i are ``order[start[i]:end[i]]``."""

    points: np.ndarray   # (parts * rows, width)
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray   # a point's number
    reach: np.ndarray    # largest squared distance of a point of the node from the centre
    child: np.ndarray    # first child, -1 for a leaf
    children: np.ndarray
    part: np.ndarray

    FIELDS = ("points", "order", "start", "end", "centre", "reach", "child", "children", "part")

    def pack(self) -> dict[str, bytes]:
        return {f: np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS}

    @classmethod
    def unpack(cls, row: dict, width: int) -> CoverTree:
        kinds = {"points": "<i4", "reach": "<i8"}
        got = {f: np.frombuffer(row[f], kinds.get(f, "<i4")) for f in cls.FIELDS}
        got["points"] = got["points"].reshape(-1, width)
        return cls(**got)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def build_trees(vectors: np.ndarray, parts: int) -> CoverTree:
    """Cover trees of all parts of some vectors (rows x components, whole numbers), level by level."""
    rows, dim = vectors.shape
    width = dim // parts
    points = np.ascontiguousarray(vectors.reshape(rows, parts, width).swapaxes(0, 1).reshape(-1, width), dtype=np.int32)
    order = np.arange(len(points))
    start = np.arange(parts) * rows
    centre = order[start]
    reach = np.array([_square(points[a:a + rows], points[a]).max() for a in start])
    levels = [[start, start + rows, centre, reach, np.arange(parts)]]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    count = parts
    while True:
        start, end, centre, reach, part = levels[-1]
        split = np.flatnonzero((reach > 0) & (end - start > LEAF))
        child, children = np.full(len(start), -1), np.zeros(len(start), np.int64)
        links.append((child, children))
        if not len(split):
            break
        # the children's radius: half the power of two that covers the node
        radius = np.exp2(np.ceil(0.5 * np.log2(reach[split])) - 1)
        radius[radius < 1] = 0
        limit = (radius * radius).astype(np.int64)
        size = (end - start)[split]
        owner = np.repeat(np.arange(len(split)), size)
        place = np.arange(len(owner)) + np.repeat(start[split] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        point = order[place]
        turn = np.zeros(len(owner), np.int64)
        far = np.zeros(len(owner), np.int64)
        centres = [(np.arange(len(split)), centre[split])]
        left = np.arange(len(owner))
        k = 0
        while True:
            heads = np.full(len(split), -1)
            heads[centres[-1][0]] = centres[-1][1]
            d = _square(points[point[left]], points[heads[owner[left]]])
            near = d <= limit[owner[left]]
            turn[left[near]], far[left[near]] = k, d[near]
            left = left[~near]
            if not len(left):
                break
            k += 1
            first = np.flatnonzero(np.append(True, np.diff(owner[left]) > 0))
            centres.append((owner[left[first]], point[left[first]]))
        key = owner * (k + 1) + turn
        sort = np.argsort(key, kind="stable")
        order[place] = point[sort]
        key = key[sort]
        first = np.flatnonzero(np.append(True, np.diff(key) > 0))
        owners = key[first] // (k + 1)
        named = np.concatenate([o * (k + 1) + t for t, (o, _) in enumerate(centres)])
        head = np.concatenate([c for _, c in centres])[np.argsort(named)]  # as the children: by owner, then turn
        fresh = place[first]
        ends = np.append(place[first[1:] - 1], place[-1]) + 1
        child[split] = count + np.searchsorted(owners, np.arange(len(split)))
        children[split] = np.bincount(owners, minlength=len(split))
        levels.append([fresh, ends, head, np.maximum.reduceat(far[sort], first), part[split][owners]])
        count += len(first)
    start, end, centre, reach, part = (np.concatenate([level[i] for level in levels]) for i in range(5))
    i4 = np.int32
    return CoverTree(points, order.astype(i4), start.astype(i4), end.astype(i4), centre.astype(i4), reach.astype(np.int64),
                     np.concatenate([c for c, _ in links]).astype(i4), np.concatenate([n for _, n in links]).astype(i4),
                     part.astype(i4))


def _nearest(points: np.ndarray, part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties: the lower index), its squared distance and the next one's."""
    best, least, second = (np.empty(len(points), np.int64) for _ in range(3))
    for at in range(0, len(points), _STEP):
        to = slice(at, at + _STEP)
        d = np.zeros((len(points[to]), book.shape[1]), np.int64)
        for j in range(book.shape[2]):
            gap = points[to, j].astype(np.int64)[:, None] - book[part[to], :, j]
            d += gap * gap
        best[to] = d.argmin(1)
        rows = np.arange(len(d))
        least[to] = d[rows, best[to]]
        d[rows, best[to]] = np.iinfo(np.int64).max
        second[to] = d.min(1)
    return best, least, second


def assign(tree: CoverTree, book: np.ndarray) -> np.ndarray:
    """The entry of every place of the tree's order; ``book`` is (parts, entries, width)."""
    entry = np.empty(len(tree.order), np.int64)
    node = np.arange(book.shape[0])  # the roots
    given: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(node):
        best, least, second = _nearest(tree.points[tree.centre[node]], tree.part[node], book)
        reach = tree.reach[node]
        margin = np.sqrt(second.astype(float)) - np.sqrt(least.astype(float))
        whole = (reach == 0) | (margin > 2 * np.sqrt(reach.astype(float)) * (1 + 1e-9) + 1e-6)
        given.append((tree.start[node[whole]], tree.end[node[whole]], best[whole]))
        node = node[~whole]
        leaf = tree.child[node] < 0
        if leaf.any():  # exact comparisons, point by point
            a, b = tree.start[node[leaf]], tree.end[node[leaf]]
            size = b - a
            place = np.arange(size.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            entry[place] = _nearest(tree.points[tree.order[place]], np.repeat(tree.part[node[leaf]], size), book)[0]
        node = node[~leaf]
        size = tree.children[node]
        node = np.arange(size.sum()) + np.repeat(tree.child[node] - np.concatenate([[0], np.cumsum(size)[:-1]])[:len(size)], size)
    start, end, best = (np.concatenate([g[i] for g in given]) for i in range(3))
    size = end - start
    place = np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    entry[place] = np.repeat(best, size)
    return entry


def entry_sums(tree: CoverTree, entry: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and component sums of each part's entries, by cumulative sums over runs of one entry."""
    parts, entries, width = book.shape
    rows = len(tree.order) // parts
    key = np.repeat(np.arange(parts), rows) * entries + entry
    run = np.flatnonzero(np.append(True, np.diff(key) != 0))
    ends = np.append(run[1:], len(key))
    total = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(tree.points[tree.order], axis=0, dtype=np.int64)])
    counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
    np.add.at(counts, key[run], ends - run)
    np.add.at(sums, key[run], total[ends] - total[run])
    return counts.reshape(parts, entries), sums.reshape(parts, entries, width)


def _tree_table(kept: DataFrame, parts: int, dim: int, scale: int) -> DataFrame:
    """One row for each block of vectors: its ids and labels, and the trees of its parts."""
    rows_of = kept.select("vec_id", "label").schema
    kind = T.StructType([T.StructField("members", T.ArrayType(rows_of))] + [T.StructField(f, T.BinaryType()) for f in CoverTree.FIELDS])
    most = max(1, BLOCK_VALUES // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def block() -> pa.RecordBatch:
            joined = pa.Table.from_batches(held).combine_chunks()
            vectors = whole_numbers(joined.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), scale, LIMIT)
            packed = build_trees(vectors.reshape(-1, dim), parts).pack()
            members = pa.StructArray.from_arrays([joined.column(c).combine_chunks() for c in ("vec_id", "label")], ["vec_id", "label"])
            lists = pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), members)
            return pa.RecordBatch.from_arrays([lists, *[pa.array([packed[f]], pa.binary()) for f in CoverTree.FIELDS]],
                                              ["members", *CoverTree.FIELDS])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, most - rows)
                held.append(piece)
                rows += piece.num_rows
                at += piece.num_rows
                if rows == most:
                    yield block()
                    held, rows = [], 0
        if rows:
            yield block()

    return stored(kept.select("vec_id", "label", "embedding").mapInArrow(run, kind), "covertrees", BLOCKS_PER_FILE)


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, CoverTree]]:
    for i in range(batch.num_rows):
        fields = {f: batch.column(f)[i].as_buffer() for f in CoverTree.FIELDS}
        yield batch.column("members")[i].values, CoverTree.unpack(fields, width)


def _next_books(trees: DataFrame, book: np.ndarray) -> np.ndarray:
    """One Lloyd round: entries become the floor of their points' mean, unused ones stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tree in _trees(batch, book.shape[2]):
                counts, sums = entry_sums(tree, assign(tree, book), book)
                used, position = np.repeat(np.flatnonzero(counts), book.shape[2]), np.tile(np.arange(book.shape[2]), int((counts > 0).sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(position.astype(np.int32)),
                     pa.array(counts.reshape(-1)[used]), pa.array(sums.reshape(-1, book.shape[2])[used, position])],
                    ["entry", "position", "members", "total"])

    added = (trees.mapInArrow(run, "entry int, position int, members long, total long")
             .groupBy("entry", "position").agg(F.sum("members").alias("members"), F.sum("total").alias("total")))
    out = book.reshape(-1, book.shape[2]).copy()
    for r in added.collect():  # at most one row for each number of the codebooks
        out[r["entry"], r["position"]] = r["total"] // r["members"]
    return out.reshape(book.shape)


def _coded(trees: DataFrame, kept: DataFrame, book: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    parts, _, width = book.shape
    kind = T.StructType([*kept.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = np.array([f"{i:02x}" for i in range(max(256, book.shape[1]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, tree in _trees(batch, width):
                entry = np.empty(len(tree.order), np.int64)
                entry[tree.order] = assign(tree, book)
                entry = entry.reshape(parts, -1)
                found = book[np.arange(parts)[:, None], entry]
                gap = tree.points.reshape(parts, -1, width) - found
                error = np.einsum("prw,prw->r", gap, gap)
                code = ["".join(row) for row in digits[entry.T]]
                yield pa.RecordBatch.from_arrays([members.field("vec_id"), members.field("label"), pa.array(code, pa.string()), pa.array(error)],
                                                 ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, kind)


def first_books(kept: DataFrame, parts: int, entries: int, scale: int, dim: int) -> np.ndarray:
    """The parts of the vectors with the least vec_ids."""
    ids = [r[0] for r in kept.select("vec_id").filter("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return np.zeros((parts, 1, dim // parts), np.int64)
    seeds = kept.filter(F.col("vec_id") <= ids[-1]).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect()
    vectors = whole_numbers(np.array([r["embedding"] for r in seeds], np.float64), scale, LIMIT)
    return np.ascontiguousarray(vectors.reshape(len(seeds), parts, -1).swapaxes(0, 1))


def books_text(book: np.ndarray) -> str:
    return ",".join(map(str, book.reshape(-1).tolist()))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector of ``vectors``
    (columns vec_id, embedding, label)."""
    bound_batches(vectors.sparkSession)
    kept = vectors.select("vec_id", "label", "embedding").filter(finite(F.col("embedding")))
    dim = dimension(kept, parts)
    kept = kept.filter(F.size("embedding") == (dim or 0)) if dim else kept.filter(F.lit(False))
    book = first_books(kept, parts, entries, scale, dim) if dim else np.zeros((parts, 1, 1), np.int64)
    trees = _tree_table(kept, parts, dim or parts, scale)
    for _ in range(rounds):
        book = _next_books(trees, book)
    coded = stored(_coded(trees, kept, book), "codes")
    by_label = coded.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error"))
    return (coded.join(by_label, coded["label"].eqNullSafe(by_label["__label"]))
            .select("vec_id", "label", "code", "error", "label_error",
                    F.lit(hashlib.sha256(books_text(book).encode()).hexdigest()).alias("codebooks_sha256")))


_ROUND = """
near{k} AS MATERIALIZED (
  SELECT p.rid, p.part, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.v, b.v)])::BIGINT * 64 + b.entry) AS best
  FROM pts p JOIN book{k} b USING (part) GROUP BY p.rid, p.part)"""
_BOOK = """
sums{n} AS (
  SELECT part, entry, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
  FROM (SELECT n.part, n.best % 64 AS entry, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS j
        FROM near{k} n JOIN pts p USING (rid, part)) GROUP BY part, entry, j),
mean{n} AS (SELECT part, entry, list(x ORDER BY j) AS v FROM sums{n} GROUP BY part, entry),
book{n} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{n} m USING (part, entry))"""

ORACLE = (r"""
WITH finite AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
size AS (SELECT len(embedding) AS dim FROM finite WHERE len(embedding) > 0 AND len(embedding) % 16 = 0
         GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding,
         [floor(x::DOUBLE * 256)::BIGINT for x in embedding] AS ints, dim // 16 AS w
  FROM finite, size WHERE len(embedding) = dim),
pts AS MATERIALIZED (
  SELECT rid, part, ints[part * w + 1:part * w + w] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
seed AS (SELECT vec_id, min(embedding) AS embedding, any_value(w) AS w FROM kept WHERE vec_id IS NOT NULL
         GROUP BY vec_id ORDER BY vec_id LIMIT 64),
book0 AS MATERIALIZED (
  SELECT part, entry, [floor(x::DOUBLE * 256)::BIGINT for x in embedding[part * w + 1:part * w + w]] AS v
  FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, embedding, w FROM seed), (SELECT unnest(range(16)) AS part)),"""
          + _ROUND.format(k=0) + "," + _BOOK.format(k=0, n=1) + "," + _ROUND.format(k=1) + "," + _BOOK.format(k=1, n=2) + ","
          + _ROUND.format(k=2) + """,
coded AS (SELECT rid, string_agg(format('{:02x}', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error
          FROM near2 GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), books""")

"""N-gram Jaccard join by grouped prefixes (operator 9).

A document is the set of its distinct word shingles. Two link when
100 * |intersection| >= percent * |union|; the result is the connected components.

1. Shingles are put in one global order: by hash, but those that many documents share
   come last, by frequency. (The frequent ones are found by counting; at most
   ``HOT_MOST`` are named, and any such list gives right results, it only decides how
   many candidates arise.) A document of n shingles can only link with one that shares
   one of its first n - ceil(percent * n / 100) + 1 shingles, its prefix.
2. Equal sets collapse into a class, and classes with the same prefix and size into a
   group. Only groups are joined on prefix shingles.
3. First round: in each bucket (one shingle) every group is compared with one member
   only, the one with the most frequent-shingle prefix, the likely original; and inside a
   group every class with the group's head. Work is linear in the bucket, and a large
   group of near copies becomes one component.
4. Second round, for the links that remain: buckets whose groups lie in one component
   are done. In the others, groups of *different* components are paired (the bucket's
   largest component against the rest, then the rest among themselves), so copies never
   meet as all pairs; a group whose classes lie in several components is paired with itself. Of the smaller set a shorter prefix is enough (an overlap of
   2 p n / (100 + p) is needed of its n). Pairs pass exact bounds: from their sizes, from the place of the
   shared shingle, from the shingles of a prefix that no other prefix holds, and from the
   shared part of the prefixes (if x is the one whose prefix ends earlier, the overlap is
   at most n_x - p_x + shared).
5. Group pairs (a group with itself, too) expand to class pairs of different components, which are verified on the
   whole sets. Links of both rounds give the components; no link between different
   components is lost, whatever the frequency list was.

Texts are read in three passes and are not shuffled, but for those of candidate classes:
a Bloom filter of their ids (bounded broadcast) picks them out.

Defined cases: a null text is empty; without words a document has no shingles and links
with nothing; fewer words than a shingle: the whole sequence is its one shingle; equal
texts link; a null doc_id never is the component's id unless all are null; other columns
are not looked at; an empty table gives an empty result. Sets and shingles are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, largest, release_memory, stored, text_or_empty
from .components import components
from .shingles import mix, shingle_set

WORDS = 4
PERCENT = 85
HOT_MOST = 2**19      # frequent shingles named, at most
HOT_DOCS = 6          # documents counted that share a frequent shingle, at least
FLAG_BITS = 25        # flags of shingles met, in a counting task
BLOCK = 500_000       # shingles met again that a task holds
LARGE = 4096          # pairs of groups from which on a bucket counts as large
ID_FILTER_BITS = 2**26


def hot_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, document counts) of shingles that many documents share.

    A task marks the shingles it has met in a table of flags and reports those that it meets
    again; a table that is a quarter full is emptied. A shingle whose flag another has set is
    reported as well, which only makes it a candidate of the count that follows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, marked = np.zeros(1 << FLAG_BITS, bool), 0
        again, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(again), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64) + 1)], names=["shingle", "n"])

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), words)
                slot = (s >> np.uint64(64 - FLAG_BITS)).view(np.int64)
                known = met[slot]
                met[slot] = True
                marked += len(s)
                if known.any():
                    again.append(s[known])
                    size += len(again[-1])
                if size >= BLOCK:
                    yield flush()
                    again, size = [], 0
                if marked >= 1 << (FLAG_BITS - 2):
                    met[:] = False
                    marked = 0
        if size:
            yield flush()
        del met, again
        release_memory()

    often = stored(texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
                   .filter(F.col("n") >= HOT_DOCS), "frequent")
    rows = largest(often, "n", HOT_MOST).toPandas().sort_values("shingle")
    return rows["shingle"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


_DESCRIBED = ("doc_id long, h long, n int, class long, grp long, hot int, last_n long, last_hash long, idx_n long, idx_hash long, "
              "prefix array<long>")


def describe(docs: DataFrame, words: int, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Size, class, group and ordered prefix of each document (doc_id, text, h: a hash of the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_hash, hot_n = shared.value
        for batch in batches:
            rows, lists = [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words).view(np.int64)
                n = len(s)
                if not n:
                    rows.append((0,) * 8)
                    lists.append(s)
                    continue
                s = np.sort(s)
                seen = np.zeros(n, np.int64)
                if len(hot_hash):
                    at = np.minimum(np.searchsorted(hot_hash, s), len(hot_hash) - 1)
                    seen = np.where(hot_hash[at] == s, hot_n[at], 0)
                order = np.lexsort((s, seen))
                p = n - (percent * n + 99) // 100 + 1
                first = s[order[:p]]
                key = fold(first, n)
                last, idx = order[p - 1], order[n + (-2 * percent * n) // (100 + percent)]
                rows.append((n, fold(s, 1), key, int((seen[order[:p]] > 0).sum()), int(seen[last]), int(s[last]),
                             int(seen[idx]), int(s[idx])))
                lists.append(first)
            cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 8
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            n, cls, grp, heat, *ends_at = cols
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n.astype(np.int32)), pa.array(cls), pa.array(grp), pa.array(heat.astype(np.int32)),
                 *map(pa.array, ends_at), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=[f.split()[0] for f in _DESCRIBED.split(", ")])
        release_memory()
    return docs.mapInArrow(run, _DESCRIBED)


def fold(values: np.ndarray, salt: int) -> int:
    """64-bit hash of a sequence (signed)."""
    v = values.view(np.uint64)
    place = mix(np.arange(1, len(v) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    return int(mix((mix(v ^ place) * (place | np.uint64(1))).sum(keepdims=True) + np.uint64(len(v))).view(np.int64)[0])


def _prefix_size(n: Column, percent: int) -> Column:
    return n - F.floor((percent * n + 99) / 100) + 1


def _may_link(percent: int) -> Column:
    """Exact bound on rows (na, nb, la, lb, shared): sizes, and the earlier prefix's misses."""
    na, nb = F.col("na"), F.col("nb")
    a_first = F.col("la") <= F.col("lb")
    most = F.when(a_first, na - _prefix_size(na, percent)).otherwise(nb - _prefix_size(nb, percent)) + F.col("shared")
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * most >= percent * (na + nb))


def _index_size(n: Column, percent: int) -> Column:
    """Prefix that is enough for the smaller set of a pair: n - ceil(2 p n / (100 + p)) + 1."""
    return n - F.floor((2 * percent * n + 99 + percent) / (100 + percent)) + 1


def _may_link_by_index(percent: int) -> Column:
    """As ``_may_link``, for shingles counted in the index prefix of the smaller set (ia, ib)."""
    na, nb, c = F.col("na"), F.col("nb"), F.col("shared")
    a_small = na <= nb  # with equal sizes the lesser group, which is ga

    def most(small, big, index, last):
        return F.when(index <= last, small - _index_size(small, percent)).otherwise(big - _prefix_size(big, percent)) + c
    overlap = F.when(a_small, most(na, nb, F.col("ia"), F.col("lb"))).otherwise(most(nb, na, F.col("ib"), F.col("la")))
    return (100 + percent) * overlap >= percent * (na + nb)


def _first_shared() -> Column:
    """In a large bucket: no shingle of a large bucket before this one is in both prefixes."""
    before = [F.slice(f"items{s}", F.lit(1), F.col(f"at{s}")) for s in "ab"]
    return ~F.col("largea") | ~F.arrays_overlap(*before)


def _shared_large(small: str, big: str) -> Column:
    """How many shingles of large buckets the smaller set's index prefix shares with the other's prefix."""
    return F.size(F.array_intersect(F.slice(f"items{small}", F.lit(1), F.col(f"indexed{small}")), F.col(f"items{big}")))


def _within_reach(percent: int) -> Column:
    """Exact bounds on a pair that shares a shingle at places posa and posb of its orders."""
    most = F.least("posa", "posb") + 1 + F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) - 1
    # a lone shingle of the prefix that ends first is not in the other set; one of the other
    # prefix is not in this set if it comes before the end of this prefix, as every plain
    # shingle does where that end is a frequent one. The two are of different groups.
    a_first = F.col("la") <= F.col("lb")
    wide = F.when(a_first, F.col("la.last_n")).otherwise(F.col("lb.last_n")) > 0
    left = F.col("na") - F.when(a_first | wide, F.col("lonea")).otherwise(0)
    right = F.col("nb") - F.when(~a_first | wide, F.col("loneb")).otherwise(0)
    enough = lambda overlap: (100 + percent) * overlap >= percent * (F.col("na") + F.col("nb"))
    return enough(most) & enough(F.least(left, right))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold."""
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
        release_memory()
    left = sets.select(F.col("class").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def id_filter(ids: DataFrame, bits: int = ID_FILTER_BITS) -> DataFrame:
    """Bloom words of a table of ids (``id``): at most bits / 64 rows, whatever the table."""
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    return ids.groupBy(F.floor(slot / 64).cast("long").alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def maybe_in(docs: DataFrame, id_col: Column, words: DataFrame, bits: int = ID_FILTER_BITS) -> DataFrame:
    """Add boolean ``__maybe``: false only if the row's id is not in the filtered table."""
    slot = F.pmod(F.xxhash64(id_col), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    out = docs.join(F.broadcast(words), F.floor(slot / 64).cast("long") == F.col("__word"), "left")
    return out.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


def class_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, items) for the classes of ``wanted`` (class, id: a document that has this set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(shingle_set(t.as_py(), words).view(np.int64)) for t in batch.column("text")]
            found = pa.array([fold(s, 1) if len(s) else 0 for s in sets], pa.int64())
            made = pa.RecordBatch.from_arrays([found, pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "items"])
            yield made.filter(pc.equal(found, batch.column("class")))
        release_memory()
    rows = maybe_in(texts, F.col("doc_id"), id_filter(wanted.select("id"))).filter("__maybe").select("doc_id", "text")
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")))
    return stored(rows.select("class", "text").mapInArrow(run, "class long, items binary").dropDuplicates(["class"]), "sets")


def link_classes(described: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that determine the components."""
    full = described.filter("n > 0")
    members = stored(full.groupBy("class", "grp").agg(F.min("doc_id").alias("id")), "members")
    # most groups are one document: only the others meet in a shuffle
    cols = ["grp", "n", "hot", "last_n", "last_hash", "idx_n", "idx_hash", "prefix"]
    several = full.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("grp").alias("id"))
    marked = maybe_in(full.select(*cols), F.col("grp"), id_filter(several))
    groups = marked.filter("not __maybe").select(*cols).unionByName(
        marked.filter("__maybe").groupBy("grp").agg(*[F.first(c).alias(c) for c in cols[1:]]))
    postings = groups.select("grp", "n", "hot", F.struct("last_n", "last_hash").alias("l"),
                             F.struct(F.col("idx_n").alias("last_n"), F.col("idx_hash").alias("last_hash")).alias("i"),
                             F.posexplode("prefix").alias("pos", "item"))
    # buckets of one group link no groups (its own classes are compared by their group, in both
    # rounds); the others are found by their shingle alone
    repeated = stored(postings.groupBy("item").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
                      .select(F.col("item").alias("id")), "items")
    some = maybe_in(postings, F.col("item"), id_filter(repeated)).filter("__maybe").drop("__maybe")
    shared = stored(some.join(repeated, F.col("item") == F.col("id"), "left_semi"), "buckets")
    # the member that all of a bucket are compared with
    head = F.min(F.struct((-F.col("hot")).alias("cold"), "grp", "n", "l")).alias("head")
    led = shared.select("item", "grp", "n", "l").join(shared.groupBy("item").agg(head), "item")
    heads = members.groupBy("grp").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("k"))
    heads = stored(heads, "heads")

    # first round: everything with one member
    star = (led.filter(F.col("grp") != F.col("head.grp")).groupBy(F.col("head.grp").alias("ga"), F.col("grp").alias("gb"))
            .agg(F.first("head.n").alias("na"), F.first("n").alias("nb"), F.first("head.l").alias("la"),
                 F.first("l").alias("lb"), F.count(F.lit(1)).alias("shared"))
            .filter(_may_link(percent)))
    of = lambda g, c: heads.select(F.col("grp").alias(g), F.col("head").alias(c))
    first = star.join(of("ga", "a"), "ga").join(of("gb", "b"), "gb").select("a", "b")
    inside = members.join(heads.filter("k > 1").select("grp", F.col("head").alias("a")), "grp").filter(
        F.col("class") != F.col("a")).select("a", F.col("class").alias("b"))
    pairs = stored(first.unionByName(inside), "pairs")
    links = stored(verify(pairs, class_sets(texts, _wanted(pairs, members), words), percent), "links")

    # second round: what lies in different components
    label = components(links)
    placed = members.join(label, F.col("class") == F.col("node"), "left").select(
        "class", "grp", F.coalesce("label", "class").alias("comp"))
    placed = stored(placed, "placed")
    # shingles of a prefix that no other group's prefix holds; only those before the frequent ones
    plain = _prefix_size(F.col("n"), percent) - F.col("hot")
    lone = shared.groupBy("grp").agg(F.first(plain).alias("plain"), F.count_if(F.col("pos") < plain).alias("k")) \
        .select("grp", (F.col("plain") - F.col("k")).alias("lone"))
    at = placed.select("grp", "comp").distinct().join(lone, "grp")
    rows = shared.select("item", "grp", "n", "l", "i", "pos").join(at, "grp")
    per = rows.groupBy("item", "comp").agg(F.count(F.lit(1)).alias("k"))
    most = per.groupBy("item").agg(F.max(F.struct("k", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("all")) \
        .filter("comps > 1").select("item", F.col("m.comp").alias("main"), ((F.col("all") - F.col("m.k")) * F.col("all") >= LARGE).alias("large"))
    rows = stored(rows.join(most, "item"), "mixed")
    # rows of large buckets carry the group's shingles in large buckets, in order: a pair meets at the first only
    own = rows.filter("large").groupBy("grp").agg(F.array_sort(F.collect_set(F.struct("pos", "item"))).alias("own"), F.first("n").alias("size"))
    own = own.select("grp", F.col("own.item").alias("items"), F.size(F.filter(
        "own", lambda x: x["pos"] < _index_size(F.col("size"), percent))).alias("indexed"))
    none = rows.filter("not large").withColumns({"items": F.array().cast("array<long>"), "indexed": F.lit(0), "at": F.lit(0)})
    rows = stored(none.unionByName(rows.filter("large").join(own, "grp").withColumn(
        "at", F.array_position("items", F.col("item")).cast("int") - 1)), "ordered")
    rest = rows.filter("comp != main")
    side = lambda df, s: df.select("item", *[F.col(c).alias(c + s) for c in (
        "grp", "n", "l", "i", "pos", "lone", "comp", "large", "items", "at", "indexed")])
    cross = side(rest, "a").join(side(rows.filter("comp = main"), "b"), "item").unionByName(
        side(rest, "a").join(side(rest, "b"), "item").filter("compa < compb"))
    a_small = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("grpa") < F.col("grpb")))
    in_index = F.when(a_small, F.col("posa") < _index_size(F.col("na"), percent)) \
        .otherwise(F.col("posb") < _index_size(F.col("nb"), percent))
    cross = cross.filter((F.col("grpa") != F.col("grpb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & in_index & _within_reach(percent) & _first_shared())
    both = F.when(F.col("largea"), F.when(a_small, _shared_large("a", "b")).otherwise(_shared_large("b", "a"))).otherwise(1)
    cross = cross.withColumn("both", both)
    swap = F.col("grpa") > F.col("grpb")
    cross = cross.select("item", "both", *[F.when(swap, F.col(c + "b")).otherwise(F.col(c + "a")).alias(o) for c, o in
                                   (("grp", "ga"), ("n", "na"), ("l", "la"), ("i", "ia"))],
                         *[F.when(swap, F.col(c + "a")).otherwise(F.col(c + "b")).alias(o) for c, o in
                           (("grp", "gb"), ("n", "nb"), ("l", "lb"), ("i", "ib"))])
    # one item may reach a group pair through several component pairs; it counts once
    sides = ("na", "nb", "la", "lb", "ia", "ib")
    counted = cross.groupBy("ga", "gb", "item").agg(*[F.first(c).alias(c) for c in (*sides, "both")])
    counted = counted.groupBy("ga", "gb").agg(*[F.first(c).alias(c) for c in sides], F.sum("both").alias("shared"))
    # a group whose classes lie in several components meets itself, whether or not another shares its prefix
    split = placed.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
    groups2 = counted.filter(_may_link_by_index(percent)).select("ga", "gb").unionByName(
        split.select(F.col("grp").alias("ga"), F.col("grp").alias("gb")))
    pa_ = placed.select(F.col("grp").alias("ga"), F.col("class").alias("a"), F.col("comp").alias("ca"))
    pb_ = placed.select(F.col("grp").alias("gb"), F.col("class").alias("b"), F.col("comp").alias("cb"))
    again = groups2.join(pa_, "ga").join(pb_, "gb").filter("ca != cb").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs2 = stored(again.join(done, ["a", "b"], "left_anti"), "pairs")
    more = verify(pairs2, class_sets(texts, _wanted(pairs2, members), words), percent)
    return stored(links.unionByName(more), "links")


def _wanted(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(class, id) for the classes of the pairs."""
    classes = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    return stored(members.select("class", "id").join(classes, "class"), "wanted")


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return _joined(docs, words, percent, id_col, text_col).drop("h")


def _joined(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """join_components with ``h``, the hash of each row's text."""
    bound_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    hot = hot_shingles(texts.select("text"), words)
    described = stored(describe(texts, words, percent, hot), "described")
    links = link_classes(described, texts, words, percent)
    label = components(links)
    narrow = described.select("doc_id", "h", "n", "class")
    least = narrow.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("id"))
    placed = least.join(label, F.col("class") == F.col("node"), "left").select(
        "class", "id", F.coalesce("label", "class").alias("comp"))
    placed = stored(placed, "classes")
    comps = placed.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    # classes of one component are few next to its documents; documents join by class
    of_class = stored(placed.join(comps, "comp").select("class", "component_id"), "components")
    out = narrow.join(of_class.withColumnRenamed("class", "__class"), F.col("class") == F.col("__class"), "left")
    return out.select("doc_id", "h", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the least id, with its own columns.

    A document is named by its id and its text: of several texts with one id, each is judged
    by its own component, and of those in one component the least by text hash stays. Rows
    alike in id and text are one document. Rows with a null id stay. Only rows that may be dropped
    (Bloom filter of the dropped documents) are shuffled; the rest pass straight through."""
    found = stored(_joined(docs, words, percent, id_col, text_col).filter("doc_id is not null and component_id is not null"), "found")
    named = [F.col("doc_id").alias("doc"), F.col("h").alias("hash")]
    later = found.filter("doc_id != component_id").select(*named)
    # texts that share the least id of their component
    first = found.filter("doc_id = component_id and n_shingles > 0").groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    twins = found.filter("n_shingles > 0").join(first.filter("low != high").select(F.col("doc_id").alias("id"), "low"),
                                                (F.col("doc_id") == F.col("id")) & (F.col("component_id") == F.col("id")))
    key = F.xxhash64("doc", "hash").alias("id")
    gone = stored(later.unionByName(twins.filter("h != low").select(*named)).distinct().select("*", key), "dropped")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    own = docs.select(row, F.col(id_col).cast("long").alias("__doc"), F.xxhash64(text_or_empty(text_col)).alias("__hash"))
    marked = maybe_in(own, F.xxhash64("__doc", "__hash"), id_filter(gone))
    stay = marked.filter("__maybe").join(gone, (F.col("__doc") == F.col("doc")) & (F.col("__hash") == F.col("hash")), "left_anti")
    return marked.filter("not __maybe").select("__row.*").unionByName(stay.select("__row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END AS shingles FROM w),
n AS (SELECT doc_id, len(list_distinct(shingles)) AS n FROM l),
s AS (SELECT doc_id, unnest(list_distinct(shingles)) AS s FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(min(r.b), n.doc_id) AS component_id
FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

"""Cover-tree Lloyd coding against plain nearest-entry loops and SQL."""

import hashlib

import numpy as np
import pytest

from passforge.llm import covercode as cc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, members int"


def vectors(rows=150, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(rows, dim)).astype(np.float32)
    out[20:60] = out[3]  # a third are copies
    return out


def table(spark, seed=1):
    rows = [(i * 3 % 151, v.tolist(), i % 4 if i % 5 else None, "x", 1) for i, v in enumerate(vectors(seed=seed))]
    rows += rows[7:9]  # whole rows again
    rows += [(None, rows[4][1], None, None, None), (None, None, None, None, None), (900, None, 1, "x", 1),
             (901, [float("nan")] * 64, 1, "x", 1), (-1, [None] + [1.0] * 63, 1, "x", 1), (902, [float("inf")] + [0.0] * 63, 2, "x", 1),
             (903, [], 1, "x", 1), (904, [1.0] * 32, 1, "x", 1), (905, [1e30] + [0.0] * 63, 1, "x", 1), (5, [0.5] * 64, 1, "y", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def plain(rows, parts=16, entries=64, rounds=2):
    """The contract as loops: id, label, code, error, label error, digest."""
    kept = [(r[0], r[2], [float(x) for x in r[1]]) for r in rows
            if r[1] is not None and len(r[1]) == 64 and all(x is not None and np.isfinite(x) for x in r[1])]
    ints = np.array([[min(max(int(np.floor(256 * x)), -cc.LIMIT), cc.LIMIT) for x in v] for _, _, v in kept], np.int64)
    cut = ints.reshape(len(kept), parts, -1)
    seeds = {}
    for k, (i, _, v) in enumerate(kept):
        if i is not None and (i not in seeds or v < kept[seeds[i]][2]):
            seeds[i] = k
    book = np.stack([cut[seeds[i]] for i in sorted(seeds)[:entries]])  # entry, part, position

    def nearest():
        d = ((cut[:, None] - book[None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        at, _ = nearest()
        fresh = book.copy()
        for p in range(parts):
            for e in range(len(book)):
                own = cut[at[:, p] == e, p]
                if len(own):
                    fresh[e, p] = own.sum(0) // len(own)
        book = fresh
    at, d = nearest()
    error = d.sum(1).tolist()
    by_label = {}
    for (_, label, _), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in range(parts) for b in book for x in b[p].tolist()).encode()).hexdigest()
    return [(i, label, "".join(f"{c:02x}" for c in code), e, by_label[label], digest)
            for (i, label, _), code, e in zip(kept, at.tolist(), error, strict=True)]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_tree_invariants():
    ints = np.floor(np.random.default_rng(2).normal(size=(700, 32)) * 30).astype(np.int64)
    ints[100:300] = ints[5]
    tree = cc.build_trees(ints, 8)
    assert (np.sort(tree.order.reshape(8, -1), 1) == np.arange(8 * 700).reshape(8, -1)).all()
    for i in range(len(tree.start)):
        own = tree.order[tree.start[i]:tree.end[i]]
        assert tree.centre[i] in own
        assert cc._square(tree.points[own], tree.points[tree.centre[i]]).max() == tree.reach[i]
        if tree.child[i] < 0:
            continue
        below = np.arange(tree.child[i], tree.child[i] + tree.children[i])
        assert tree.start[below[0]] == tree.start[i] and tree.end[below[-1]] == tree.end[i]
        assert tree.centre[below[0]] == tree.centre[i]  # nesting
        radius = 2 ** (np.ceil(0.5 * np.log2(tree.reach[i])) - 1)
        limit = int(radius) ** 2
        assert (tree.reach[below] <= limit).all()  # covering
        heads = tree.points[tree.centre[below]].astype(int)
        for k, h in enumerate(heads):  # separation
            assert (((heads[k + 1:] - h) ** 2).sum(1) > limit).all()


@pytest.mark.parametrize("seed", range(6))
def test_assignment_equals_all_distances(seed):
    rng = np.random.default_rng(seed)
    ints = np.floor(rng.normal(size=(400, 32)) * rng.choice([1, 4, 60])).astype(np.int64)  # few values: many ties
    book = np.ascontiguousarray(ints[rng.integers(0, 400, 20)].reshape(20, 8, 4).swapaxes(0, 1))
    book[:, -1] = book[:, 2]
    tree = cc.CoverTree.unpack(cc.build_trees(ints, 8).pack(), 4)
    entry = cc.assign(tree, book)
    got = np.empty(len(entry), int)
    got[tree.order] = entry
    cut = ints.reshape(400, 8, 4).swapaxes(0, 1)
    want = ((cut[:, :, None] - book[:, None]) ** 2).sum(-1).argmin(2)
    assert (got.reshape(8, -1) == want).all()
    counts, sums = cc.entry_sums(tree, entry, book)
    for p in range(8):
        for e in range(20):
            assert counts[p, e] == (want[p] == e).sum() and (sums[p, e] == cut[p][want[p] == e].sum(0)).all()


def test_far_subtrees_are_given_whole():
    rng = np.random.default_rng(3)
    ints = np.concatenate([rng.integers(0, 9, (4000, 4)), rng.integers(0, 9, (4000, 4)) + 5000])
    tree = cc.build_trees(ints, 1)
    seen = []
    nearest = cc._nearest
    try:
        cc._nearest = lambda points, part, book: seen.append(len(points)) or nearest(points, part, book)
        cc.assign(tree, np.array([[[0, 0, 0, 0], [5000, 5000, 5000, 5000]]]))
    finally:
        cc._nearest = nearest
    assert sum(seen) < 200  # of 8,000 points


def test_compress_equals_loops(spark, monkeypatch):
    df, rows = table(spark)
    got = cc.compress(df)
    want = plain(rows)
    assert order(got.collect()) == order(want)
    monkeypatch.setattr(cc, "BLOCK_VALUES", 640)  # blocks of ten vectors
    assert order(cc.compress(df.coalesce(1)).collect()) == order(want)


def test_few_and_no_rows(spark):
    df, rows = table(spark)
    one = df.filter("vec_id = 5")
    assert order(cc.compress(one).collect()) == order(plain([r for r in rows if r[0] == 5]))
    assert cc.compress(df.filter("false")).collect() == []
    assert cc.compress(df.filter("embedding IS NULL")).collect() == []
    nulls = cc.compress(df.filter("vec_id IS NULL")).collect()
    assert [(r.code, r.error) for r in nulls] == [("00" * 16, 0)]


def test_query_equals_sql(spark):
    import duckdb

    from passforge.llm import queries

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = db.sql(queries.oracle_sql()["op13_codes"])
    got = queries.queries()["op13_codes"](spark, d)
    assert got.columns == want.columns
    assert order(got.collect()) == order(want.fetchall())

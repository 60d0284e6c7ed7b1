"""Exact dedup, mixing and line dedup: brute force, awkward rows, plans without Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from passforge.llm import exact, linededup, mixing
from llm_docs import awkward, empty, frame


def low(text):
    return (text or "").encode().lower().decode()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [64, exact.FILTER_BITS])  # a full filter gives the same result
def test_exact_dedup_against_groups(spark, bits):
    df = exact.annotate(frame(spark), filter_bits=bits)
    assert not re.search("Python|Pandas|Arrow", plan(df))
    rows = [r.asDict() for r in df.collect()]
    data = awkward()
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[low(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in sorted(ids, key=lambda x: (x is not None, x), reverse=True):
            want[(i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest())] += 1
            first = first and i != keep
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows)
    assert got == want
    assert sum(r["kept"] for r in rows) == len(groups)


def test_exact_dedup_keeps_whole_rows(spark):
    kept = exact.dedup(frame(spark)).collect()
    assert set(kept[0].asDict()) == set(frame(spark).columns)
    assert Counter(low(r["text"]) for r in kept) == Counter({low(t): 1 for _, t, *_ in awkward()})


def test_exact_dedup_empty(spark):
    assert exact.annotate(empty(spark)).count() == 0 and exact.dedup(empty(spark)).count() == 0


def expected_targets(rows):
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in over)
        free -= set(over)
    return size, target


def test_mixing_targets_and_amounts(spark):
    df = mixing.plan_mix(frame(spark))
    assert not re.search("Python|Pandas|Arrow", plan(df))
    rows = df.collect()
    data = awkward()
    size, target = expected_targets(data)
    source = {i: s for i, _, _, s, *_ in data if i is not None}
    assert len(rows) == len(data)
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == size[s] and r.target == pytest.approx(target[s])
            taken[s] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 130  # within a document (repeated rows share a draw)
    again = mixing.plan_mix(frame(spark)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_mixing_ranks_by_draw_and_inclusion(spark):
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 400)), "abc"[i % 3]) for i in range(3000)]
    rows += [(9000 + i, "only one word".split()[0], "c") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(df).collect()
    by_source = defaultdict(list)
    for r in got:
        by_source[rows[r.doc_id][2] if r.doc_id < 9000 else "c"].append(r)
    for own in by_source.values():
        target = own[0].target
        assert abs(sum(r.taken for r in own) - target) <= 400
        whole = int(target // own[0].source_size)
        rate = [sum(r.copies > whole for r in own if (r["size"] > 100) == long) / max(1, sum((r["size"] > 100) == long for r in own)) for long in (False, True)]
        if 0.02 < target / own[0].source_size - whole < 0.98:  # longer documents are likelier, shorter ones are drawn too
            assert rate[1] > rate[0] > 0


def test_mix_repeats_rows(spark):
    plan_rows = {(r.doc_id, r["size"]): r.copies for r in mixing.plan_mix(frame(spark)).collect()}
    got = Counter(r.doc_id for r in mixing.mix(frame(spark)).collect())
    want = Counter()
    for i, t, *_ in awkward():
        want[i] += plan_rows[(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))]
    assert +got == +want


def test_mixing_empty_and_wordless(spark):
    assert mixing.plan_mix(empty(spark)).count() == 0
    rows = mixing.plan_mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.taken) for r in rows] == [(0, 0), (0, 0)]


def test_line_dedup_drops_templates(spark):
    texts = [f"{chr(97 + i)} own words that nobody else has\nPosted on 2024-0{i} by user{i} at our site today\n\nend {chr(97 + i)}"
             for i in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, None), (11, ""), (12, "Posted on x by y at our site today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone, templates = linededup.recurring_lines(df)
    assert [(r.template, r.docs) for r in templates.collect()] == [("Posted on <*> by <*> at our site today", 6)]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert all(out[i] == "\n".join(x for x in texts[i].split("\n") if not x.startswith("Posted")) for i in range(6))
    assert out[10] == "" and out[11] == "" and out[12] == rows[-1][1]


def test_line_dedup_generalises_words(spark):
    rows = [(i, f"Read the full story about {w} on our partner page now") for i, w in enumerate(["cats", "dogs", "fish", "owls", "bees"])]
    rows += [(9, "Read the full story about cats on our partner page now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, templates = linededup.recurring_lines(df)
    assert [r.template for r in templates.collect()] == ["Read the full story about <*> on our partner page now"]
    report = linededup.line_report(df)
    assert not re.search("Python|Pandas|Arrow", plan(report))
    assert {(r.n_lines, r.n_dropped, r.n_chars) for r in report.collect()} == {(1, 1, 0)}


def test_line_dedup_finds_every_template_of_a_leaf(spark):
    words = "ant bee cat dog elk fox gnu hen ibis jay koi lynx".split()
    kinds = ["Read more about the {} section of our newspaper today", "Read more about the author {} and his other books",
             "Read more about the {} {} {} {} {}"]  # the third kind is one of a kind each
    rows = [(100 * k + i, f"{chr(97 + k)}{words[i]} speaks\n" + kind.format(*[w + str(k) * (j > 0) for j, w in enumerate(words[i:] + words[:i])]).replace("0", "z"))
            for k, kind in enumerate(kinds) for i, _ in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, templates = linededup.recurring_lines(df)
    found = {(r.template, r.docs) for r in templates.collect()}
    assert {t for t, _ in found} >= {"Read more about the <*> section of our newspaper today",
                                     "Read more about the author <*> and his other books"}
    dropped = {r.doc_id: r.n_dropped for r in linededup.line_report(df).collect()}
    assert all(dropped[100 * k + i] == 1 for k in (0, 1) for i in range(12))


@pytest.mark.parametrize("first,more", [(1, 2), (64, 512)])  # cores of a leaf in a round: few, and all at once
def test_line_dedup_takes_many_cores_of_a_leaf_at_once(spark, monkeypatch, first, more):
    monkeypatch.setattr(linededup, "FIRST_LINES", first, raising=False)
    monkeypatch.setattr(linededup, "MORE_LINES", more, raising=False)
    # one leaf: kinds that agree in 4 or 5 of 10 positions, some in 5 documents and more
    lines = [" ".join(["see", "all", "of", "it"] + [f"{chr(97 + k)}{chr(97 + (k * j) % 5)}x" for j in range(6)]) for k in range(24)]
    rows = [(100 * k + i, line + "\nown " + chr(97 + k) + chr(97 + i)) for k, line in enumerate(lines) for i in range(2 + k % 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.sparkContext.setJobGroup(group := f"cores-{first}", "line dedup")
    out = {r.doc_id: r.n_dropped for r in linededup.line_report(df).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out == {i: int(2 + i // 100 % 6 >= 5) for i, _ in rows}
    assert first == 1 or jobs < 60  # with one core of a leaf in a round it was 140


def test_line_dedup_equals_sql(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(6)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    heads = [["read", "all", "of", "this"], ["one", "two", "three", "four"], ["x", "y", "z", "q"]]
    line = lambda: " ".join(rng.choice(heads) + [rng.choice(words[:rng.choice([1, 2, 16])]) for _ in range(rng.randint(1, 6))])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(150)] + [(7, None), (None, line()), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "documents.parquet")
    df.write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = db.sql(linededup.ORACLE)
    got = linededup.line_report(df).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_line_dedup_of_a_very_long_text(spark):
    import time

    text = "\n".join("the same line in every document" if i % 2 else f"own {chr(97 + i % 26)} {'abcdefghij'[i % 10]} " + "k" * (i % 37) for i in range(200_000))
    rows = [(0, text)] + [(i, "the same line in every document\n" + "x" * i) for i in range(1, 8)]
    t = time.time()
    out = {r.doc_id: r for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].n_dropped >= 100_000 and out[0].n_lines == 200_000 and out[1].n_dropped == 1
    assert time.time() - t < 120


def test_line_dedup_awkward_and_empty(spark):
    out = linededup.dedup_lines(frame(spark))
    assert out.columns == frame(spark).columns and out.count() == len(awkward())
    assert linededup.line_report(empty(spark)).count() == 0

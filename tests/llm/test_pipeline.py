"""The pipeline stage by stage against brute force, and the registered queries."""

import re
from collections import Counter

import corpus_pipeline
from passforge.llm import bpe, mixing, quality, queries
from passforge.llm.common import stored, table
from test_links import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), "test"))
        kept[name] = [r.asDict() for r in seen[-1].collect()]
        assert seen[-1].columns[:5] == columns
    good, alone, apart, mixed, coded = kept.values()
    scores = {r.doc_id: r.score for r in quality.score(docs, table(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in good} == {i for i, s in scores.items() if s >= 0.5}
    best = {}
    for r in good:
        key = (r["text"] or "").encode().lower()
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert Counter(r["doc_id"] for r in alone) == Counter(best.values())
    comps = brute([(r["doc_id"], r["text"]) for r in alone], 5, 80)
    assert {r["doc_id"] for r in apart} == {i for i, (_, c) in comps.items() if i == c}
    copies = {r.doc_id: r.copies for r in mixing.plan_mix(seen[3]).collect()}
    assert Counter(r["doc_id"] for r in mixed) == +Counter(copies)
    codec = bpe.codec_for(bpe.vocabulary_path())
    assert Counter(r["doc_id"] for r in coded) == Counter(r["doc_id"] for r in mixed)
    assert all(r["token_ids"] == codec.encode(r["text"]) and r["n_tokens"] == len(r["token_ids"]) // 4 for r in coded)


def test_a_query_for_each_operator():
    names = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_native_queries_run_no_python(spark):
    for name in ("op4_line_dedup", "op5_mixing", "op8_exact_dedup"):
        df = queries.queries()[name](spark, SF)
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())

"""D1-D4, D7-D11, D14, D16, C1, E1 on tiny frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passforge.operators import metrics as m
from passforge.operators import verdicts as v
from passforge.operators.quantile import exact_percentile

RUNS = "experiment_id string, task_id string, model string, overall_pass int, latency_ms double, " \
       "prompt_tokens int, completion_tokens int"


def runs(spark, rows):
    return spark.createDataFrame(rows, RUNS)


def test_summarize_by_model_null_model_is_group(spark):
    df = runs(spark, [("e", "t1", "a", 1, 10.0, 1, 2), ("e", "t2", None, 0, 30.0, 3, 4), ("e", "t3", None, 1, 50.0, 5, 6)])
    out = {r["model"]: r for r in m.summarize_by_model(df).collect()}
    assert out[None]["n"] == 2 and out[None]["passed"] == 1 and out[None]["pass_rate"] == 0.5
    assert out[None]["mean_latency_ms"] == 40.0 and out[None]["tokens_in"] == 8 and out[None]["tokens_out"] == 10


def test_by_difficulty_keeps_null_and_heatmap_drops_it(spark):
    df = runs(spark, [("e", "t1", "a", 1, 1.0, 0, 0), ("e", "t9", "a", 0, 1.0, 0, 0)])
    meta = spark.createDataFrame([("t1", "Easy", "pub")], "task_id string, difficulty string, node_type string")
    d2 = {r["difficulty"]: r["n"] for r in m.summarize_by_difficulty(df, meta).collect()}
    assert d2 == {"Easy": 1, None: 1}
    d8 = m.pass_rate_model_difficulty(df, meta).collect()
    assert [(r["model"], r["difficulty"], r["pass_rate"]) for r in d8] == [("a", "Easy", 1.0)]
    piv = m.pass_rate_pivot(m.pass_rate_model_difficulty(df, meta), values=["Easy", "Hard"]).first()
    assert piv["Easy"] == 1.0 and piv["Hard"] is None


def test_no_meta_returns_runs(spark):
    df = runs(spark, [("e", "t1", "a", 1, 1.0, 0, 0)])
    assert m.summarize_by_difficulty(df, None).columns == df.columns


@pytest.mark.parametrize("accuracy", [20, 100, 2000])
def test_exact_percentile_matches_numpy(spark, accuracy):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(100, 30, 3000), np.full(1500, 42.0)])
    rows = [("e" if i % 3 else "f", float(x)) for i, x in enumerate(vals)]
    df = spark.createDataFrame(rows, "experiment_id string, latency_ms double")
    got = {r["experiment_id"]: r["p"] for r in
           exact_percentile(df, "latency_ms", 0.95, ["experiment_id"], alias="p", accuracy=accuracy).collect()}
    for e in ("e", "f"):
        want = np.quantile([x for k, x in rows if k == e], 0.95)
        assert got[e] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("p", [0.0, 0.001, 0.5, 0.999, 1.0])
def test_exact_percentile_at_the_ends(spark, p):
    rng = np.random.default_rng(8)
    vals = rng.lognormal(3, 2, 5000)
    df = spark.createDataFrame([(float(x),) for x in vals], "v double").repartition(7)
    assert exact_percentile(df, "v", p).first()[0] == pytest.approx(np.quantile(vals, p), rel=1e-12)


def test_summary_sets_equal_the_single_frames(spark):
    rows = [("e", f"t{i % 7}", m_, i % 2, float(i), i, 2 * i) for i in range(40) for m_ in ("a", None, "b")][:77]
    df = runs(spark, rows)
    meta = spark.createDataFrame([("t0", "Easy", "pub"), ("t1", "Hard", None), ("t2", None, "sub")],
                                 "task_id string, difficulty string, node_type string")
    sets = m.summary_sets(df, meta)
    single = {"by_model": m.summarize_by_model(df), "by_difficulty": m.summarize_by_difficulty(df, meta),
              "by_node_type": m.summarize_by_node_type(df, meta), "model_difficulty": m.pass_rate_model_difficulty(df, meta)}
    for name, want in single.items():
        got = m.summary_frame(sets, name)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    kept = sets.persist()
    try:
        for name in single:  # the frames read the one grouping, none shuffles again
            plan = m.summary_frame(kept, name)._jdf.queryExecution().executedPlan().toString()
            assert "InMemoryTableScan" in plan and "Exchange" not in plan.split("InMemoryRelation")[0]
    finally:
        kept.unpersist()


def test_latency_summary_one_row_per_experiment(spark):
    df = runs(spark, [("e", "t", "a", 1, float(x), 1, 2) for x in range(1, 101)])
    r = m.latency_token_summary(df).first()
    assert r["p95_latency_ms"] == pytest.approx(np.quantile(np.arange(1, 101), 0.95))
    assert r["mean_latency_ms"] == 50.5 and r["tokens_in"] == 100 and r["tokens_out"] == 200


def test_histogram_matches_numpy_and_constant_range(spark):
    vals = [0.0, 1.0, 2.5, 2.5, 7.0, 9.999, 10.0, None]
    df = runs(spark, [("e", "t", "a", 0, x, 0, 0) for x in vals])
    out = m.latency_histogram(df, bins=20).orderBy("bin").collect()
    counts, edges = np.histogram([x for x in vals if x is not None], bins=20)
    assert [r["count"] for r in out] == counts.tolist()
    assert [r["bin_lo"] for r in out] == pytest.approx(edges[:-1].tolist())
    const = runs(spark, [("e", "t", "a", 0, 5.0, 0, 0)] * 3)
    out = m.latency_histogram(const, bins=20).orderBy("bin").collect()
    counts, edges = np.histogram([5.0] * 3, bins=20)
    assert [r["count"] for r in out] == counts.tolist()
    assert out[0]["bin_lo"] == pytest.approx(4.5) and out[-1]["bin_hi"] == pytest.approx(5.5)


def test_experiment_status_zero_rows(spark):
    df = runs(spark, [("other", "t", "a", 1, 1.0, 0, 0)])
    r = m.experiment_status(df, experiment_id="e").first()
    assert (r["total"], r["passed"], r["pct_passed"]) == (0, 0, 0.0)


def test_metrics_by_concept_counts_task_once_per_concept(spark):
    df = runs(spark, [("e", "t1", "a", 1, 1.0, 0, 0), ("e", "t1", "a", 0, 1.0, 0, 0), ("e", "t2", "a", 1, 1.0, 0, 0)])
    meta = spark.createDataFrame([("t1", ["x", "y", "x"]), ("t2", [])], "task_id string, ros_concepts array<string>")
    out = {r["ros_concept"]: (r["n"], r["n_tasks"]) for r in m.metrics_by(df, meta, ["ros_concept"], ks=[1]).collect()}
    assert out == {"x": (2, 1), "y": (2, 1), None: (1, 1)}


def test_candidate_quality_and_select_best_first_wins_ties(spark):
    methods = spark.createDataFrame([("r1", 1, None), ("r1", 0, 0.5), ("r2", 1, 0.5), ("r3", 0, None)],
                                    "run_id string, passed int, score double")
    q = {r["run_id"]: (r["n_passed"], r["mean_score"]) for r in m.candidate_quality(methods).collect()}
    assert q == {"r1": (1, 0.5), "r2": (1, 0.5), "r3": (0, 0.0)}
    cands = spark.createDataFrame(
        [("t", 2, True, 1, 0.5), ("t", 1, True, 1, 0.5), ("t", 0, False, 5, 9.0), ("u", 0, False, 0, 0.0)],
        "task_id string, candidate_idx int, overall_pass boolean, n_passed long, mean_score double")
    best = {r["task_id"]: r["candidate_idx"] for r in v.select_best(cands).collect()}
    assert best == {"t": 1, "u": 0}


def test_overall_pass_required_present(spark):
    methods = spark.createDataFrame([("a", "ruff", 1), ("a", "pytest", 1), ("b", "ruff", 1), ("b", "pytest", 0),
                                     ("c", "z3", 0), ("d", "pylint_ros", 0), ("d", "ruff", 1)],
                                    "run_id string, method string, passed int")
    cands = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "run_id string")
    out = {r["run_id"]: r["overall_pass"] for r in v.overall_pass(methods, candidates=cands).collect()}
    assert out == {"a": True, "b": False, "c": False, "d": True, "e": False}


def test_with_meta_duplicates_multiply(spark):
    df = runs(spark, [("e", "t1", "a", 1, 1.0, 0, 0)])
    meta = spark.createDataFrame([("t1", "Easy"), ("t1", "Hard")], "task_id string, difficulty string")
    assert m.with_meta(df, meta).count() == 2
    assert m.with_meta(df, None).count() == 1
    assert F is not None


def test_report_bundle_orders_groups_null_last(spark):
    from passforge.plans.report import report_tables

    df = runs(spark, [("e", "t1", "b", 1, 1.0, 1, 1), ("e", "t2", None, 0, 2.0, 1, 1), ("e", "t3", "a", 1, 3.0, 1, 1)])
    meta = spark.createDataFrame([("t1", "Hard", "x"), ("t3", "Easy", "y")],
                                 "task_id string, difficulty string, node_type string")
    tables = report_tables(df, meta, experiment_id="e")
    assert [r["model"] for r in tables["by_model"].collect()] == ["a", "b", None]
    assert [r["difficulty"] for r in tables["by_difficulty"].collect()] == ["Easy", "Hard", None]
    assert sorted(r["k"] for r in tables["overall_pass_at_k"].collect()) == [1, 5, 10]
    tables["runs"].unpersist()


def test_select_best_with_any_payload(spark):
    df = spark.sql("""select 't' as task_id, 0 as candidate_idx, false as overall_pass, 1L as n_passed, 0.5D as mean_score,
                      parse_json('{"a": 1}') as payload union all select 't', 1, true, 0L, 0.0D, parse_json('2')""")
    assert [(r["candidate_idx"], str(r["payload"])) for r in v.select_best(df).collect()] == [(1, "2")]


def test_pass_at_k_with_billions_of_candidates(spark):
    from passforge.functions.passk import pass_at_k
    n, c = 9_000_000_000, 3_000_000_000
    got = spark.sql(f"select {n}L as n, {c}L as c").select(pass_at_k("n", "c", 10).alias("p")).first()["p"]
    assert got == pytest.approx(1 - (2 / 3) ** 10, rel=1e-6)


def test_no_job_runs_while_a_plan_is_built(spark):
    df = spark.createDataFrame([("e", float(i)) for i in range(50)], "experiment_id string, latency_ms double")
    group = "plan-only"
    spark.sparkContext.setJobGroup(group, "")
    try:
        exact_percentile(df, "latency_ms", 0.95, ["experiment_id"])
        m.latency_histogram(df)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

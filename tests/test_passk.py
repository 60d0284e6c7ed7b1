"""pass@k goldens and properties."""

from math import comb

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passforge.functions.passk import pass_at_k
from passforge.operators import metrics as m


def reference_value(n, c, k):
    if n <= 0 or c <= 0:
        return 0.0
    if c >= n or k >= n:
        return 1.0
    return 1.0 - comb(n - c, k) / comb(n, k)


@pytest.mark.parametrize("n,c,k,want", [(5, 0, 1, 0.0), (5, 5, 1, 1.0), (5, 1, 1, 0.2), (10, 1, 5, 0.5),
                                        (0, 0, 1, 0.0), (3, 1, 5, 1.0), (10, 3, 8, 1.0)])
def test_goldens(spark, n, c, k, want):
    got = spark.range(1).select(pass_at_k(F.lit(n), F.lit(c), F.lit(k)).alias("p")).first()["p"]
    assert got == pytest.approx(want, abs=1e-12)


def test_grid_matches_exact_integers(spark):
    rows = [(n, c, k) for n in range(0, 40, 3) for c in range(0, n + 2, 2) for k in (1, 2, 5, 10)]
    df = spark.createDataFrame(rows, "n int, c int, k int").select("n", "c", "k", pass_at_k("n", "c", "k").alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(reference_value(r["n"], r["c"], r["k"]), abs=1e-12)


@settings(max_examples=20, deadline=None)
@given(n=st.integers(1, 50), k=st.integers(1, 10), data=st.data())
def test_bounds_and_monotone_in_c(spark, n, k, data):
    cs = sorted(data.draw(st.lists(st.integers(0, n), min_size=2, max_size=4)))
    df = spark.createDataFrame([(n, c, k) for c in cs], "n int, c int, k int")
    vals = [r["p"] for r in df.select(pass_at_k("n", "c", "k").alias("p")).orderBy("c").collect()]
    assert all(0.0 <= v <= 1.0 for v in vals)
    assert all(a <= b + 1e-12 for a, b in zip(vals, vals[1:]))


def _runs(spark, rows):
    return spark.createDataFrame(rows, "experiment_id string, model string, task_id string, overall_pass int")


def test_experiment_pass_at_k_two_tasks(spark):
    rows = [("e", "m", "t1", int(i == 0)) for i in range(5)] + [("e", "m", "t2", 1) for _ in range(5)]
    out = {r["k"]: r["pass_at_k"] for r in m.experiment_pass_at_k(_runs(spark, rows), ks=[1, 5]).collect()}
    assert out[1] == pytest.approx(0.6)
    assert out[5] == pytest.approx(1.0)


def test_experiment_pass_at_k_empty_gives_zero(spark):
    out = m.experiment_pass_at_k(_runs(spark, [("other", "m", "t", 1)]), ks=[1, 5, 10], experiment_id="e").collect()
    assert sorted((r["k"], r["pass_at_k"]) for r in out) == [(1, 0.0), (5, 0.0), (10, 0.0)]


def test_pass_at_k_by_model_columns(spark):
    rows = [("e", "a", "t1", 1), ("e", "a", "t1", 0), ("e", "b", "t1", 0)]
    out = m.pass_at_k_by_model(_runs(spark, rows), ks=[1, 2]).orderBy("model").collect()
    assert out[0]["pass@1"] == pytest.approx(0.5) and out[0]["pass@2"] == pytest.approx(1.0)
    assert out[1]["pass@1"] == 0.0

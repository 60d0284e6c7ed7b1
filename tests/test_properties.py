"""Properties from the survey's test strategy: resume covers the grid exactly; the
verdict does not depend on row order."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from passforge.operators import verdicts as v
from passforge.operators import work as w


@settings(max_examples=12, deadline=None)
@given(n=st.integers(0, 6), n_tasks=st.integers(1, 4), data=st.data())
def test_pending_plus_finished_is_the_grid(spark, n, n_tasks, data):
    tasks = [f"t{i}" for i in range(n_tasks)]
    grid = {(t, i) for t in tasks for i in range(n)}
    done = data.draw(st.sets(st.sampled_from(sorted(grid)), max_size=len(grid))) if grid else set()
    tdf = spark.createDataFrame([(t,) for t in tasks], "task_id string")
    ddf = spark.createDataFrame(sorted(done) or [("none", -1)], "task_id string, candidate_idx int")
    pend = {(r["task_id"], r["candidate_idx"]) for r in w.pending_work(tdf, n, ddf).collect()}
    assert pend | done == grid and not (pend & done)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from(["ruff", "pytest", "z3", "pylint_ros"]),
                          st.integers(0, 1)), min_size=1, max_size=12), st.randoms())
def test_verdict_is_order_independent(spark, rows, rnd):
    shuffled = list(rows)
    rnd.shuffle(shuffled)
    schema = "run_id string, method string, passed int"
    a = {r["run_id"]: r["overall_pass"] for r in v.overall_pass(spark.createDataFrame(rows, schema)).collect()}
    b = {r["run_id"]: r["overall_pass"] for r in v.overall_pass(spark.createDataFrame(shuffled, schema)).collect()}
    assert a == b
    for run in a:
        req = [p for r, m, p in rows if r == run and m in ("ruff", "pytest")]
        assert a[run] == (bool(req) and all(req))
    assert random is not None

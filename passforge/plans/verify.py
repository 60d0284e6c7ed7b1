"""L1-L3: the verification plan, a registry of named checks that each turn a candidate
table into ``method_results`` rows, and the overall verdict over the required ones.

A check is a function ``(candidates, key) -> DataFrame[key..., method, passed, status,
n_findings, findings]`` (findings: JSON objects as text; execution columns may follow); ``verify`` resolves the enabled names against the registry
(C6, config order kept, unknown names reported), unions their rows and folds them with
D12. Checks that need a sandbox (running tests) are not built: their landed execution
logs enter through the verdict codes of ``functions.status`` instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import code_checks as cc
from ..operators import spec_checks as sc
from ..operators.verdicts import overall_pass
from ..session import cut_lineage
from ..schemas import DEFAULT_REQUIRED_METHODS

Check = Callable[[DataFrame, Sequence[str]], DataFrame]


LINT_RULES = ["W9001", "W9002", "W9003", "W9010", "W9020", "E0001"]
SYNTAX_RULES = ["E0001"]


def _lint_methods(corpus: DataFrame, key, methods: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Method rows for several lint-based methods from ONE pass of the lint UDTF: per
    candidate the findings are collected once (bounded by the findings of one program),
    then each method keeps the rules it owns."""
    key = list(key)
    rules = sorted({r for _, own in methods for r in own})
    found = cc.lint(corpus.select(*key, "code"), rules=rules)
    per = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line", "rule", "message"))).alias("_f"))
    j = corpus.select(*key, F.col("code").isNull().alias("_null")).join(per, key, "left")
    spec = F.array(*[F.struct(F.lit(name).alias("method"), F.array(*[F.lit(r) for r in [*own, "CRASH"]]).alias("rules"))
                     for name, own in methods])
    j = j.select(*key, "_null", F.coalesce("_f", F.array()).alias("_f"), F.explode(spec).alias("_m"))
    mine = F.filter("_f", lambda f: F.array_contains(F.col("_m.rules"), f["rule"]))
    crashed = F.col("_null") | F.exists("_f", lambda f: f["rule"] == F.lit("CRASH"))
    text = F.transform(mine, lambda f: F.to_json(F.struct(f["rule"].alias("rule"), f["line"].alias("line"),
                                                          f["message"].alias("message"))))
    j = j.select(*key, F.col("_m.method").alias("method"), crashed.alias("_crashed"), text.alias("findings"))
    n = F.size("findings")
    # a check that crashed did not pass, whatever it may have found
    return j.select(
        *key, "method", ((n == 0) & ~F.col("_crashed")).cast("int").alias("passed"),
        F.when(F.col("_crashed"), "CRASH").when(n == 0, "OK").otherwise("FAIL").alias("status"),
        n.cast("long").alias("n_findings"), "findings")


def syntax_check(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Style gate stand-in: the part that decides pass/fail without external tools."""
    return _lint_methods(candidates, key, [("ruff", SYNTAX_RULES)])


def lint_check(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Custom lint rules J1-J3 (and a syntax error, which fails the linter too)."""
    return _lint_methods(candidates, key, [("pylint_ros", LINT_RULES)])


def _spec_methods(candidates: DataFrame, key: Sequence[str], methods: Sequence[str]) -> DataFrame:
    key = list(key)
    topics = sc.spec_topics(candidates.select("task_id", "interface_spec").dropDuplicates(["task_id"]))
    folded = sc.fold_spec_methods(candidates.select("task_id"), topics).where(F.col("method").isin(list(methods)))
    found = sc.spec_findings(topics).where(F.col("method").isin(list(methods)))
    folded = folded.join(found, ["task_id", "method"], "left")
    return candidates.select(*key, "task_id").join(folded, "task_id", "left").select(
        *key, "method", "passed", "status", F.col("n_failing").alias("n_findings"),
        F.coalesce("findings", F.array().cast("array<string>")).alias("findings"))


def _spec_check(method: str) -> Check:
    def run(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
        return _spec_methods(candidates, key, [method])
    return run


def landed_test_check(logs: DataFrame, key: Sequence[str] = ("run_id",), xml: str = "junit_xml") -> Check:
    """A 'pytest' check from landed execution logs: ``logs`` holds key..., exit_code,
    timed_out, launch_error and the test-report XML of each candidate's sandboxed run.
    Status and pass come from H9/H10, findings from J5 (failing test names in order).
    Register it as ``{"pytest": landed_test_check(logs)}`` merged into the registry."""
    from ..functions import status as st
    from ..sources.responses import junit_findings

    lkey = list(key)

    def run(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
        key = list(key)
        sandbox = st.sandbox_status("exit_code", "timed_out", "launch_error")
        more = [F.col(c) for c in ("exit_code", "duration_ms", "stdout", "stderr") if c in logs.columns]
        verdict = logs.select(*lkey, st.test_status("exit_code", sandbox).alias("status"),
                              st.test_passed("exit_code", sandbox).cast("int").alias("passed"), *more)
        item = F.struct("test", "message", "text", "error")
        found = junit_findings(logs.select(*lkey, xml), xml=xml, keys=tuple(lkey)).groupBy(*lkey).agg(
            F.array_sort(F.collect_list(F.struct("finding_pos", F.to_json(item).alias("t")))).alias("_f"))
        j = candidates.select(*key).join(verdict, lkey, "left").join(found, lkey, "left")
        findings = F.coalesce(F.transform("_f", lambda f: f["t"]), F.array().cast("array<string>"))
        return j.select(*key, F.lit("pytest").alias("method"),
                        F.coalesce("passed", F.lit(0)).alias("passed"),
                        F.coalesce("status", F.lit("SKIPPED")).alias("status"),
                        F.size(findings).cast("long").alias("n_findings"), findings.alias("findings"), *more)
    return run


def missing_check(method: str) -> Check:
    """Rows for a check without evidence: SKIPPED and not passed."""
    def run(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
        return candidates.select(*key, F.lit(method).alias("method"), F.lit(0).alias("passed"), F.lit("SKIPPED").alias("status"),
                                 F.lit(0).cast("long").alias("n_findings"), F.array().cast("array<string>").alias("findings"))
    return run


DEFAULT_REGISTRY: dict[str, Check] = {
    "ruff": syntax_check,
    "pylint_ros": lint_check,
    "hypothesis": _spec_check("hypothesis"),
    "z3": _spec_check("z3"),
}
_LINT_FAMILY = {"ruff": SYNTAX_RULES, "pylint_ros": LINT_RULES}
_SPEC_FAMILY = {"hypothesis", "z3"}


def verify(candidates: DataFrame, key: Sequence[str], methods: Sequence[str],
           registry: Mapping[str, Check] | None = None,
           required: Sequence[str] = tuple(DEFAULT_REQUIRED_METHODS),
           materialize: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Run the enabled checks. Returns (method rows with ``method_pos``, per-candidate
    verdicts, unknown method names). With ``materialize`` the method rows are checkpointed once,
    and verdicts and whatever else reads them run no check again.

    With the default registry, the lint-based methods share one lint pass and the spec
    methods one fold. The candidate table is read by each branch; persist it (or build it
    from checkpointed data, as the task loader does) when it is expensive to compute.
    """
    custom = any(check is not DEFAULT_REGISTRY[k] for k, check in (registry or {}).items() if k in DEFAULT_REGISTRY)
    registry = dict(DEFAULT_REGISTRY, **(registry or {}))
    known = [mth for mth in methods if mth in registry]
    unknown = [mth for mth in methods if mth not in registry]
    key = list(key)
    if not known:
        empty = candidates.select(*key).where(F.lit(False))
        return empty, candidates.select(*key, F.lit(False).alias("overall_pass")), unknown
    cands = candidates
    pos = {name: i for i, name in enumerate(known)}
    parts = []
    rest = list(known)
    if not custom:
        lint_family = [(mth, _LINT_FAMILY[mth]) for mth in known if mth in _LINT_FAMILY]
        if lint_family:
            parts.append(_lint_methods(cands, key, lint_family))
        spec_family = [mth for mth in known if mth in _SPEC_FAMILY]
        if spec_family:
            parts.append(_spec_methods(cands, key, spec_family))
        rest = [mth for mth in known if mth not in _LINT_FAMILY and mth not in _SPEC_FAMILY]
    parts += [registry[name](cands, key) for name in rest]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    pos_map = F.create_map(*[x for name, i in pos.items() for x in (F.lit(name), F.lit(i))])
    rows = rows.withColumn("method_pos", pos_map[F.col("method")])
    if materialize:
        rows = cut_lineage(rows)
    verdicts = overall_pass(rows, key, required, candidates=cands.select(*key))
    return rows, verdicts, unknown

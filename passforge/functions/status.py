"""Verdict codes from tool outputs: H9-H12 and H16, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def sandbox_status(exit_code, timed_out, launch_error=None) -> Column:
    """H9: launch error CRASH; timed out TIMEOUT; 137 OOM; 0 OK; anything else FAIL."""
    rc, to = as_col(exit_code), F.coalesce(as_col(timed_out).cast("boolean"), F.lit(False))
    le = F.lit(None) if launch_error is None else as_col(launch_error)
    return (F.when(le.isNotNull(), "CRASH").when(to, "TIMEOUT").when(rc == 137, "OOM")
            .when(rc == 0, "OK").otherwise("FAIL"))


def test_status(exit_code, sandbox) -> Column:
    """TIMEOUT/OOM pass through; 0 OK; 1 and 5 FAIL; 2-4 CRASH; anything else CRASH."""
    rc, st = as_col(exit_code), as_col(sandbox)
    return (F.when(st == "TIMEOUT", "TIMEOUT").when(st == "OOM", "OOM").when(rc == 0, "OK")
            .when(rc.isin(1, 5), "FAIL").when(rc.isin(2, 3, 4), "CRASH").otherwise("CRASH"))


def test_passed(exit_code, sandbox) -> Column:
    return F.coalesce(test_status(exit_code, sandbox) == F.lit("OK"), F.lit(False))


def gate_status(exit_code) -> Column:
    """Style gate 0 OK, 1 FAIL, else CRASH."""
    rc = as_col(exit_code)
    return F.when(rc == 0, "OK").when(rc == 1, "FAIL").otherwise("CRASH")


def lint_status(exit_code) -> Column:
    """Lint exit as a bit mask: NULL CRASH; 0 OK; bit 32 (fatal/usage) CRASH; else FAIL."""
    rc = as_col(exit_code)
    return (F.when(rc.isNull(), "CRASH").when(rc == 0, "OK")
            .when(rc.bitwiseAND(F.lit(32)) != 0, "CRASH").otherwise("FAIL"))


# Error kinds a provider call may retry.
RETRYABLE_KINDS = ["rate_limit", "timeout", "connection"]


def classify_response(http_status, error_kind) -> Column:
    """429, 5xx, timeouts and connection errors are retryable; other errors final."""
    s, k = as_col(http_status), as_col(error_kind)
    retry = (s == 429) | ((s >= 500) & (s < 600)) | k.isin(*RETRYABLE_KINDS)
    ok = k.isNull() & (s.isNull() | ((s >= 200) & (s < 300)))
    return F.when(retry, "retryable").when(ok, "ok").otherwise("final")

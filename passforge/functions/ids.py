"""H4 run ids and H5 config fingerprints, as native hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col
from .canonical import canonical_json


def run_id(experiment_id, task_id, candidate_idx) -> Column:
    """experiment + '-' + first 16 hex digits of SHA-1(experiment NUL task NUL idx)."""
    e = as_col(experiment_id)
    key = F.concat_ws("\u0000", e, as_col(task_id).cast("string"),
                      as_col(candidate_idx).cast("string"))
    return F.concat(e, F.lit("-"), F.substring(F.sha1(key.cast("binary")), 1, 16))


def config_hash(config_json) -> Column:
    """First 12 hex digits of SHA-256 of the key-sorted JSON text (text that is no JSON: as it is)."""
    text = as_col(config_json)
    return F.substring(F.sha2(F.coalesce(canonical_json(text), text).cast("binary"), 256), 1, 12)

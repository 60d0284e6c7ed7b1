"""Landing raw provider responses and tool outputs: H6, H14, H15, J5.

JSON bodies are parsed natively (``try_parse_json`` / ``try_variant_get``); test reports,
whose cases may be nested at any depth, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import as_col
from ..functions.text import FAILURE_TEXT_CHARS, join_text_blocks
from .tasks import strict_json

# The three response shapes and the provider names that produce them.
#   choices:  choices[0].message.content, usage.prompt_tokens / usage.completion_tokens
#   blocks:   content[] of {type, text} (text blocks joined), usage.input_tokens / output_tokens
#   response: response, prompt_eval_count / eval_count
PROVIDER_SHAPES = {"openai": "choices", "anthropic": "blocks", "ollama": "response"}

_SHAPE_PATHS = {
    "choices": ("$.usage.prompt_tokens", "$.usage.completion_tokens"),
    "blocks": ("$.usage.input_tokens", "$.usage.output_tokens"),
    "response": ("$.prompt_eval_count", "$.eval_count"),
}


def normalize_responses(raw: DataFrame, provider: str = "provider", body: str = "body",
                        shapes: dict[str, str] | None = None) -> DataFrame:
    """One generation row per raw response: text ('' when missing) and token counts
    (0 when missing), whatever the provider's body shape."""
    shapes = shapes or PROVIDER_SHAPES
    shape_map = F.create_map(*[x for k, s in shapes.items() for x in (F.lit(k), F.lit(s))])
    shape = shape_map[F.col(provider)]
    v = F.try_parse_json(F.col(body))
    blocks = F.try_variant_get(v, "$.content", "array<struct<type:string,text:string>>")
    text = (F.when(shape == "choices", F.try_variant_get(v, "$.choices[0].message.content", "string"))
            .when(shape == "blocks", F.when(blocks.isNotNull(), join_text_blocks(blocks)))
            .when(shape == "response", F.try_variant_get(v, "$.response", "string")))

    def count(i):
        e = None
        for s, paths in _SHAPE_PATHS.items():
            got = F.try_variant_get(v, paths[i], "int")
            e = F.when(shape == s, got) if e is None else e.when(shape == s, got)
        return F.coalesce(e, F.lit(0))

    return raw.withColumn("text", F.coalesce(text, F.lit(""))) \
        .withColumn("prompt_tokens", count(0)).withColumn("completion_tokens", count(1))


def parse_findings(stdout) -> Column:
    """H6: a tool's JSON list of findings; blank or undecodable output gives []."""
    s = as_col(stdout)
    parsed = F.when(strict_json(s), F.try_variant_get(F.try_parse_json(s), "$", "array<variant>"))
    return F.coalesce(parsed, F.array().cast("array<variant>"))


# ---------------------------------------------------------------------------
# J5 test-report XML
# ---------------------------------------------------------------------------

def report_cases(xml: str) -> list[tuple]:
    """Failed or errored cases of one report as (test, message, text, error), in document order
    and at any depth, whatever the root; one 'junit parse error' row if it is not XML."""
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError):
        return [(None, None, None, "junit parse error")]
    found = []
    for case in root.iter("testcase"):
        issue = next((x for kind in ("failure", "error") if (x := case.find(kind)) is not None), None)
        if issue is not None:
            found.append((f"{case.get('classname', '')}.{case.get('name', '?')}", issue.get("message", ""),
                          (issue.text or "")[:FAILURE_TEXT_CHARS], None))
    return found


def junit_findings(reports: DataFrame, xml: str = "xml", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One finding per failed or errored test case, in document order; a report that
    does not parse gives one 'junit parse error' finding; a missing report gives none.

    Output: keys..., finding_pos, test, message, text, error. One parse per report, over
    Arrow batches: Spark's XML reader needs a fixed nesting, and a case may sit anywhere.
    """
    rows = reports.where(F.col(xml).isNotNull()).select(*keys, F.col(xml).alias("_xml"))
    issue = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("test", "message", "text", "error")]))

    @F.pandas_udf(issue)
    def cases(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("test", "message", "text", "error")
        for reports_ in batches:
            yield pd.Series([[dict(zip(names, c, strict=True)) for c in report_cases(x)] for x in reports_], dtype=object)
    out = rows.select(*keys, F.posexplode(cases("_xml")).alias("finding_pos", "f"))
    return out.select(*keys, "finding_pos", "f.test", "f.message", "f.text", "f.error")

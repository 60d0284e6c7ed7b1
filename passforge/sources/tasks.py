"""Benchmark task landing: A1-A4, I5, B1-B4.

``read_lines`` gives every physical line with its 1-based line number per file,
blank lines counted, using the text source's split metadata: rows of one split come
in file order, so a line's number is (lines in earlier splits of the file) + its
position in its split. The per-split counts are a small aggregate; no single task
ever sees a whole file.

JSON is parsed with ``try_parse_json`` behind a strict test (``strict_json``):
Spark's JSON readers accept a valid value followed by junk, so a line must parse both
as the single element of ``[line]`` and as the single value of ``{"v": line}``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BAD_LINE_CHARS, py_strip
from ..session import cut_lineage
from ..schemas import CONTRACTS, DIFFICULTIES

# ---------------------------------------------------------------------------
# A1 lines and strict JSON
# ---------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line_no, line) for every line of the files under ``path``."""
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = raw.groupBy("file_path", "_blk").agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    splits = splits.withColumn(
        "_before", F.sum("_cnt").over(Window.partitionBy("file_path").orderBy("_blk")) - F.col("_cnt"))
    return raw.join(splits, ["file_path", "_blk"]).select(
        "file_path", (F.col("_before") + F.col("_mid") - F.col("_first") + 1).alias("line_no"), "line")


def _as_element(s: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))


def strict_json(s) -> Column:
    """True when ``s`` is exactly one JSON value (no trailing junk, no single quotes,
    no duplicate keys).

    ``[s]`` must parse to an array whose only element is ``s`` (an element 0 and no
    element 1), and ``{"v": s}`` must parse too: the parser stops after the first
    complete value, so junk after ``]`` in ``[s]`` would go unnoticed without it.
    """
    s = F.col(s) if isinstance(s, str) else s
    elem = _as_element(s)
    as_value = F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}")))
    ok = (F.try_variant_get(elem, "$[0]", "variant").isNotNull()
          & F.try_variant_get(elem, "$[1]", "variant").isNull()
          & F.try_variant_get(as_value, "$.v", "variant").isNotNull())
    return F.coalesce(ok, F.lit(False))


def parse_json_strict(s) -> Column:
    """The parsed VARIANT of ``s`` when it is strict JSON, else NULL (one parse reused)."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(strict_json(s), F.try_variant_get(_as_element(s), "$[0]", "variant"))


# ---------------------------------------------------------------------------
# A2 validation helpers over VARIANT
# ---------------------------------------------------------------------------

def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _t(x: Column) -> Column:
    return F.schema_of_variant(x)


def _is_str(x):
    return _t(x) == "STRING"


def _is_num(x):
    t = _t(x)
    return t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")


def _is_obj(x):
    return _t(x).startswith("OBJECT")


def _is_arr(x):
    return _t(x).startswith("ARRAY")


def _arr(x: Column) -> Column:
    return F.try_variant_get(x, "$", "array<variant>")


def _all(arr: Column, pred) -> Column:
    return F.coalesce(F.forall(arr, pred), F.lit(True))


# Oracle check kinds, their required and optional fields, defaults.
CHECK_REQUIRED = {
    "node_exists": ["node_name"],
    "topic_published": ["topic"],
    "topic_subscribed": ["topic"],
    "message_content": ["topic", "field", "expected"],
    "log_output_contains": ["pattern"],
    "service_called": ["service"],
    "parameter_value": ["node", "parameter", "expected"],
    "parameter_declared": ["node_name", "param_name"],
}
CHECK_TIMEOUT_KINDS = ["node_exists", "topic_published", "topic_subscribed", "log_output_contains",
                       "service_called"]
DEFAULT_TIMEOUT_SEC = 5.0
DEFAULT_MIN_COUNT = 1
ANY_FIELDS = {"expected"}


CHECK_FIELDS = ["type", "node_name", "topic", "msg_type", "min_count", "timeout_sec", "field", "expected",
                "pattern", "service", "srv_type", "node", "parameter", "param_name", "param_type"]
_NUM_TYPES = ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"]


def _lax_float(x: Column) -> Column:
    """A number, or a string that reads as one (lax numeric validation)."""
    t = _t(x)
    as_num = F.try_variant_get(x, "$", "double")
    return t.isin(*_NUM_TYPES) | t.startswith("DECIMAL") | ((t == "STRING") & as_num.isNotNull())


def _lax_int(x: Column) -> Column:
    """An integer, or a float / numeric string with no fractional part."""
    as_num = F.try_variant_get(x, "$", "double")
    return _lax_float(x) & (as_num == F.floor(as_num))


def check_types(c: Column) -> Column:
    """Stage 1 of A3: the JSON type name of every check field (NULL when absent), plus
    whether the numeric options hold numbers in the lax sense."""
    t_sec, m_cnt = _get(c, "$.timeout_sec"), _get(c, "$.min_count")
    return F.struct(F.coalesce(_is_obj(c), F.lit(False)).alias("is_obj"),
                    F.try_variant_get(c, "$.type", "string").alias("type_str"),
                    *[_t(_get(c, f"$.{f}")).alias(f) for f in CHECK_FIELDS],
                    F.coalesce(_lax_float(t_sec), F.lit(False)).alias("timeout_ok"),
                    F.coalesce(_lax_int(m_cnt), F.lit(False)).alias("min_count_ok"))


def _kind_fits(ct: Column, kind: str) -> Column:
    conds = []
    for f in CHECK_REQUIRED[kind]:
        conds.append(ct[f].isNotNull() if f in ANY_FIELDS else (ct[f] == F.lit("STRING")))
    if kind in CHECK_TIMEOUT_KINDS:
        conds.append(ct["timeout_sec"].isNull() | ct["timeout_ok"])
    if kind == "topic_published":
        conds.append(ct["min_count"].isNull() | ct["min_count_ok"])
    opt = {"topic_published": "msg_type", "topic_subscribed": "msg_type", "service_called": "srv_type",
           "parameter_declared": "param_type"}.get(kind)
    if opt:
        conds.append(ct[opt].isNull() | ct[opt].isin("STRING", "VOID"))
    out = conds[0]
    for x in conds[1:]:
        out = out & x
    return F.coalesce(out, F.lit(False))


def kind_from_types(ct: Column) -> Column:
    """Stage 2 of A3: resolve a check to its kind, 'unknown', or NULL (invalid).

    A record whose ``type`` is a known kind with its required fields is that kind; any
    other string ``type`` (including a known kind missing a field) is 'unknown'. A record
    without ``type`` whose fields fit some kind is 'unknown'; otherwise it is invalid.
    """
    t_str = F.when(ct["type"] == F.lit("STRING"), ct["type_str"])
    expr = None
    any_fit = None
    for kind in CHECK_REQUIRED:
        fits = _kind_fits(ct, kind)
        cond = (t_str == F.lit(kind)) & fits
        expr = F.when(cond, F.lit(kind)) if expr is None else expr.when(cond, F.lit(kind))
        any_fit = fits if any_fit is None else (any_fit | fits)
    return F.when(ct["is_obj"], expr.when(t_str.isNotNull(), F.lit("unknown"))
                  .when(ct["type"].isNull() & any_fit, F.lit("unknown")))


class _ColGetter:
    """Field access by name on prefixed top-level columns (same interface as a struct)."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __getitem__(self, name: str) -> Column:
        return F.col(self.prefix + name)


_LIST_FIELDS = ("services_provided", "services_used", "actions_provided", "actions_used", "parameters")


def _list_types(x: Column, elem, name: str) -> list[Column]:
    """(type of the value, whether every element satisfies ``elem``) as two columns."""
    return [_t(x).alias(f"{name}__t"), _all(_arr(x), elem).alias(f"{name}__ok")]


def _topic_ok(t: Column) -> Column:
    return _is_obj(t) & _is_str(_get(t, "$.name")) & _is_str(_get(t, "$.type"))


_SCALAR_FIELDS = ("task_id", "node_type", "difficulty", "prompt", "canonical_solution", "entry_point",
                  "interface_spec", "test_oracle")


def task_types(v: Column, prefix: str = "_ty_") -> list[Column]:
    """Stage 1 of A2: JSON type names of every field the task model declares, one column
    each (separate columns stay materialized; a struct would be re-inlined per use)."""
    p = prefix
    cols = [_t(_get(v, f"$.{f}")).alias(p + f) for f in _SCALAR_FIELDS]
    cols.append(F.try_variant_get(v, "$.difficulty", "string").alias(p + "difficulty_str"))
    cols.append(_t(_get(v, "$.interface_spec.node_name")).alias(p + "node_name"))
    cols += _list_types(_get(v, "$.ros_concepts"), _is_str, p + "ros_concepts")
    cols += _list_types(_get(v, "$.dependencies"), _is_str, p + "dependencies")
    cols += _list_types(_get(v, "$.interface_spec.topics_published"), _topic_ok, p + "topics_published")
    cols += _list_types(_get(v, "$.interface_spec.topics_subscribed"), _topic_ok, p + "topics_subscribed")
    for f in _LIST_FIELDS:
        cols += _list_types(_get(v, f"$.interface_spec.{f}"), _is_obj, p + f)
    checks = _get(v, "$.test_oracle.checks")
    # Two passes over the array: types once per element, then the kind test on them.
    typed = F.transform(_arr(checks), check_types)
    cols += [_t(checks).alias(p + "checks__t"),
             F.coalesce(F.forall(typed, lambda ct: kind_from_types(ct).isNotNull()), F.lit(True))
             .alias(p + "checks__ok")]
    return cols


def _req_str(g, f: str) -> Column:
    return F.when(g(f).isNull(), F.lit(f"{f}: field required")) \
        .when(g(f) != F.lit("STRING"), F.lit(f"{f}: must be a string"))


def _list_err(g, f: str, msg: str) -> Column:
    t, ok = g(f + "__t"), g(f + "__ok")
    bad = t.isNotNull() & ~(F.coalesce(t.startswith("ARRAY") & ok, F.lit(False)))
    return F.when(bad, F.lit(msg))


def errors_from_types(prefix: str = "_ty_", getter=None) -> Column:
    """Stage 2 of A2: validation messages (empty array when the task is valid)."""
    def g(name):
        return getter(name) if getter is not None else F.col(prefix + name)
    iface_obj = F.coalesce(g("interface_spec").startswith("OBJECT"), F.lit(False))
    msgs = [
        _req_str(g, "task_id"),
        _req_str(g, "node_type"),
        F.when(g("difficulty").isNull(), F.lit("difficulty: field required"))
        .when(~F.coalesce((g("difficulty") == "STRING") & g("difficulty_str").isin(*DIFFICULTIES), F.lit(False)),
              F.lit("difficulty: must be one of " + ", ".join(DIFFICULTIES))),
        _list_err(g, "ros_concepts", "ros_concepts: must be a list of strings"),
        _req_str(g, "prompt"),
        F.when(g("canonical_solution").isNotNull() & (g("canonical_solution") != "STRING"),
               F.lit("canonical_solution: must be a string")),
        _req_str(g, "entry_point"),
        F.when(g("interface_spec").isNull(), F.lit("interface_spec: field required"))
        .when(~iface_obj, F.lit("interface_spec: must be an object")),
        F.when(iface_obj, _req_str(g, "node_name")),
        _list_err(g, "topics_published", "interface_spec.topics_published: must be a list of {name, type}"),
        _list_err(g, "topics_subscribed", "interface_spec.topics_subscribed: must be a list of {name, type}"),
        *[_list_err(g, f, f"interface_spec.{f}: must be a list of objects") for f in _LIST_FIELDS],
        F.when(g("test_oracle").isNull(), F.lit("test_oracle: field required"))
        .when(~F.coalesce(g("test_oracle").startswith("OBJECT"), F.lit(False)), F.lit("test_oracle: must be an object")),
        _list_err(g, "checks", "test_oracle.checks: every check must be an object of a known kind "
                               "or carry a string type"),
        _list_err(g, "dependencies", "dependencies: must be a list of strings"),
    ]
    return F.filter(F.array(*msgs), lambda m: m.isNotNull())


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows round-robin before CPU-bound per-row work: a task file of a few hundred MB
    is read as one or two splits. ``partitions``: the session's shuffle partitions by
    default, the setting that follows the data size. Starts no job."""
    return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def classify_task_lines(lines: DataFrame, strict: bool = False, line_col: str = "line",
                        materialize: bool = True) -> DataFrame:
    """A1 + A2 over (file_path?, line_no, line): every non-blank line with ``status``
    (ok, malformed, not_object, invalid), its parsed ``raw`` VARIANT and ``error`` text.

    Lines are stripped and blank lines skipped. With ``strict`` a bad record raises
    ``ValueError`` that names the first one by file and line, whichever task met one first.
    With ``materialize`` (always so when strict) the classified lines are checkpointed into the
    shared checkpoint folder, so the tasks, the errors and the counts all read them instead of
    parsing every line again. Without it they come out of a generator of one row per line: a filter
    on the result stays above it. Pushed below, it would hold a copy of the whole check
    wherever the check names one of its own columns."""
    keep = [c for c in ("file_path", "line_no") if c in lines.columns]
    lines = spread(lines)
    df = lines.select(*keep, py_strip(F.col(line_col)).alias("_s")).where(F.col("_s") != "")
    df = df.select(*keep, "_s", parse_json_strict("_s").alias("raw"))
    kind = F.when(F.col("raw").isNull(), F.lit("malformed")).when(~_is_obj(F.col("raw")), F.lit("not_object"))
    df = df.select(*keep, "_s", "raw", kind.alias("_kind"), *task_types(F.col("raw")))
    df = df.select(*keep, "_s", "raw", "_kind",
                   F.when(F.col("_kind").isNull(), errors_from_types()).alias("_errs"))
    df = df.select(*keep, "_s", "raw", F.coalesce(
        "_kind", F.when(F.size("_errs") > 0, F.lit("invalid")), F.lit("ok")).alias("_status"), "_errs")
    status = F.col("_status")
    message = (F.when(status == "malformed", F.lit("invalid JSON"))
               .when(status == "not_object", F.lit("task must be a JSON object"))
               .when(status == "invalid", F.array_join("_errs", "; ")))
    out = df.select(*keep, "_s", "raw", status.alias("status"), message.alias("error"))
    if not (materialize or strict):
        return out.select(*keep, F.inline(F.array(F.struct("_s", "raw", "status", "error"))))
    out = cut_lineage(out)
    if strict:
        raise_first(out)
    return out


def first_bad_record(classified: DataFrame) -> DataFrame:
    """The bad record with the least file path and line number (no row if all are good): only
    positions are aggregated, then that record is read."""
    place = [c for c in ("file_path", "line_no") if c in classified.columns]
    bad = classified.where(F.col("status") != "ok")
    least = bad.agg(F.min(F.struct(*place)).alias("_at"))
    return bad.join(least, F.struct(*place) == F.col("_at")).select(
        *place, F.substring("_s", 1, BAD_LINE_CHARS).alias("raw"), "status", "error")


def raise_first(classified: DataFrame) -> None:
    """The gate of a strict load: raise for the first bad record, if there is one."""
    bad = first_bad_record(classified).head()
    if bad is not None:
        where = f"{bad['file_path']}, line {bad['line_no']}" if "file_path" in bad else f"line {bad['line_no']}"
        raise ValueError(f"invalid task at {where}: {bad['error']}")


def parse_task_lines(lines: DataFrame, strict: bool = False, line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """A1 + A2: returns (tasks, errors); errors carry line_no, raw (first 200 chars), error."""
    return split_classified(classify_task_lines(lines, strict, line_col))


def split_classified(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    keep = [c for c in ("file_path", "line_no") if c in df.columns]
    errors = df.where(F.col("status") != "ok").select(
        *keep, F.substring("_s", 1, BAD_LINE_CHARS).alias("raw"), "status", "error")
    tasks = df.where(F.col("status") == "ok").select(*keep, *_task_columns(F.col("raw")), "raw")
    return tasks, errors


def _task_columns(v: Column) -> list[Column]:
    topic = "array<struct<name:string,type:string,qos:struct<depth:int>>>"

    def lst(path, typ):
        return F.coalesce(F.try_variant_get(v, path, typ), F.array().cast(typ))

    iface = F.struct(
        F.try_variant_get(v, "$.interface_spec.node_name", "string").alias("node_name"),
        lst("$.interface_spec.topics_published", topic).alias("topics_published"),
        lst("$.interface_spec.topics_subscribed", topic).alias("topics_subscribed"),
        *[lst(f"$.interface_spec.{f}", "array<variant>").alias(f)
          for f in ("services_provided", "services_used", "actions_provided", "actions_used", "parameters")],
    )
    return [
        F.try_variant_get(v, "$.task_id", "string").alias("task_id"),
        F.try_variant_get(v, "$.node_type", "string").alias("node_type"),
        F.try_variant_get(v, "$.difficulty", "string").alias("difficulty"),
        lst("$.ros_concepts", "array<string>").alias("ros_concepts"),
        F.try_variant_get(v, "$.prompt", "string").alias("prompt"),
        F.coalesce(F.try_variant_get(v, "$.canonical_solution", "string"), F.lit("")).alias("canonical_solution"),
        F.try_variant_get(v, "$.entry_point", "string").alias("entry_point"),
        iface.alias("interface_spec"),
        lst("$.test_oracle.checks", "array<variant>").alias("checks"),
        lst("$.dependencies", "array<string>").alias("dependencies"),
    ]


def load_tasks(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """A1: JSON-lines tasks from a file or folder. A missing path raises in both modes."""
    return parse_task_lines(read_lines(spark, path), strict=strict)


# ---------------------------------------------------------------------------
# A3 checks, I5 static completeness
# ---------------------------------------------------------------------------

def explode_checks(tasks: DataFrame) -> DataFrame:
    """A3: one row per oracle check with its resolved kind and per-kind defaults."""
    df = tasks.select("task_id", F.posexplode("checks").alias("check_pos", "c"))
    ct = check_types(F.col("c"))
    df = df.select("task_id", "check_pos", "c", *[ct[f].alias(f"_ct_{f}")
                                                  for f in ["is_obj", "type_str", *CHECK_FIELDS, "timeout_ok",
                                                            "min_count_ok"]])
    df = df.select("task_id", "check_pos", "c", kind_from_types(_ColGetter("_ct_")).alias("_kind"))
    c = F.col("c")
    kind = F.col("_kind")

    def s(f):
        return F.try_variant_get(c, f"$.{f}", "string")

    return df.select(
        "task_id", "check_pos",
        s("type").alias("type"),
        kind.alias("kind"),
        s("node_name").alias("node_name"), s("topic").alias("topic"), s("msg_type").alias("msg_type"),
        F.when(kind == "topic_published",
               F.coalesce(F.try_variant_get(c, "$.min_count", "double").cast("int"), F.lit(DEFAULT_MIN_COUNT)))
        .alias("min_count"),
        F.when(kind.isin(*CHECK_TIMEOUT_KINDS),
               F.coalesce(F.try_variant_get(c, "$.timeout_sec", "double"), F.lit(DEFAULT_TIMEOUT_SEC)))
        .alias("timeout_sec"),
        s("field").alias("field"), _get(c, "$.expected").alias("expected"), s("pattern").alias("pattern"),
        F.when(kind == "log_output_contains",
               F.coalesce(_get(c, "$.after_publish"), F.parse_json(F.lit("false")))).alias("after_publish"),
        s("service").alias("service"), s("srv_type").alias("srv_type"), s("node").alias("node"),
        s("parameter").alias("parameter"), s("param_name").alias("param_name"), s("param_type").alias("param_type"),
        c.alias("raw"),
    )


def _truthy(x: Column) -> Column:
    """Python truthiness of a JSON value (VARIANT)."""
    t = _t(x)
    as_str = F.try_variant_get(x, "$", "string")
    return F.coalesce(
        F.when(x.isNull() | (t == "VOID"), F.lit(False))
        .when(t == "STRING", as_str != "")
        .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        .when(_is_num(x), F.try_variant_get(x, "$", "double") != 0)
        .when(_is_arr(x), F.json_array_length(F.to_json(x)) > 0)
        .when(_is_obj(x), F.size(F.json_object_keys(F.to_json(x))) > 0)
        .otherwise(F.lit(True)), F.lit(False))


# The required-field rule and message of each known kind in the static check.
ORACLE_RULES = {
    "node_exists": (["node_name"], "node_name required"),
    "topic_published": (["topic"], "topic required"),
    "topic_subscribed": (["topic"], "topic required"),
    "message_content": (["topic", "field"], "topic+field required"),
    "log_output_contains": (["pattern"], "pattern required"),
    "service_called": (["service"], "service required"),
    "parameter_value": (["node", "parameter"], "node+parameter required"),
}


def oracle_completeness(checks: DataFrame) -> DataFrame:
    """Per check PASS, FAIL (with message) or XFAIL for kinds the check does not know.

    Dispatch is on the raw ``type`` string; fields must be present and truthy.
    """
    raw = F.col("raw")
    typ = F.coalesce(F.col("type"), F.lit(""))
    status, message = None, None
    for kind, (fields, msg) in ORACLE_RULES.items():
        ok = None
        for f in fields:
            t = _truthy(_get(raw, f"$.{f}"))
            ok = t if ok is None else (ok & t)
        st = F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL"))
        mg = F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(msg))
        status = F.when(typ == kind, st) if status is None else status.when(typ == kind, st)
        message = F.when(typ == kind, mg) if message is None else message.when(typ == kind, mg)
    status = status.otherwise(F.lit("XFAIL"))
    message = message.otherwise(F.concat(F.lit("oracle check type '"), typ, F.lit("' not implemented")))
    return checks.select("task_id", "check_pos", "type", status.alias("status"), message.alias("message"))


# ---------------------------------------------------------------------------
# A4 closed contracts
# ---------------------------------------------------------------------------

def _fits(v: Column, kind: str) -> Column:
    """Whether a VARIANT value (not absent) can be read as ``kind`` (see CONTRACTS)."""
    kind, null_ok = kind.rstrip("?"), kind.endswith("?")
    t = _t(v)
    text = F.trim(F.try_variant_get(v, "$", "string"))
    number = F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0))
    if kind == "any":
        return F.lit(True)
    if kind == "str":
        ok = t == "STRING"
    elif kind == "int":
        ok = (_is_num(v) & (number == F.floor(number))) | (t == "BOOLEAN") | \
            ((t == "STRING") & text.rlike(r"^[+-]?[0-9]+(\.0*)?$"))
    elif kind == "num":
        ok = _is_num(v) | (t == "BOOLEAN") | \
            ((t == "STRING") & text.rlike(r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"))
    elif kind == "bool":
        ok = (t == "BOOLEAN") | (_is_num(v) & number.isin(0.0, 1.0)) | \
            ((t == "STRING") & F.lower(text).isin("0", "off", "f", "false", "n", "no", "1", "on", "t", "true", "y", "yes"))
    elif kind == "objects":
        ok = _is_arr(v) & F.coalesce(F.forall(_arr(v), _is_obj), F.lit(True))
    else:
        ok = _is_arr(v)
    ok = F.coalesce(ok, F.lit(False))
    return ok | (t == "VOID") if null_ok else ok & (t != "VOID")


def _contract_reasons(j: Column, spec: dict, prefix: Column) -> list[Column]:
    """Reasons (or NULLs) why the JSON object text ``j`` breaks ``spec``; nested objects
    and lists of objects are checked against their own contracts, messages prefixed by
    their path (e.g. ``methods[1].execution.``)."""
    v = F.try_parse_json(j)
    obj = F.coalesce(strict_json(j) & _is_obj(v), F.lit(False))
    keys = F.coalesce(F.json_object_keys(j), F.array().cast("array<string>"))

    def said(when: Column, *text) -> Column:
        return F.when(obj & when, F.concat(prefix, *[F.lit(x) if isinstance(x, str) else x for x in text]))

    def shape(allowed, required, kinds, when: Column) -> list[Column]:
        out = []
        if allowed is not None:
            extra = F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))
            out.append(said(when & (F.size(extra) > 0), "unexpected keys: ", F.array_join(F.array_sort(extra), ",")))
        if required:
            missing = F.array_except(F.array(*[F.lit(k) for k in required]), keys)
            out.append(said(when & (F.size(missing) > 0), "missing keys: ", F.array_join(missing, ",")))
        for field, kind in kinds.items():
            if kind != "any":
                got = F.try_variant_get(v, f"$.{field}", "variant")
                out.append(said(when & F.array_contains(keys, field) & ~_fits(got, kind), f"bad type of {field}"))
        return out

    reasons = [F.when(~obj, F.concat(prefix, F.lit("not a JSON object")))]
    reasons += shape(spec.get("allowed"), spec["required"], spec.get("kinds", {}), F.lit(True))
    if "variants" in spec:
        by, of = spec["variants"]["by"], spec["variants"]["of"]
        chosen = F.get_json_object(j, f"$.{by}")
        reasons.append(said(F.array_contains(keys, by) & (chosen.isNull() | ~chosen.isin(*of)), f"bad {by}: ",
                            F.coalesce(chosen, F.lit("null"))))
        for name, sub in of.items():
            reasons += shape([by, *sub["kinds"]], sub["required"], sub["kinds"], F.coalesce(chosen == name, F.lit(False)))
    for field, values in spec.get("enums", {}).items():
        got = F.get_json_object(j, f"$.{field}")
        text = F.coalesce(_t(F.try_variant_get(v, f"$.{field}", "variant")) == "STRING", F.lit(False))
        reasons.append(said(F.array_contains(keys, field) & ~(text & F.coalesce(got.isin(*values), F.lit(False))),
                            f"bad {field}: ", F.coalesce(got, F.lit("null"))))
    for field, sub in spec.get("objects", {}).items():
        inner = F.coalesce(F.get_json_object(j, f"$.{field}"), F.lit("null"))
        sub_prefix = F.concat(prefix, F.lit(f"{field}."))
        reasons += [F.when(obj & F.array_contains(keys, field), r)
                    for r in _contract_reasons(inner, CONTRACTS[sub], sub_prefix)]
    for field, sub in spec.get("lists", {}).items():
        items = F.from_json(F.get_json_object(j, f"$.{field}"), "array<string>")

        def item_check(field, sub):
            def per_item(e, i):
                p = F.concat(prefix, F.lit(f"{field}["), i.cast("string"), F.lit("]."))
                return F.filter(F.array(*_contract_reasons(F.coalesce(e, F.lit("null")), CONTRACTS[sub], p)),
                                lambda r: r.isNotNull())
            return per_item
        found = F.flatten(F.transform(F.coalesce(items, F.array().cast("array<string>")), item_check(field, sub)))
        reasons.append(F.when(obj & (F.size(found) > 0), F.array_join(found, "; ")))
    return reasons


def enforce_contract(df: DataFrame, contract: str | dict, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """A4: split JSON records into (ok, rejected) by a closed contract: no unexpected
    keys, required keys present, enum fields within their values, at every nesting level
    the contract declares."""
    out = contract_reasons(df, contract, json_col, out="_reasons")
    ok = out.where(F.size("_reasons") == 0).drop("_reasons")
    rejected = out.where(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons")
    return ok, rejected


def contract_reasons(df: DataFrame, contract: str | dict, json_col: str = "json", out: str = "reasons") -> DataFrame:
    """A4 in one pass: every record with the array of reasons it breaks the contract
    (empty when accepted). ``enforce_contract`` splits this into two frames."""
    spec = CONTRACTS[contract] if isinstance(contract, str) else contract
    df = spread(df)
    reasons = _contract_reasons(F.col(json_col), spec, F.lit(""))
    return df.withColumn(out, F.filter(F.array(*reasons), lambda r: r.isNotNull()))


# ---------------------------------------------------------------------------
# B1-B4
# ---------------------------------------------------------------------------

def filter_tasks(df: DataFrame, difficulty: str | None = None, node_type: str | None = None) -> DataFrame:
    """B1: difficulty case-insensitive, node type exact; empty or None means no filter."""
    if difficulty:
        df = df.where(F.lower(F.col("difficulty")) == F.lit(difficulty.lower()))
    if node_type:
        df = df.where(F.col("node_type") == F.lit(node_type))
    return df


def select_tasks(df: DataFrame, ids: str | Sequence[str] | DataFrame | None) -> DataFrame:
    """B2: keep tasks whose id is listed (comma list trimmed, blanks dropped); empty keeps all.

    A DataFrame of ids is applied as a left semi join (the planner broadcasts it when
    measured small); a short literal list as ``isin``.
    """
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias("task_id")).distinct(), "task_id", "left_semi")
    if isinstance(ids, str):
        ids = ids.split(",")
    wanted = sorted({i.strip() for i in ids if i and i.strip()})
    if not wanted:
        return df
    return df.where(F.col("task_id").isin(wanted))


def get_task(df: DataFrame, task_id: str) -> DataFrame:
    """The first task with this id (file order) as pretty JSON; empty when not found."""
    order = [c for c in ("file_path", "line_no") if c in df.columns]
    hit = df.where(F.col("task_id") == F.lit(task_id))
    if order:
        hit = hit.orderBy(*order)
    cols = [c for c in df.columns if c not in ("file_path", "line_no", "raw")]
    return hit.limit(1).select(*order, "task_id", F.to_json(F.struct(*cols)).alias("json"))


def find_task(lines: DataFrame, task_id: str, line_col: str = "line") -> DataFrame:
    """B3 straight from the lines: only those that can hold the id are parsed and checked.

    An id of plain characters stands in its line as it is, in quotes, or behind a ``\\u`` escape; lines
    without either are passed over by a text search. Other ids have every line parsed."""
    if re.fullmatch(r"[A-Za-z0-9_.:-]+", task_id):
        line = F.col(line_col)
        lines = lines.where(line.contains(f'"{task_id}"') | line.contains("\\u"))
    return get_task(split_classified(classify_task_lines(lines, line_col=line_col, materialize=False))[0], task_id)


def require_task(df: DataFrame, task_id: str) -> str:
    """B3 as a lookup: the task's JSON; a missing id is an error (KeyError). Brings one
    row to the driver."""
    row = get_task(df, task_id).first()
    if row is None:
        raise KeyError(f"task not found: {task_id}")
    return row["json"]


def list_tasks(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listing projection (task_id, difficulty, node_type, entry_point) and the
    (shown, skipped) counts, both from the classified A1 frame; the counts are one
    aggregate over it."""
    tasks, _ = split_classified(classified)
    listing = tasks.select(*[c for c in ("file_path", "line_no") if c in tasks.columns],
                           "task_id", "difficulty", "node_type", "entry_point")
    counts = classified.agg(
        F.count_if(F.col("status") == "ok").cast("long").alias("shown"),
        F.count_if(F.col("status") != "ok").cast("long").alias("skipped"))
    return listing, counts

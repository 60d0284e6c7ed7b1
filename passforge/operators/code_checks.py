"""Code-corpus checks: J1-J4 and J6 as one Python UDTF over a ``code`` column, J7 as a
Spark aggregate over its findings.

The per-row part is a small helper over the standard library's ``ast``: Spark
partitions the corpus, ships it to Python workers in Arrow batches (``mapInPandas``),
and does all grouping and counting itself. A row whose check raises yields one CRASH
finding (J6), so a bad row never fails the task. The same check is also offered as a
Python UDTF for SQL (``LATERAL``).
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from ..sources.tasks import spread

FINDING_SCHEMA = "rule string, symbol string, line int, message string"

# Rule codes, symbols and messages of the lint rules.
RULES = {
    "W9001": ("missing-rclpy-init", "Missing rclpy.init() call"),
    "W9002": ("missing-rclpy-shutdown", "Missing rclpy.shutdown() call"),
    "W9003": ("missing-destroy-node", "Missing destroy_node() call"),
    "W9010": ("blocking-in-callback", "Blocking call {} inside rclpy callback"),
    "W9020": ("missing-qos-depth", "create_publisher/subscription missing explicit qos_profile or depth"),
    "E0001": ("syntax-error", "{}"),
    "CRASH": ("method-crashed", "method crashed: {}"),
}
BLOCKING_CALLS = {"time.sleep", "input", "requests.get", "requests.post"}
QOS_FACTORIES = {"create_publisher", "create_subscription"}
ALL_RULES = ("W9001", "W9002", "W9003", "W9010", "W9020", "E0001")


def _text(node: ast.expr) -> str:
    """Source of an expression; dotted names are read without recursion."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return ".".join([ast.unparse(node), *reversed(parts)])


def _call_name(func: ast.expr) -> str:
    return _text(func) if isinstance(func, (ast.Attribute, ast.Name)) else ""


def _is_callback(node: ast.AST, kinds: Sequence[type]) -> bool:
    return type(node) in kinds and "callback" in node.name.lower()


# Types of node that may have a call or a function below them.
_LEAVES = (ast.Constant, ast.Name, ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)
_INNER = frozenset(t for t in vars(ast).values()
                   if isinstance(t, type) and issubclass(t, ast.AST) and not issubclass(t, _LEAVES))


# Their fields that hold such nodes; the others hold names, numbers or leaves.
_PLAIN_FIELDS = {"id", "name", "names", "attr", "arg", "ctx", "op", "ops", "kind", "module", "level", "lineno", "tag", "rest",
                 "type_comment", "type_ignores", "is_async", "simple", "conversion", "asname", "kwd_attrs"}
_NODE_FIELDS = {t: tuple(f for f in t._fields if f not in _PLAIN_FIELDS) for t in _INNER}


def _inner_nodes(node: ast.AST) -> list[ast.AST]:
    """Children that may hold calls or functions, last first."""
    out = []
    for field in _NODE_FIELDS[type(node)]:
        value = getattr(node, field, None)
        kind = type(value)
        if kind in _INNER:
            out.append(value)
        elif kind is list:
            out += [v for v in value if type(v) in _INNER]
    out.reverse()
    return out


def lint_source(code: str, rules: Sequence[str] = ALL_RULES, include_async: bool = False,
                custom: Mapping[str, Callable[[ast.Module], Iterable[tuple[int, str]]]] | None = None):
    """Yield (rule, symbol, line, message) for one module's source text.

    ``custom``: further rules by name, each a function of the parsed module that yields
    (line, message). The tree is walked with an explicit stack, so deep nesting (a sum of
    thousands of terms) is no special case."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        if "E0001" in rules:
            yield "E0001", RULES["E0001"][0], e.lineno, RULES["E0001"][1].format(e.msg)
        return
    missing = {"W9001", "W9002", "W9003"}
    found = []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef) if include_async else (ast.FunctionDef,)
    stack: list[tuple[ast.AST, int]] = [(tree, 0)]
    while stack:
        node, callbacks = stack.pop()
        if isinstance(node, ast.Call):
            func = node.func
            if isinstance(func, ast.Attribute):
                if func.attr in ("init", "shutdown") and "rclpy" in _text(func.value):
                    missing.discard("W9001" if func.attr == "init" else "W9002")
                elif func.attr == "destroy_node":
                    missing.discard("W9003")
                elif func.attr in QOS_FACTORIES and len(node.args) < 3 and \
                        not any(k.arg in ("qos_profile", "depth") for k in node.keywords):
                    found.append(("W9020", node.lineno, RULES["W9020"][1]))
            if callbacks and (name := _call_name(func)) in BLOCKING_CALLS:
                found.append(("W9010", node.lineno, RULES["W9010"][1].format(name)))
        inside = callbacks + _is_callback(node, functions)
        stack += [(child, inside) for child in _inner_nodes(node)]
    found += [(rule, 1, RULES[rule][1]) for rule in sorted(missing)]
    for rule, line, msg in found:
        if rule in rules:
            yield rule, RULES[rule][0], line, msg
    for rule, check in (custom or {}).items():
        for line, msg in check(tree):
            yield rule, rule, line, msg


def lint_row(code, rules: Sequence[str] = ALL_RULES, custom=None):
    """Finding tuples for one row; NULL code gives none; a crash gives one CRASH row."""
    if code is None:
        return []
    try:
        return list(lint_source(code, rules, custom=custom))
    except Exception as e:  # noqa: BLE001 - J6: isolate the failure to this row
        return [("CRASH", RULES["CRASH"][0], None, RULES["CRASH"][1].format(e))]


class LintCode:
    """The same check as a UDTF, for SQL users: ``SELECT ... FROM t, LATERAL lint(code)``."""

    def eval(self, code):
        yield from lint_row(code)


lint_udtf = udtf(LintCode, returnType=FINDING_SCHEMA, useArrow=True)


class LintTable:
    """The check over a whole table, with the rules chosen in SQL (L3):

    ``SELECT * FROM lint_table(TABLE(programs), 'code', array('W9010', 'E0001'))``

    The result has the table's other columns, whatever they are, and the finding columns.
    Without a rule list, or with NULL, all rules apply; a name that is no rule is an error
    when the query is analysed. A crash row (J6) is always kept."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, code: AnalyzeArgument, rules: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("lint_table: the first argument must be TABLE(...)")
        if not isinstance(code.value, str) or code.value not in rows.dataType.names:
            raise ValueError("lint_table: the second argument must name a column of the table")
        chosen = None if rules is None else rules.value
        unknown = [r for r in chosen or [] if r not in ALL_RULES]
        if unknown:
            raise ValueError(f"lint_table: unknown rules {unknown}")
        kept = [f for f in rows.dataType.fields if f.name != code.value]
        return AnalyzeResult(schema=T.StructType(kept + _finding_fields()))

    def eval(self, row, code, rules=None):
        fields = row.asDict()
        text = fields.pop(code)
        for found in lint_row(text, tuple(ALL_RULES if rules is None else rules)):
            yield (*fields.values(), *found)


def _finding_fields() -> list[T.StructField]:
    return [T.StructField("rule", T.StringType()), T.StructField("symbol", T.StringType()),
            T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())]


lint_table = udtf(LintTable)


def register_sql(spark: SparkSession) -> None:
    """Make the lint functions known to SQL: ``lint_code(code)`` and ``lint_table(TABLE(...), code, rules)``."""
    spark.udtf.register("lint_code", lint_udtf)
    spark.udtf.register("lint_table", lint_table)


def lint(corpus: DataFrame, code: str = "code", rules: Sequence[str] | None = None, custom=None) -> DataFrame:
    """Finding rows for every row of ``corpus``; its other columns are kept
    (the code text itself is not carried into the output).

    Runs over Arrow batches with ``mapInPandas`` (Spark partitions the corpus; each Python
    worker parses one batch at a time). ``rules`` names the enabled rules (L3), by default
    all of ``ALL_RULES``; ``custom`` adds rules of the caller's own (see ``lint_source``).
    A crash row (J6) is always kept."""
    enabled = tuple(ALL_RULES if rules is None else rules)
    keep = [f for f in corpus.schema.fields if f.name != code]
    out_schema = T.StructType(keep + _finding_fields())
    names = [f.name for f in keep]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            idx, found = [], []
            for i, text in enumerate(pdf[code]):
                for row in lint_row(text, enabled, custom):
                    idx.append(i)
                    found.append(row)
            part = pdf[names].iloc[idx].reset_index(drop=True)
            cols = pd.DataFrame(found, columns=["rule", "symbol", "line", "message"])
            cols["line"] = cols["line"].astype("Int32")
            yield pd.concat([part, cols], axis=1)

    return spread(corpus).mapInPandas(run, out_schema)


def syntax_gate(corpus: DataFrame, key: Sequence[str], code: str = "code") -> DataFrame:
    """Per candidate, whether its code parses (NULL code does not pass)."""
    key = list(key)
    errs = lint(corpus.select(*key, code), code).where(F.col("rule").isin("E0001", "CRASH")) \
        .select(*key).distinct().withColumn("_bad", F.lit(True))
    return corpus.select(*key, code).join(errs, key, "left").select(
        *key, (F.col(code).isNotNull() & F.col("_bad").isNull()).alias("parses"))


def rule_frequency(findings: DataFrame, corpus: DataFrame, key: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Share of candidates with each rule, by ``dims`` (e.g. model, difficulty).

    Candidates are counted once per rule (distinct), the denominator is every candidate
    of the group, including those without findings.
    """
    key, dims = list(key), list(dims)
    # findings carry the dims where lint got them; one distinct count, no join with the corpus
    carried = findings if set(dims) <= set(findings.columns) else \
        findings.select(*key, "rule").join(corpus.select(*key, *dims), key)
    hits = carried.select(*key, *dims, "rule").distinct().groupBy(*dims, "rule").agg(
        F.count(F.lit(1)).cast("long").alias("n_with_rule"))
    totals = corpus.groupBy(*[F.col(d).alias(f"_t_{d}") for d in dims]).agg(
        F.count(F.lit(1)).cast("long").alias("n_candidates"))
    cond = [hits[d].eqNullSafe(totals[f"_t_{d}"]) for d in dims]
    return hits.join(totals, cond, "inner").drop(*[f"_t_{d}" for d in dims]).withColumn(
        "share", F.col("n_with_rule") / F.col("n_candidates"))

"""Text column expressions: B5, H2, H3, H7, H8, H13, H14, H17, H18.

All are native Spark expressions (regex, string and higher-order functions), so they
run inside whole-stage code generation or at least on the JVM, never in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# The code-fence pattern of model replies (first fence tagged python, py
# or nothing, case-insensitive, dot matches newline), written for Java regex with Unicode
# classes; \x1c-\x1f are added because Python counts them as whitespace and Java does not.
_WS = r"[\s\x1c-\x1f]"
CODE_FENCE = r"(?isU)```(?:python|py)?" + _WS + r"*\n(.*?)```"
# Every character that Python's str.strip() removes.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + \
    "\u2028\u2029\u202f\u205f\u3000"

# Bounds on stored text (characters unless said otherwise).
STDOUT_CHARS = 4000
LOG_TAIL_BYTES = 2_000_000
FAILURE_TEXT_CHARS = 1000
BAD_LINE_CHARS = 200


def py_strip(c) -> Column:
    """Python ``str.strip()`` on a column (Unicode whitespace, as Python defines it).

    The built-in trim looks at the ends only; a regex anchored at the end would try every
    inner run of blanks."""
    return F.trim(as_col(c), F.lit(_BLANKS))


def extract_code(text) -> Column:
    """H2: body of the first code fence tagged python/py/none, else the whole text; stripped."""
    t = as_col(text)
    body = F.regexp_extract(t, CODE_FENCE, 1)
    return py_strip(F.when(t.rlike(CODE_FENCE), body).otherwise(t))


def estimate_tokens(text) -> Column:
    """H3: max(1, len(text) // 4)."""
    return F.greatest(F.lit(1), F.floor(F.length(as_col(text)) / 4).cast("int"))


def needs_verification(error, code) -> Column:
    """A candidate is verified when it has no error and non-empty code."""
    e, c = as_col(error), as_col(code)
    return (e.isNull() | (e == F.lit(""))) & c.isNotNull() & (c != F.lit(""))


def stored_code(code) -> Column:
    """Code is stored as NULL when empty."""
    return F.nullif(as_col(code), F.lit(""))


def head_chars(c, n: int = STDOUT_CHARS) -> Column:
    """First n characters (NULL stays NULL)."""
    return F.substring(as_col(c), 1, int(n))


def tail_bytes(b, n: int = LOG_TAIL_BYTES) -> Column:
    """Last n bytes of a binary log (whole value when shorter)."""
    b = as_col(b)
    return F.when(F.octet_length(b) > int(n), F.substring(b, -int(n), int(n))).otherwise(b)


def decode_lossy(b) -> Column:
    """Bytes as UTF-8 text, invalid sequences replaced by U+FFFD."""
    return F.make_valid_utf8(as_col(b).cast("string"))


def clip_logs(df, stdout: str = "stdout", stderr: str = "stderr"):
    """Stored stdout/stderr are the first 4,000 characters."""
    out = df
    for c in (stdout, stderr):
        if c in df.columns:
            out = out.withColumn(c, head_chars(c, STDOUT_CHARS))
    return out


def join_text_blocks(blocks) -> Column:
    """Concatenated text of blocks whose type is 'text'; other blocks ignored."""
    b = as_col(blocks)
    texts = F.filter(b, lambda x: (x["type"] == F.lit("text")) & x["text"].isNotNull())
    return F.coalesce(F.array_join(F.transform(texts, lambda x: x["text"]), ""), F.lit(""))


def parse_ks(spec: str | None, default: Sequence[int] = (1, 5, 10)) -> list[int]:
    """Comma list of k values, blanks skipped; empty falls back to the default."""
    if not spec or not spec.strip():
        return list(default)
    ks = [int(p.strip()) for p in spec.split(",") if p.strip()]
    return ks or list(default)


# ---------------------------------------------------------------------------
# H7 prompts, H8 programs
# ---------------------------------------------------------------------------

def _topic_list(topics) -> Column:
    return F.array_join(F.transform(F.coalesce(topics, F.array()),
                                    lambda t: F.concat(F.lit("`"), t["name"], F.lit("` ("), t["type"], F.lit(")"))),
                        ", ")


def system_text(ros_distro: str = "humble", strictness: str = "strict") -> str:
    """The system part of a prompt (our own wording)."""
    mode = " (strict mode)" if strictness == "strict" else ""
    return (f"You write ROS {ros_distro} nodes in Python with rclpy.\n\n"
            f"Rules{mode}:\n"
            "- Return one complete, runnable Python module for the requested node.\n"
            "- Initialise and shut down rclpy in main(args=None); destroy the node before exit.\n"
            "- Give publishers and subscriptions an explicit QoS depth (10 unless told otherwise).\n"
            "- Import message types from the standard message packages; do not redefine them.\n"
            "- Reply with a single ```python fenced block and no prose.")


def render_prompt(task_id, prompt, entry_point, node_type, difficulty, concepts, iface,
                  fewshot: Column | None = None, ros_distro: str = "humble", strictness: str = "strict") -> Column:
    """H7: system text, optional few-shot block, task text; joined by blank lines, trimmed,
    one newline at the end. The wording is ours; the structure follows the reference.

    ``iface`` is the interface_spec struct; ``fewshot`` an optional array of
    struct<prompt, solution>.
    """
    system = F.lit(system_text(ros_distro, strictness))
    iface = as_col(iface)
    concepts = as_col(concepts)
    concept_text = F.when(F.size(F.coalesce(concepts, F.array())) > 0, F.array_join(concepts, ", ")) \
        .otherwise(F.lit("none listed"))
    lines = F.concat_ws(
        "\n",
        F.when(iface["node_name"].isNotNull() & (iface["node_name"] != ""),
               F.concat(F.lit("- Node name: `"), iface["node_name"], F.lit("`"))),
        F.when(F.size(F.coalesce(iface["topics_published"], F.array())) > 0,
               F.concat(F.lit("- Publishes: "), _topic_list(iface["topics_published"]))),
        F.when(F.size(F.coalesce(iface["topics_subscribed"], F.array())) > 0,
               F.concat(F.lit("- Subscribes: "), _topic_list(iface["topics_subscribed"]))),
        F.when(F.size(F.coalesce(iface["services_provided"], F.array())) > 0,
               F.concat(F.lit("- Services provided: "), F.size(iface["services_provided"]).cast("string"))),
        F.when(F.size(F.coalesce(iface["parameters"], F.array())) > 0,
               F.concat(F.lit("- Parameters: "), F.size(iface["parameters"]).cast("string"))),
    )
    task = F.concat(
        F.lit("Task "), as_col(task_id), F.lit(" (difficulty "), F.coalesce(as_col(difficulty), F.lit("unknown")),
        F.lit(", node type "), F.coalesce(as_col(node_type), F.lit("unknown")), F.lit(")\n\n"),
        F.lit("ROS concepts: "), concept_text, F.lit("\n\n"),
        F.lit("Entry point class: `"), as_col(entry_point), F.lit("`\n\n"),
        F.lit("Interface:\n"), lines, F.lit("\n\n"),
        F.lit("Complete this stub:\n```python\n"), as_col(prompt), F.lit("\n```\n\n"),
        F.lit("Write the whole node, not only the body."))
    parts = [system]
    if fewshot is not None:
        shots = F.transform(fewshot, lambda ex, i: F.concat(
            F.lit("Example "), (i + 1).cast("string"), F.lit(":\nPrompt:\n```\n"), ex["prompt"],
            F.lit("\n```\nSolution:\n```python\n"), ex["solution"], F.lit("\n```")))
        block = F.when(F.size(fewshot) > 0, F.concat(
            F.lit("Worked examples ("), F.size(fewshot).cast("string"), F.lit("):\n"), F.array_join(shots, "\n")))
        parts.append(block)
    parts.append(task)
    return F.concat(py_strip(F.concat_ws("\n\n", *parts)), F.lit("\n"))


# The standard main() appended to an assembled program that has none;
# {entry_point} is replaced by the task's entry-point class.
MAIN_TEMPLATE = """

def main(args=None):
    rclpy.init(args=args)
    node = {entry_point}()
    try:
        rclpy.spin(node)
    except KeyboardInterrupt:
        pass
    finally:
        node.destroy_node()
        rclpy.shutdown()


if __name__ == "__main__":
    main()
"""


def main_wrapper(entry_point) -> Column:
    """MAIN_TEMPLATE with the entry point filled in."""
    before, after = MAIN_TEMPLATE.split("{entry_point}")
    return F.concat(F.lit(before), as_col(entry_point), F.lit(after))


def assemble_program(prompt, body, entry_point) -> Column:
    """H8: scaffold + body; when no ``def main(`` exists, prepend ``import rclpy`` if absent and
    append a standard main()."""
    full = F.concat(F.coalesce(as_col(prompt), F.lit("")), F.coalesce(as_col(body), F.lit("")))
    has_main = full.contains("def main(")
    with_import = F.when(full.contains("import rclpy"), full).otherwise(F.concat(F.lit("import rclpy\n"), full))
    return F.when(has_main, full).otherwise(F.concat(with_import, main_wrapper(entry_point)))

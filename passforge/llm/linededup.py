"""Line dedup by a log-template tree (operator 4, DataFrame functions only).

The tree has a fixed depth: a line goes by its number of tokens, then by its first
``DEPTH`` tokens, to a leaf. Tokens that look like variable fields (with a digit, an @ or
a ://) are written <*> beforehand. In a leaf the most widespread line is the first core; lines
that agree with it in at least ``ALIKE`` of their positions share its template, in which
the positions where a member differs are generalised to <*>. Of the lines that no core has
taken the most widespread is the next core, in rounds over all leaves at once with many cores
of a leaf in each, as long as its remaining lines count ``MIN_DOCS`` documents together. A template that occurs in
``MIN_DOCS`` documents or more is recurring, and its lines are dropped from every document.

Only hashes are shuffled for all lines. Texts move only for lines in leaves that at least
``MIN_DOCS`` documents share, and whole documents only where a line is dropped; both are
picked out by Bloom filters of bounded size. A hot line is counted map-side first, and
leaf and line tables are written with their sizes, so a skewed join can be split.

Defined cases: a null text has no lines to drop and stays null-as-empty; blank lines are
kept as they are and never counted; rows that repeat id and text count as one document
and get the same result; a document whose lines are all dropped becomes the empty text;
other columns are kept by ``dedup_lines`` (one named text holds the result); an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import remove_at_exit, scratch_path
from .common import stored, text_or_empty
from .ngramjoin import id_filter, maybe_in

DEPTH = 4
ALIKE = 0.7
MIN_DOCS = 5
FIRST_LINES = 64      # lines of a leaf that may become cores in the first round
MORE_LINES = 512      # and in each later one
FILTER_BITS = 2**26
FIELD_SIGN = "[0-9@]|://"
#: A token with such a sign; the look behind tries each token once, not at each of its letters.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*(?:[0-9@]|://)[^\x20\x09-\x0D]*"
BLANKS = r"[\x20\x09-\x0D]+"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line_no, tokens, leaf, template) of every line that is not blank."""
    text = text_or_empty(text_col)
    # hashed once a text, before its lines are dealt out
    once = docs.select(F.xxhash64(F.col(id_col), text).alias("doc"), F.split(text, "\n").alias("lines"))
    rows = once.select("doc", F.posexplode("lines").alias("line_no", "line"))
    # fields are looked for only in lines that have one; a line's tokens are made once (a
    # generator's output is not computed again for each use)
    line = F.col("line")
    masked = F.when(line.rlike(FIELD_SIGN), F.regexp_replace(line, FIELD, "<*>")).otherwise(line)
    tokens = F.array_remove(F.split(masked, BLANKS), "")
    return rows.select("doc", "line_no", F.inline(F.transform(F.array(tokens), lambda t: F.struct(
        F.xxhash64(F.size(t), F.slice(t, 1, DEPTH)).alias("leaf"), F.xxhash64(t).alias("line"),
        F.size(t).alias("n"), t.alias("tokens"))))).filter("n > 0").drop("n")


def _order() -> Column:
    """More documents first; ties by a hash of the line."""
    return F.struct(F.col("docs"), F.md5(F.encode(F.array_join("tokens", " "), "UTF-8")))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                    alike: float = ALIKE) -> tuple[DataFrame, DataFrame]:
    """(dropped lines as doc -> line numbers, recurring templates with their number of documents)."""
    lines = _lines(docs, id_col, text_col)
    leaves = stored(lines.select("leaf", "doc").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"))
                    .filter(F.col("docs") >= min_docs).select(F.col("leaf").alias("id")), "leaves")
    # a leaf that passes the filter by chance has too few documents to count in the end
    some = stored(maybe_in(lines, F.col("leaf"), id_filter(leaves, FILTER_BITS), FILTER_BITS)
                  .filter("__maybe").drop("__maybe"), "lines")

    # documents of each line, by hashes; its tokens travel once
    docs_of = some.select("leaf", "line", "doc").distinct().groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("docs"))
    tokens_of = some.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    spread = stored(docs_of.join(tokens_of, ["leaf", "line"]), "spread")
    placed = _templates(spread, min_docs, alike)

    where = some.select("leaf", "line", "doc", "line_no").join(
        placed.select(F.col("leaf").alias("l2"), F.col("line").alias("n2"), "template"),
        (F.col("leaf") == F.col("l2")) & (F.col("line") == F.col("n2")))
    where = stored(where.select("leaf", "template", "doc", "line_no"), "where")
    often = stored(where.select("leaf", "template", "doc").distinct().groupBy("leaf", "template").agg(
        F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs), "often")
    gone = where.join(often.select(F.col("leaf").alias("l2"), F.col("template").alias("t2")),
                      (F.col("leaf") == F.col("l2")) & (F.col("template") == F.col("t2")), "left_semi")
    gone = stored(gone.groupBy("doc").agg(F.array_sort(F.collect_set("line_no")).alias("gone")), "gone")
    # a template as text: positions where a member differs are fields
    fields = placed.join(often, ["leaf", "template"]).select(
        "leaf", "template", F.posexplode("same").alias("at", "same")).filter("same = 0").groupBy("leaf", "template").agg(
        F.collect_set("at").alias("fields"))
    named = often.join(placed.filter("line = template").select("leaf", "template", "tokens"), ["leaf", "template"]) \
        .join(fields, ["leaf", "template"], "left")
    shown = F.array_join(F.transform("tokens", lambda t, i: F.when(
        F.array_contains(F.coalesce("fields", F.array().cast("array<int>")), i), F.lit("<*>")).otherwise(t)), " ")
    return gone, named.select(shown.alias("template"), "docs")


def _templates(spread: DataFrame, min_docs: int, alike: float) -> DataFrame:
    """(leaf, line, template, tokens, same) of the lines that some core takes, round by round.

    Cores are found in the order of the lines, so a line's core is the first that it agrees with, or the line
    itself. A round takes the first lines of each leaf, the cores among them, and then each line of the leaf that one
    of these takes. All rounds are read back as one table, so a plan does not grow with their number."""
    spark = spread.sparkSession
    path = remove_at_exit(spark, scratch_path(spark, "llm-rounds"))

    def like(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda a, b: (a == b).cast("int"))
        return F.aggregate(same, F.lit(0), lambda acc, n: acc + n) / F.size(x) >= alike

    core_type = spread.select(F.struct("line", "tokens").alias("c")).schema["c"].dataType
    none = F.lit(None).cast(core_type)
    left, number, most = spread, 0, FIRST_LINES
    while True:
        rank = F.row_number().over(Window.partitionBy("leaf").orderBy(_order().desc()))
        first = left.withColumn("rank", rank).filter(F.col("rank") <= most).groupBy("leaf").agg(
            F.sum("docs").alias("all"), F.array_sort(F.collect_list(F.struct("rank", "line", "tokens"))).alias("first"))
        cores = F.aggregate("first", F.array().cast(ArrayType(core_type)), lambda acc, x: F.when(
            F.exists(acc, lambda c: like(x["tokens"], c["tokens"])), acc).otherwise(
            F.concat(acc, F.array(F.struct(x["line"].alias("line"), x["tokens"].alias("tokens"))))))
        # a leaf with too few documents left ends; one that may have more lines than these goes on
        cores = first.filter((F.col("all") >= min_docs) | (F.size("first") == most)).select("leaf", cores.alias("cores"))
        own = F.aggregate("cores", none, lambda acc, c: F.coalesce(acc, F.when(like(F.col("tokens"), c["tokens"]), c)))
        near = left.join(cores, "leaf").withColumn("core", own)
        same = F.zip_with("tokens", "core.tokens", lambda a, b: (a == b).cast("int"))
        near = near.select("leaf", "line", "docs", "tokens", F.col("core.line").alias("template"), same.alias("same"))
        near.write.parquet(f"{path}/number={number}")
        left = spark.read.schema(near.schema).parquet(f"{path}/number={number}").filter("template is null") \
            .select("leaf", "line", "docs", "tokens")
        if left.limit(1).count() == 0:
            return spark.read.schema(near.schema).parquet(path).filter("template is not null") \
                .select("leaf", "line", "template", "tokens", "same")
        number, most = number + 1, MORE_LINES


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the (ascending) numbers of ``gone``, in one pass: a mark for each
    line up to the last of them, and lines with the mark 1 become null, which a join leaves out."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, 1, F.size(gone) - 1))
    marks = F.array_join(F.zip_with(gone, before, lambda g, b: F.concat(F.repeat(F.lit("0"), g - b - 1), F.lit("1"))), "")
    kept = F.zip_with(F.split(text, "\n"), F.split(marks, ""), lambda line, mark: F.when(F.coalesce(mark, F.lit("")) != "1", line))
    return F.array_join(kept, "\n")


def _cleaned(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, keep: Column) -> DataFrame:
    """(keep, __text, __gone): documents with a dropped line are joined, the others pass by."""
    text = text_or_empty(text_col)
    rows = docs.select(keep.alias("__keep"), text.alias("__old"), F.xxhash64(F.col(id_col), text).alias("__doc"))
    words = id_filter(gone.select(F.col("doc").alias("id")), FILTER_BITS)
    rows = maybe_in(rows, F.col("__doc"), words, FILTER_BITS)
    none = F.array().cast("array<int>")
    plain = rows.filter("not __maybe").select("__keep", F.col("__old").alias("__text"), none.alias("__gone"), "__old")
    # line numbers are looked up, so texts are dealt by document but never sorted
    hit = rows.filter("__maybe").join(gone.hint("shuffle_hash"), F.col("__doc") == F.col("doc"), "left")
    hit = hit.withColumn("gone", F.coalesce("gone", none))
    return plain.unionByName(hit.select("__keep", F.when(F.size("gone") > 0, _without(F.col("__old"), F.col("gone")))
                                        .otherwise(F.col("__old")).alias("__text"), F.col("gone").alias("__gone"), "__old"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their columns; the text column without recurring lines."""
    gone, _ = recurring_lines(docs, id_col, text_col, min_docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = _cleaned(docs, gone, id_col, text_col, row)
    return out.select(*[(F.col("__text") if c == text_col else F.col("__keep").getField(c)).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars and text_sha256 of the cleaned text."""
    gone, _ = recurring_lines(docs, id_col, text_col, min_docs)
    out = _cleaned(docs, gone, id_col, text_col, F.col(id_col))
    return out.select(F.col("__keep").alias("doc_id"), F.size(F.split("__old", "\n")).cast("long").alias("n_lines"),
                      F.size("__gone").cast("long").alias("n_dropped"), F.length("__text").cast("long").alias("n_chars"),
                      F.sha2(F.encode("__text", "UTF-8"), 256).alias("text_sha256"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM t),
ln AS (SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no
       FROM (SELECT DISTINCT * FROM d)),
tk AS (SELECT doc_id, text, line_no, list_filter(string_split_regex(
         regexp_replace(line, '[^\x20\x09-\x0D]*(?:[0-9@]|://)[^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'),
         lambda x: x <> '') AS tokens FROM ln),
ls AS (SELECT doc_id, text, line_no, array_to_string(tokens, ' ') AS line, tokens,
              len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:4], ' ') AS leaf FROM tk WHERE len(tokens) > 0),
lf AS (SELECT leaf FROM (SELECT DISTINCT leaf, doc_id, text FROM ls) GROUP BY leaf HAVING count(*) >= 5),
sp AS (SELECT leaf, line, any_value(tokens) AS tokens, count(*) AS docs
       FROM (SELECT DISTINCT leaf, line, tokens, doc_id, text FROM ls SEMI JOIN lf USING (leaf)) GROUP BY leaf, line),
st AS (SELECT leaf, list({'line': line, 'tokens': tokens, 'docs': docs} ORDER BY docs DESC, md5(line) DESC) AS rem
       FROM sp GROUP BY leaf
       UNION ALL
       SELECT leaf, list_filter(rem, lambda x: len(list_filter(list_zip(x.tokens, rem[1].tokens), lambda z: z[1] = z[2]))
                                               / len(x.tokens)::DOUBLE < 0.7::DOUBLE) FROM st
       WHERE list_sum(list_transform(rem, lambda x: x.docs)) >= 5),
pl AS (SELECT leaf, rem[1].line AS template, unnest(list_transform(list_filter(rem, lambda x:
                len(list_filter(list_zip(x.tokens, rem[1].tokens), lambda z: z[1] = z[2])) / len(x.tokens)::DOUBLE >= 0.7::DOUBLE),
                lambda x: x.line)) AS line
       FROM st WHERE list_sum(list_transform(rem, lambda x: x.docs)) >= 5),
wh AS (SELECT doc_id, text, line_no, leaf, template FROM ls JOIN pl USING (leaf, line)),
oft AS (SELECT leaf, template FROM (SELECT DISTINCT leaf, template, doc_id, text FROM wh) GROUP BY leaf, template HAVING count(*) >= 5),
gone AS (SELECT doc_id, text, list(line_no) AS gone FROM wh SEMI JOIN oft USING (leaf, template) GROUP BY doc_id, text),
o AS (SELECT d.doc_id, d.lines, g.gone,
             CASE WHEN g.gone IS NULL THEN d.text ELSE coalesce(array_to_string(
               list_filter(d.lines, lambda x, i: NOT list_contains(g.gone, i)), chr(10)), '') END AS cleaned
      FROM d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
       length(cleaned)::BIGINT AS n_chars, sha256(cleaned) AS text_sha256 FROM o
"""

"""Chat formatting by quotation linking (operator 7).

Messages of a conversation may quote earlier ones, mail style: lines that begin with >
(>> for a quote in a quote, and so on). Each message is parsed into its own text and its
quoted passages (runs of lines of one level). Passages and own texts are normalised
(A-Z lower case, white space to one blank) and hashed: as a whole, by paragraph and by
line (a paragraph or line of ``SHORTEST`` characters at least; a whole of any length). A
passage belongs to the first message of the conversation that says it; the
message that quotes it is a reply to the message its outermost quotes match best (most
characters, then the latest). Threads follow replies to their root. A conversation is in
reply order: threads by the turn of their root, and behind each message its replies by turn,
each with all that follows from it; a conversation without quotes keeps its order. Quotes and
the lines that introduce them are left out of the formatted message.

Work: passages and units meet in a join on (conversation, hash) with one row per unit,
never as pairs; roots and paths (the turns from the root to a message) are found by doubling
steps along the replies; positions come from a range partitioning by path, so one conversation
may hold any share of the rows. A path is as long as its thread is deep.

Defined cases: a null text is empty; rows that repeat a whole message are one message;
messages of one turn are told apart by role and text; a null conversation is a
conversation of its own, a null turn comes first; a quote without an original, or of the
message itself or a later one, links nothing; other columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positions
from .common import bound_batches, stored, text_or_empty

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
#: Closing words of a line that introduces a quote, in a few languages.
_INTRO = re.compile(r".{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*", re.I | re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHORTEST = 8  # characters of a paragraph or line that is recognised within a longer text


def normal(text: str) -> str:
    return " ".join(text.split()).translate(_LOWER)


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)]): quoted runs of lines by level, without their marks."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    running = 0
    for line in text.split("\n"):
        m = _QUOTE.fullmatch(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        elif level == running:
            quotes[-1][1].append(m[2])
        else:
            if not running:  # the line above may introduce the quote
                while own and not own[-1].strip():
                    own.pop()
                if own and _INTRO.fullmatch(own[-1]):
                    own.pop()
            quotes.append((level, [m[2]]))
        running = level
    text = "\n".join(own).strip()
    return re.sub(r"\n{3,}", "\n\n", text) if quotes else text, [(level, "\n".join(lines)) for level, lines in quotes]


def units(text: str) -> dict[int, int]:
    """Hash -> length of a text's units: the whole, of any length, its paragraphs, its lines."""
    found = {}
    for k, part in enumerate([text, *re.split(r"\n\s*\n", text), *text.split("\n")]):
        n = normal(part)
        if len(n) >= (SHORTEST if k else 1):
            found[xxhash.xxh64_intdigest(n.encode("utf-8", "surrogatepass")) - 2**63] = len(n)
    return found


_PARSED = "own string, units array<struct<h: long, n: int>>, quotes array<struct<level: int, h: long, n: int>>"


def parse_messages(messages: DataFrame) -> DataFrame:
    """Add own text, its units and the units of its quotes."""
    @F.pandas_udf(_PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                own, quotes = split_quotes(text)
                rows.append((own, [{"h": h, "n": n} for h, n in units(own).items()],
                             [{"level": level, "h": h, "n": n} for level, q in quotes for h, n in units(q).items()]))
            yield pd.DataFrame(rows, columns=["own", "units", "quotes"])
    return messages.withColumn("p", run("text")).select("*", "p.*").drop("p")


def link_quotes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, own, parent_turn, root_turn, position (in reply order), n_quotes, formatted; a
    row per message."""
    bound_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                                text_or_empty("text").alias("text")).distinct()
    # the key of a message: conversation and turn as hashes with nulls in them, role and text
    rows = rows.withColumn("conv", F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit("null:")))) \
        .withColumn("at", F.coalesce("turn", F.lit(-2**62))) \
        .withColumn("msg", F.xxhash64("conv", "at", "role", "text"))
    parsed = stored(parse_messages(rows).drop("text"), "messages")
    said = parsed.select("conv", "at", "msg", F.explode("units").alias("u")).groupBy("conv", F.col("u.h").alias("h")).agg(
        F.min(F.struct("at", "msg")).alias("first"))
    asked = parsed.select("conv", "at", "msg", F.explode("quotes").alias("q")).select(
        "conv", F.col("q.h").alias("h"), F.col("at").alias("q_at"), F.col("msg").alias("q_msg"), "q.level", "q.n")
    found = asked.join(said, ["conv", "h"]).filter(F.col("first.at") < F.col("q_at"))
    per = found.groupBy("conv", F.col("q_msg").alias("msg"), "level", "first").agg(F.sum("n").alias("chars"))
    reply = stored(per.groupBy("conv", "msg").agg(
        F.max(F.struct((-F.col("level")).alias("near"), "chars", "first")).alias("best"))
        .select("msg", F.col("best.first.msg").alias("to"), F.col("best.first.at").alias("to_at")), "replies")

    # roots: each round follows the links twice as far
    key = F.struct("at", "msg")
    up = reply.join(parsed.select("msg", "at"), "msg").select(
        "msg", F.col("to").alias("root"), F.col("to_at").alias("root_at"), F.array(key).alias("path"))
    while True:
        step = up.select(F.col("msg").alias("root"), F.col("root").alias("further"), F.col("root_at").alias("further_at"),
                         F.col("path").alias("before"))
        nxt = stored(up.join(step, "root", "left").select(
            "msg", F.coalesce("further", "root").alias("root"), F.coalesce("further_at", "root_at").alias("root_at"),
            F.when(F.col("further").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"),
            F.col("further").isNotNull().alias("moved")), "roots")
        up = nxt.drop("moved")
        if nxt.filter("moved").limit(1).count() == 0:
            break
    full = parsed.join(reply.select("msg", F.col("to_at").alias("parent_at")), "msg", "left").join(
        up.select("msg", "root_at", F.concat(F.array(F.struct(F.col("root_at").alias("at"), F.col("root").alias("msg"))), "path")
                  .alias("path")), "msg", "left")
    full = full.withColumn("root_at", F.coalesce("root_at", "at")).withColumn("path", F.coalesce("path", F.array(key)))
    ordered = positions(full.drop("units").withColumn("n_quotes", F.size("quotes").cast("long")).drop("quotes"),
                        ["conv"], ["path"], out="position")
    back = lambda c: F.when(F.col(c) == -2**62, None).otherwise(F.col(c))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>\n"))
    return ordered.select("conv_id", "turn", "role", "own", back("parent_at").alias("parent_turn"),
                          back("root_at").alias("root_turn"), "position", "n_quotes", formatted.alias("formatted"))

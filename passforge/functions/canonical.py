"""Canonical JSON: keys sorted at every level, one spacing, one escaping, one number format.

The text equals what a key-sorted dump of the parsed value gives in Python: ``", "`` and
``": "`` between items, everything beyond printable ASCII as ``\\uXXXX``, integers as written,
other numbers as the shortest digits of the double.

Native expressions only. VARIANT objects keep their fields sorted, so parsing and printing sorts
every level. Around that, strings are marked ``s`` and numbers become strings marked ``n``,
so the numbers' digits pass through unchanged and nothing is taken for something else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col, let

_TOKENS = r'"(?:[^"\\]|\\.)*+"|[^"]+'
_NUMBER = r"-?[0-9][0-9.eE+-]*"
_PARTS = r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"


def canonical_json(text) -> Column:
    """The key-sorted text of a JSON document; NULL where ``text`` is no JSON.

    A repeated key keeps the last value if the session allows repeated keys, else the
    document is no JSON. Keys are ordered by UTF-16 units."""
    marked = F.array_join(F.transform(_tokens(as_col(text)), _mark), "")
    printed = F.to_json(F.try_parse_json(F.when(F.try_parse_json(as_col(text)).isNotNull(), marked)))
    return F.array_join(F.transform(_tokens(printed), _unmark), "")


def _tokens(text: Column) -> Column:
    """Strings and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))


def _mark(token: Column) -> Column:
    return F.when(token.startswith('"'), F.concat(F.lit('"s'), F.substring(token, 2, 2**31 - 1))) \
        .otherwise(F.regexp_replace(token, _NUMBER, '"n$0"'))


def _unmark(token: Column) -> Column:
    inner = F.substring(token, 3, 2**31 - 1)
    number = F.rtrim(inner, F.lit('"'))
    return (F.when(token.startswith('"s'), _ascii(F.concat(F.lit('"'), inner)))
            .when(token.startswith('"n'), F.when(number.rlike(r"^-?[0-9]+$"), F.when(number == "-0", F.lit("0")).otherwise(number))
                  .otherwise(_float(number)))
            .otherwise(F.replace(F.replace(token, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))))


def _ascii(string: Column) -> Column:
    """Characters beyond printable ASCII as lower-case ``\\uXXXX`` of their UTF-16 units."""
    def part(p: Column) -> Column:
        units = F.lower(F.hex(F.encode(p, "UTF-16BE")))
        return F.when(p.rlike(r"^[\x20-\x7E]"), p).otherwise(F.regexp_replace(units, "(....)", r"\\u$1"))

    parts = F.regexp_extract_all(string, F.lit(r"[\x20-\x7E]+|[^\x20-\x7E]+"), F.lit(0))

    def lowered(out: Column) -> Column:
        lower = out
        for digit in "ABCDEF":  # control characters come with upper-case digits
            lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
        return F.when(out.contains("\\u00"), lower).otherwise(out)

    return let(F.when(string.rlike(r"[^\x20-\x7E]"), F.array_join(F.transform(parts, part), "")).otherwise(string), lowered)


def _float(number: Column) -> Column:
    """A number with a point or an exponent as the shortest digits of its double.

    Up to 15 significant digits are their own shortest form; more are read as a double first."""
    def digits(n: Column) -> Column:
        return F.concat(F.regexp_extract(n, _PARTS, 1), F.regexp_extract(n, _PARTS, 2))

    short = F.length(F.regexp_replace(digits(number), "^0+|0+$", "")) <= 15
    double = number.cast("double")
    tries = F.array(*[F.format_string(f"%.{p}e", double) for p in range(17)], double.cast("string"))
    shortest = F.when(short, number).otherwise(F.filter(tries, lambda t: t.cast("double") == double)[0])

    def laid_out(d: Column, power: Column) -> Column:
        size, point = F.length(d), power + 1
        rest = F.substring(d, 2, 2**31 - 1)
        scientific = F.concat(F.substring(d, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")), F.lit("e"),
                              F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                              F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
        plain = (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
                 .when(point >= size, F.concat(d, F.repeat(F.lit("0"), point - size), F.lit(".0")))
                 .otherwise(F.concat(d.substr(F.lit(1), point), F.lit("."), d.substr(point + 1, size))))
        return F.when((power >= -4) & (power < 16), plain).otherwise(scientific)

    def written(n: Column, every: Column) -> Column:
        exponent = F.coalesce(F.nullif(F.regexp_extract(n, _PARTS, 3), F.lit("")).cast("int"), F.lit(0))

        def by_digits(behind_zeros: Column) -> Column:
            point = F.length(F.regexp_extract(n, _PARTS, 1)) + exponent - (F.length(every) - F.length(behind_zeros))
            return let(F.regexp_replace(behind_zeros, "0+$", ""), lambda d: F.when(d == "", F.lit("0.0")).otherwise(
                let(point - 1, lambda power: laid_out(d, power))))

        return let(F.regexp_replace(every, "^0+", ""), by_digits)

    body = let(shortest, lambda n: let(digits(n), lambda every: written(n, every)))
    return F.concat(F.when(number.startswith("-"), F.lit("-")).otherwise(F.lit("")), body)

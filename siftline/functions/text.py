"""Columns over file texts: lines as arrays within the row, so that nothing here shuffles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.fixed_values import ROW_CHARS

#: White space that trimming removes; wider than Spark's trim.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), rf"{SPACE}+\z", "")


def row_text(raw: Column) -> Column:
    """What a result row shows of a line."""
    return F.substring(trimmed(raw), 1, ROW_CHARS)


def line_array(text: Column) -> Column:
    """Lines without their ends; a newline at the end of the text begins no line. Null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda x: F.regexp_replace(x, r"\r\z", ""))


def decoded(content: Column) -> Column:
    """Text of a file's bytes: UTF-16 by its mark, else UTF-8 with bad bytes replaced; null if a NUL shows it to be binary."""
    mark, size = F.hex(F.substring(content, 1, 3)), F.length(content)
    wide = lambda name: F.when(size % 2 == 0, F.decode(content.substr(F.lit(3), size), name))
    text = (
        F.when(mark.startswith("FFFE"), wide("UTF-16LE"))
        .when(mark.startswith("FEFF"), wide("UTF-16BE"))
        .when(mark == "EFBBBF", F.make_valid_utf8(content.substr(F.lit(4), size).cast("string")))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )
    return F.when(~F.contains(text, F.lit("\0")), text)


def quoted(literal: str) -> str:
    """A regular expression for the literal."""
    return "".join(f"\\{c}" if c in "\\^$.|?*+()[]{}-&~#" else c for c in literal)


def insensitive(pattern: str) -> str:
    """ASCII letters fold among themselves; folding beyond ASCII only where the pattern goes beyond it."""
    return ("(?iu)" if re.search(r"[^\x00-\x7F]", pattern) else "(?i)") + pattern


def edge(pattern: str, left: bool) -> str:
    """Boundary of a word or identifier; `$` counts as part of identifiers."""
    if re.search(r"^\w" if left else r"\w$", pattern, re.ASCII):
        return r"\b"
    return r"(?<![\w$])" if left else r"(?![\w$])"


def bounded(pattern: str) -> str:
    return edge(pattern, True) + pattern + edge(pattern, False)


def whole_word(pattern: str) -> str:
    return f"{edge(pattern, True)}(?:{pattern}){edge(pattern, False)}"


#: Elements of an array that one inner fold appends to its result; folds of folds keep long arrays linear.
FOLD = 128


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def chunks(values: Column) -> Column:
    """The array cut into arrays of FOLD elements."""
    n = F.ceil(F.size(values) / FOLD).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(values, i * FOLD + 1, FOLD))).otherwise(F.slice(F.array(values), 1, 0))


def sums_before(values: Column) -> Column:
    """For each element of an array of integers the sum of those before it."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("before"))

    def fold(some: Column) -> Column:
        return F.aggregate(some, start, lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before")))

    def joined(parts: Column) -> Column:
        bases = fold(F.transform(parts, lambda p: p["total"]))["before"]
        return F.flatten(F.zip_with(parts, bases, lambda p, base: F.transform(p["before"], lambda x: x + base)))

    return let(F.transform(chunks(values), fold), joined)


def match_columns(raw: Column, pattern: str | Column) -> Column:
    """1-based columns of the non-overlapping, non-empty matches in a line: sums of what stands between and of matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.transform(F.regexp_extract_all(raw, pattern, F.lit(0)), F.length)
    pieces = F.transform(F.split(raw, pattern, F.lit(-1)), F.length)

    def starts(x: Column) -> Column:
        between = F.slice(x["pieces"], F.lit(1), F.size(x["matches"]))
        before = sums_before(F.zip_with(between, x["matches"], lambda p, m: (p + m).cast("long")))
        return F.zip_with(before, between, lambda b, p: (b + p + 1).cast("int"))

    one = lambda x: F.array(F.get(x["pieces"], 0) + 1)
    return let(F.struct(matches.alias("matches"), pieces.alias("pieces")), lambda x: F.when(F.size(x["matches"]) == 1, one(x)).otherwise(starts(x)))


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal; an empty one has none."""
    return F.size(F.split(text, quoted(literal), -1)) - 1 if literal else F.lit(0)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)\.([^.]*)\z", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def module_key(path: Column) -> Column:
    """Last segment less its last extension, in lower case."""
    segment = F.regexp_extract(path, r"[^/\\]*\z", 0)
    return F.lower(F.regexp_replace(segment, r"(?<=.)\.[^.]*\z", ""))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(".")

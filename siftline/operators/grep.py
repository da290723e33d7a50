"""Content search. A file's lines stay in its row: matches, context and enclosing symbols need no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.expressions import bounded_hits, bounded_test, compiled, flattened, in_columns, may_be_empty, restarts
from siftline.functions.fixed_values import CONTEXT_MAX, MATCH_CAP, MATCH_SECONDS
from siftline.functions.text import insensitive, let, line_array, match_columns, quoted, row_text, whole_word
from siftline.operators.symbols import SYMBOL, symbol_array


def search_pattern(pattern: str, literal: bool = True, ignore_case: bool = False, word: bool = False, smart_case: bool = False) -> str:
    """The expression to look for. Smart case decides by the pattern's capitals; a leading (?i) of an expression wins."""
    if smart_case:
        ignore_case = not re.search("[A-Z]", pattern)
    if not literal and pattern.startswith("(?i)"):
        pattern, ignore_case = pattern[4:], True
    out = quoted(pattern) if literal else pattern
    if word:
        out = whole_word(out)
    return insensitive(out) if ignore_case else out


def hit_lines(lines: Column, pattern: str) -> Column:
    """(line, columns) of each line of an array that has a match."""
    seen = F.transform(lines, lambda x, i: F.when(x.rlike(pattern), F.struct((i + 1).alias("line"), match_columns(x, pattern).alias("columns"))))
    return F.array_compact(seen)


def has_match(text: Column, pattern: str) -> Column:
    """Whether a line of the text has a match of an expression."""
    return F.exists(line_array(text), lambda x: x.rlike(pattern)) if in_columns(pattern) and not restarts(pattern) else bounded_test(text, pattern)


def grep(
    files: DataFrame, pattern: str, literal: bool = True, ignore_case: bool = False, word: bool = False, smart_case: bool = False, before: int = 0, after: int = 0, enclosing: bool = False, depth: int = 0, seconds: float = MATCH_SECONDS
) -> DataFrame:
    """path, line, col, text of every match in files (path, text); before, after (arrays) and enclosing as asked.

    Expressions that are not safe on Java's engine, or quadratic there, and those that may match nothing, go to Arrow batches: the quadratic ones
    to RE2 where it reads them alike, the others to the matcher, which raises MatchOverBudget where one text takes it more than `seconds`.
    """
    rx = search_pattern(pattern, literal, ignore_case, word, smart_case)
    rx = rx if literal else flattened(rx)
    before, after = (max(0, min(CONTEXT_MAX, int(n))) for n in (before, after))
    rows = files.select("path", "text")
    if literal and not ignore_case and not smart_case:
        rows = rows.filter(F.contains(F.col("text"), F.lit(pattern)))
    given = not literal and (may_be_empty(rx) or not in_columns(rx) or restarts(rx))
    if given:
        rows = rows.withColumn("found", bounded_hits(F.col("text"), rx, seconds))
    elif not literal:
        compiled(rx)  # a wrong expression is refused here, not in a task

    def shown(hit: Column, lines: Column, symbols: Column | None) -> Column:
        at = hit["line"]
        fields = [at.alias("line"), hit["columns"].alias("columns"), row_text(F.get(lines, at - 1)).alias("text")]
        if before:
            first = F.greatest(at - before, F.lit(1))
            fields.append(F.transform(F.slice(lines, first, at - first), row_text).alias("before"))
        if after:
            fields.append(F.transform(F.slice(lines, at + 1, F.lit(after)), row_text).alias("after"))
        if enclosing:
            fields.append(F.try_element_at(F.filter(symbols, lambda s: s["line"] <= at), F.lit(-1)).alias("enclosing"))
        return F.struct(*fields)

    def of_hits(lines: Column, hits: Column) -> Column:
        if not enclosing:
            return F.transform(hits, lambda hit: shown(hit, lines, None))
        return let(symbol_array(lines, F.col("path"), depth), lambda symbols: F.transform(hits, lambda hit: shown(hit, lines, symbols)))

    def of_lines(lines: Column) -> Column:
        # Lines, matches and symbols are worked out once a file, and symbols only for files with a match.
        return let(F.col("found") if given else hit_lines(lines, rx), lambda hits: F.when(F.size(hits) > 0, of_hits(lines, hits)))

    found = rows.select("path", F.explode(let(line_array(F.col("text")), of_lines)).alias("hit"))
    extra = [f"hit.{name}" for name, wanted in (("before", before), ("after", after), ("enclosing", enclosing)) if wanted]
    return found.select("path", "hit.line", F.explode("hit.columns").alias("col"), "hit.text", *extra)


def in_order(matches: DataFrame) -> DataFrame:
    return matches.orderBy("path", "line", "col")


def capped(matches: DataFrame, cap: int = MATCH_CAP) -> DataFrame:
    """The first matches by path, line, column: a feature of the interactive search, whose rows a person pages through."""
    return in_order(matches).limit(cap)


def file_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def totals(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("path").alias("files"))


def summary(counts: DataFrame, key: str, top: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(top)


__all__ = ["SYMBOL", "capped", "file_counts", "grep", "in_order", "search_pattern", "summary", "totals"]

"""Approximate symbols of source texts, found line by line within each file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.fixed_values import COMMENT_LINE, EXTENSION_FAMILY, GENERATOR_LINE, NOT_A_METHOD, SYMBOL_SHAPES
from siftline.functions.text import extension, let, line_array, trimmed

SYMBOL = "struct<line:int,col:int,kind:string,name:string>"


def indent(raw: Column) -> Column:
    """Width of the leading blanks, a tab as four."""
    lead = F.regexp_extract(raw, r"^[ \t]*", 0)
    tabs = F.length(F.replace(lead, F.lit(" "), F.lit("")))
    return F.length(lead) + 3 * tabs


def shaped(line: Column, inner: Column, family: str) -> Column:
    """struct(kind, name) by the first shape that fits; a method shape that fits a control word ends the search with none."""
    out = F.lit(None).cast("struct<kind:string,name:string>")
    for pattern, kind, group, members_only, by_shape in reversed(SYMBOL_SHAPES[family]):
        name = F.regexp_extract(line, pattern, group)
        found = F.struct((F.lit(kind) if isinstance(kind, str) else F.regexp_extract(line, pattern, kind)).alias("kind"), name.alias("name"))
        if by_shape:
            found = F.when(~name.isin(*NOT_A_METHOD), found)
        fits = line.rlike(pattern)
        out = F.when(fits & inner if members_only else fits, found).otherwise(out)
    return out


def symbol_array(lines: Column, path: Column, depth: int = 0) -> Column:
    """Symbols of one file, top to bottom. lines: see line_array. depth 1 takes members (indented by four at most) as well."""

    def of(family: str) -> Column:
        def one(raw: Column, i: Column) -> Column:
            blank = raw.rlike(r"^[ \t]")

            def symbol(what: Column) -> Column:
                at = F.greatest(F.instr(raw, what["name"]), F.lit(1))
                return F.when(what.isNotNull(), F.struct((i + 1).alias("line"), at.alias("col"), what["kind"].alias("kind"), what["name"].alias("name")))

            def of_line(line: Column) -> Column:
                comment = F.lit(False) if family == "markdown" else line.rlike(COMMENT_LINE) & ~line.rlike(GENERATOR_LINE)
                return let(F.when((line != "") & ~comment, shaped(line, blank, family)), symbol)

            # Most lines are indented too far; they go no further than this test.
            return F.when(~blank | (indent(raw) <= 4) if depth else ~blank, let(trimmed(raw), of_line))

        return F.array_compact(F.transform(lines, one))

    def of_extension(ext: Column) -> Column:
        out = of("other")
        for family, extensions in EXTENSION_FAMILY.items():
            out = F.when(ext.isin(*extensions), of(family)).otherwise(out)
        return out

    return let(extension(path), of_extension)


def outline(files: DataFrame, depth: int = 0) -> DataFrame:
    """path, line, col, kind, name of all symbols of files (path, text)."""
    rows = files.select("path", line_array(F.col("text")).alias("lines"))
    found = rows.select("path", F.explode(symbol_array(F.col("lines"), F.col("path"), depth)).alias("s"))
    return found.select("path", "s.line", "s.col", "s.kind", "s.name")


def kind_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

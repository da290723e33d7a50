"""Ignore rules: which paths a tree's ordered patterns leave out.

A rule belongs to a directory and looks at paths below it. Of the rules that fit a path the last decides: rules of deeper directories come after those of
directories above, and within a directory they count in their order; a rule that begins with `!` takes the path in again. What lies in an
ignored directory is ignored, whatever later rules say of it.

Rules meet paths by an equi-join on the directory, each path with the chain of its ancestors, so their number may grow with the corpus. Directories are
decided once, not once a file.

Edge cases: null paths and null rules are left aside; a path without rules stays; repeated rows are decided each; an empty table of rules ignores nothing; empty patterns,
comments and patterns that are no expression fit nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from siftline.functions.text import base_name, line_array, quoted
from siftline.sources.scratch import small, stored

RULE_FILES = (".gitignore", ".ignore")
#: The parts of a pattern, the longest first: what they stand for in an expression over paths.
_PARTS = re.compile(r"(^\*\*/)|(/\*\*/)|(/\*\*$)|(\*+)|(\?)|\[([!^]?)(\]?[^\]]*)\]|\\(.)|(.)", re.DOTALL)


def rule_expression(pattern: str | None) -> tuple[str, bool, bool] | None:
    """(expression over the path below the rule's directory, whether it takes in again, whether it asks for a directory), or None."""
    text = re.sub(r"(?<!\\)[ \t]+$", "", (pattern or "").rstrip("\r"))
    if not text or text[0] == "#":
        return None
    again = text[0] == "!"
    text = text[1:] if again else text
    folder = text.endswith("/")
    text = text.rstrip("/") if folder else text
    if not text:
        return None
    anchored, text = "/" in text, text.removeprefix("/")

    def one(m: re.Match) -> str:
        if m[1]:
            return "(?:.*/)?"
        if m[2]:
            return "/(?:.*/)?"
        if m[3]:
            return "/.+"
        if m[4]:
            return "[^/]*"
        if m[5]:
            return "[^/]"
        if m[7] is not None:
            body = m[7].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("]", "\\]", 1) if m[7] else ""
            return f"(?!/)[{'^' if m[6] else ''}{body}]" if body else quoted(m[0])
        return quoted(m[8] or m[9])

    out = ("^" if anchored else "^(?:.*/)?") + _PARTS.sub(one, text) + r"\z"
    try:
        re.compile(out.replace(r"\z", r"\Z"))
    except re.error:
        return None
    return out, again, folder


@F.udf(StructType().add("expression", StringType()).add("again", BooleanType()).add("folder", BooleanType()))
def _compiled(pattern):  # a call for each line of the rule files, of which there are few beside files
    return rule_expression(pattern)


def parent(path: Column) -> Column:
    """The directory of a path; of what stands at the top the empty one."""
    return F.regexp_replace(F.when(F.contains(path, F.lit("/")), path).otherwise(F.lit("/")), r"/[^/]*\z", "")


def ancestors(path: Column) -> Column:
    """All directories above a path, the top ("") first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def rules_of(files: DataFrame, names: tuple[str, ...] = RULE_FILES) -> DataFrame:
    """dir, n, pattern: the lines of the rule files among files (path, text)."""
    found = files.filter(base_name(F.col("path")).isin(*names) & F.col("text").isNotNull())
    return found.select(parent(F.col("path")).alias("dir"), F.posexplode(line_array(F.col("text"))).alias("n", "pattern"))


def _decided(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """entries (entry, is_dir) that the last fitting rule ignores: entry."""
    chains = entries.select("entry", "is_dir", F.explode(ancestors(F.col("entry"))).alias("dir"))
    met = chains.join(rules, "dir")
    below = F.when(F.col("dir") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(dir) + 2)"))
    fits = F.filter("rules", lambda r: (~r["folder"] | F.col("is_dir")) & F.regexp_like(below, r["expression"]))
    last = met.withColumn("rule", F.try_element_at(fits, F.lit(-1))).filter("rule IS NOT NULL")
    decided = last.groupBy("entry").agg(F.max_by("rule.again", F.length("dir") + (F.col("dir") != "").cast("int")).alias("again"))
    return decided.filter("NOT again").select("entry")


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path of the files that rules (dir, n, pattern) leave out; dir is "" for the top."""
    compiled = rules.filter("dir IS NOT NULL").select("dir", "n", _compiled("pattern").alias("r")).filter("r IS NOT NULL")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "r"))), lambda x: x["r"])
    by_dir = small(stored(compiled.groupBy("dir").agg(in_order.alias("rules"))))
    paths = files.filter("path IS NOT NULL").select("path")
    folders = paths.select(F.explode(ancestors(F.col("path"))).alias("entry")).filter("entry <> ''").distinct().withColumn("is_dir", F.lit(True))
    closed = small(stored(_decided(folders, by_dir)))
    inside = paths.distinct().select("path", F.explode(ancestors(F.col("path"))).alias("entry")).join(closed, "entry", "left_semi").select("path")
    own = _decided(paths.distinct().select(F.col("path").alias("entry"), F.lit(False).alias("is_dir")), by_dir).select(F.col("entry").alias("path"))
    return inside.unionByName(own).distinct()


def without_ignored(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """files (path, ...) less those that rules leave out; rules are those in the files' own rule files if none are given."""
    out = stored(ignored(files, rules_of(files) if rules is None else rules))
    return files.join(small(out), "path", "left_anti")

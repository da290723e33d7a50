"""Structural search: lowered patterns as grep, file conditions as semi-joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.fixed_values import CALL_DEFINITION_BODY, CALL_DEFINITION_SHAPE, CALLED_NAME, CONSTRUCTOR_LINE, DEFINITION_HEAD
from siftline.operators.callers import callers
from siftline.operators.grep import grep, has_match
from siftline.plans.structural_pattern import Structural, lower


def files_with(files: DataFrame, pattern: str) -> DataFrame:
    """path of the files in which a line has a match; no join, and lines stay in their rows."""
    return files.filter(has_match(F.col("text"), pattern)).select("path")


def defines_its_call(text: Column) -> Column:
    """Whether the line defines what a call on it seems to call."""
    called = F.regexp_extract_all(text, F.lit(CALLED_NAME), F.lit(1))
    defined = F.regexp_extract(text, DEFINITION_HEAD + r"([A-Za-z_$][\w$]*)", 1)
    headed = text.rlike(f"{CALL_DEFINITION_SHAPE}{CALL_DEFINITION_BODY}|{CONSTRUCTOR_LINE}")
    return F.array_contains(called, defined) | (headed & (F.size(called) > 0))


def structural(files: DataFrame, pattern: str | Structural, ignore_case: bool = False, **context) -> DataFrame:
    """Matches of a structural pattern: path, line, col, text (and context as grep gives it)."""
    plan = lower(pattern) if isinstance(pattern, str) else pattern
    if plan.symbol:
        out = callers(files, plan.symbol, 1, ignore_case)
    else:
        out = grep(files, plan.pattern, literal=False, ignore_case=ignore_case, **context)
        if plan.kind == "call" and plan.within is None:
            out = out.filter(~defines_its_call(F.col("text")))
    if plan.within is not None:
        out = out.join(files_with(files, plan.within), "path", "left_semi")
    return out


def rewrite_preview(matches: DataFrame, pattern: str | Structural, template: str) -> DataFrame:
    """matches with `rewritten`: the template filled from the first match in the row's text. Nothing is written."""
    plan = lower(pattern) if isinstance(pattern, str) else pattern
    marks = {mark: i for i, name in enumerate(plan.slots, 1) for mark in (["$$$"] if name == "$$$" else [f"$$${name}", f"${name}"])}
    # One pass over the template, so that what a slot was filled with is never filled again; of marks at one place the longest counts.
    any_mark = "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) or r"(?!)"
    pieces = re.split(f"({any_mark})", template)
    made = F.concat(*[F.regexp_extract("text", plan.pattern, marks[x]) if x in marks else F.lit(x) for x in pieces])
    return matches.filter(F.col("text").rlike(plan.pattern)).withColumn("rewritten", made)

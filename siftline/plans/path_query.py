"""Path queries as predicates: one line of words, directory, globs and exclusions becomes Columns over `path`."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import base_name, quoted

MAGIC = re.compile(r"[*?[{]")


@dataclass
class PathQuery:
    words: list[str] = field(default_factory=list)
    directory: str | None = None
    globs: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    modified_only: bool = False

    @property
    def fuzzy(self) -> str:
        return " ".join(self.words)


def bare(path: str) -> str:
    return path.removeprefix("./")


def parse(query: str) -> PathQuery:
    """Each word is the first of these that it can be: git:modified, !excluded, the directory/, a glob, a fuzzy word."""
    out = PathQuery()
    for word in query.split():
        if word.lower() == "git:modified":
            out.modified_only = True
        elif len(word) > 1 and word[0] == "!":
            out.excluded.append(word[1:])
        elif len(word) > 1 and word[-1] == "/" and out.directory is None:
            out.directory = bare(word)[:-1]
        elif MAGIC.search(word):
            out.globs.append(word)
        else:
            out.words.append(word)
    return out


GLOB_PARTS = re.compile(r"(\*\*/?)|(\*)|(\?)|\{([^}]*)\}|(\[[^\]]*\])|(.)", re.DOTALL)


def glob_pattern(glob: str) -> str:
    """Anchored expression of a glob. Alternatives and bracket bodies go in as they are; what is not closed is literal."""

    def one(m: re.Match) -> str:
        if m[1]:
            return ".*"
        if m[2]:
            return "[^/]*"
        if m[3]:
            return "[^/]"
        if m[4] is not None:
            return "(?:" + m[4].replace(",", "|") + ")"
        return m[5] or quoted(m[6])

    return "^" + GLOB_PARTS.sub(one, glob) + r"\z"


def under(path: Column, directory: str) -> Column:
    return (path == directory) | path.startswith(directory + "/")


def by_glob(path: Column, glob: str) -> Column:
    pattern = glob_pattern(glob)
    return path.rlike(pattern) | base_name(path).rlike(pattern)


def selected(path: Column, query: PathQuery) -> Column:
    """Directory, any of the globs, none of the exclusions."""
    keep = F.lit(True)
    if query.directory:
        keep = keep & under(path, query.directory)
    if query.globs:
        keep = keep & reduce(lambda a, b: a | b, [by_glob(path, g) for g in query.globs])
    for x in map(bare, query.excluded):
        if x.endswith("/"):
            drop = under(path, x[:-1])
        elif MAGIC.search(x):
            drop = by_glob(path, x)
        else:
            drop = under(path, x) | F.array_contains(F.split(path, "/"), x)
        keep = keep & ~drop
    return keep


def path_filter(path: Column, pattern: str | None) -> Column:
    """directory/, glob, or a path, the directory of that name, or a base name."""
    if not pattern:
        return F.lit(True)
    flat = bare(pattern.replace("\\", "/"))
    if flat.endswith("/"):
        return under(path, flat[:-1])
    if MAGIC.search(flat):
        return by_glob(path, flat)
    return under(path, flat) | (base_name(path) == flat)


def scope_pin(pattern: str | None) -> str | None:
    """The subtree that a filter names outright, so that it alone is listed; None if it has to be filtered for."""
    flat = bare((pattern or "").replace("\\", "/"))
    if "/" not in flat or MAGIC.search(flat):
        return None
    parts = [x for x in flat.split("/") if x]
    if not parts or ".." in parts or flat.startswith("/") or re.fullmatch(r"[A-Za-z]:", parts[0]):
        raise ValueError(f"path escapes the scan root: {pattern}")
    return "/".join(parts)


def fuzzy_score(path: Column, pattern: str) -> Column:
    """Cost of each word as a subsequence of the lower-case path, summed; null where one is none; bonuses for base names.

    Leftmost matching costs twice what lies between: 2 x (length of the shortest prefix that has the word - its length).
    """
    lower, words = F.lower(path), pattern.lower().split()
    if not words:
        return F.lit(0)
    inside = lambda c: "\\" + c if c in "\\]^[-&" else c
    total, all_found = F.lit(0), F.lit(True)
    for word in words:
        prefix = "^(?s:" + "".join(f"[^{inside(c)}]*{quoted(c)}" for c in word) + ")"
        end = F.length(F.regexp_extract(lower, prefix, 0))
        all_found = all_found & (end > 0)
        total = total + 2 * (end - len(word))
    joined, base = "".join(words), base_name(lower)
    one_dot = F.length(base) - F.length(F.replace(base, F.lit("."), F.lit(""))) == 1
    stem = (F.length(base) >= len(joined) + 2) & (F.substring(base, len(joined) + 1, 1) == ".") & one_dot
    return F.when(all_found, F.when(base == joined, total - 20).when(stem, total - 10).otherwise(total))

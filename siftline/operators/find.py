"""Ranked path search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import directory
from siftline.plans.path_query import fuzzy_score, parse, path_filter, selected


def find(files: DataFrame, query: str, modified: DataFrame | None = None, within: str | None = None) -> DataFrame:
    """path, score, of the files that the query selects; reads no text. modified: one column path, for git:modified.

    Ordering is `ranked`'s; none is imposed here, so a top-k needs no full sort.
    """
    asked = parse(query)
    path = F.col("path")
    out = files.select("path").filter(selected(path, asked) & path_filter(path, within))
    if asked.modified_only:
        if modified is None:
            raise ValueError("git:modified needs the set of modified files")
        out = out.join(modified.select("path"), "path", "left_semi")
    return out.withColumn("score", fuzzy_score(path, asked.fuzzy)).filter("score IS NOT NULL")


def find_relaxed(files: DataFrame, query: str, **options) -> DataFrame:
    """As find; a query of three words and more that finds nothing is asked again with its first two."""
    found = find(files, query, **options)
    words = parse(query).words
    if len(words) >= 3 and found.isEmpty():
        others = [w for w in query.split() if w not in words]
        return find(files, " ".join(words[:2] + others), **options)
    return found


def ranked(found: DataFrame, frecency: DataFrame | None = None) -> DataFrame:
    """Best first: frecency (path, frecency) where given, then score, path length, path."""
    order = [F.asc("score"), F.length("path").asc(), F.asc("path")]
    if frecency is None:
        return found.orderBy(*order)
    known = found.join(frecency.select("path", "frecency"), "path", "left").withColumn("frecency", F.coalesce("frecency", F.lit(0.0)))
    return known.orderBy(F.desc("frecency"), *order)


def directory_counts(found: DataFrame) -> DataFrame:
    return found.groupBy(directory(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))

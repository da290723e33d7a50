"""Overview of a corpus: symbols and import in-degree by file, and the dossier of one symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.fixed_values import CAPSULE_CANDIDATES, CAPSULE_MENTIONS, CODE_EXTENSIONS, DOC_LINE, DOC_LINES, IMPORT_SPECS, IMPORT_WORDS, MENTION_OF_DEFINITION, PAGE_MAX
from siftline.functions.text import bounded, extension, let, line_array, module_key, quoted, trimmed
from siftline.operators.callers import callers, mentions
from siftline.operators.grep import file_counts, grep
from siftline.operators.symbols import symbol_array
from siftline.plans.path_query import path_filter
from siftline.sources.scratch import stored


def import_keys(text: Column) -> Column:
    """Distinct module keys of what a text imports."""
    specs = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in IMPORT_SPECS])
    return F.array_distinct(F.transform(F.filter(specs, lambda s: s != ""), module_key))


def in_degrees(files: DataFrame) -> DataFrame:
    """path, in_degree: how many other files import a module of the file's name.

    Importers are counted by key before they meet the files, so that a name that many files bear and many import is no product.
    """
    return _with_degrees(files)


def _with_degrees(files: DataFrame, *more: Column) -> DataFrame:
    """in_degrees with more columns over path and text, in the same projection."""
    # What a file imports is worked out once, into a narrow table.
    narrow = stored(files.filter("text IS NOT NULL").select("path", module_key(F.col("path")).alias("key"), import_keys(F.col("text")).alias("keys"), *more))
    importers = narrow.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("importers"))
    rows = narrow.withColumn("own", F.array_contains("keys", F.col("key")).cast("long")).drop("keys").join(importers, "key", "left")
    return rows.withColumn("in_degree", F.coalesce("importers", F.lit(0)) - F.col("own")).drop("key", "own", "importers")


def repo_map(files: DataFrame, frecency: DataFrame | None = None, modified: DataFrame | None = None) -> DataFrame:
    """path, symbols (top level), in_degree, modified, weight: frecency + 1 if modified + ln(1 + in_degree)."""
    rows = _with_degrees(files, let(line_array(F.col("text")), lambda lines: symbol_array(lines, F.col("path"), 0)).alias("symbols"))
    changed, fre = F.lit(False), F.lit(0.0)
    if modified is not None:
        rows = rows.join(modified.select("path", F.lit(True).alias("changed")).distinct(), "path", "left")
        changed = F.coalesce("changed", F.lit(False))
    if frecency is not None:
        rows = rows.join(frecency.select("path", "frecency"), "path", "left")
        fre = F.coalesce("frecency", F.lit(0.0))
    return rows.select("path", "symbols", "in_degree", changed.alias("modified"), (fre + changed.cast("double") + F.log1p(F.col("in_degree"))).alias("weight"))


def definition(files: DataFrame, symbol: str, ignore_case: bool = False, within: str | None = None) -> DataFrame:
    """At most one row path, line, kind, doc: the definition among the files that mention the symbol most, sources first."""
    name = bounded(quoted(symbol))
    scoped = files.filter(path_filter(F.col("path"), within))
    mentions = file_counts(grep(scoped, name, literal=False, ignore_case=ignore_case)).orderBy(F.desc("n"), "path").limit(CAPSULE_MENTIONS)
    shaped = grep(scoped, MENTION_OF_DEFINITION + name, literal=False, ignore_case=ignore_case).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    more = shaped.join(mentions, "path", "left_anti").orderBy("path").limit(CAPSULE_CANDIDATES - CAPSULE_MENTIONS)
    asked = mentions.select("path", F.lit(0).alias("tier"), F.col("n")).unionByName(more.select("path", F.lit(1).alias("tier"), F.lit(0).cast("long").alias("n")))
    source = extension(F.col("path")).isin(*CODE_EXTENSIONS) & ~F.col("path").rlike(r"(?:^|/)(?:dist|docs?)/")
    same = (lambda s: F.lower(s["name"]) == symbol.lower()) if ignore_case else (lambda s: s["name"] == symbol)
    rows = scoped.join(F.broadcast(asked), "path").select("path", "tier", "n", line_array(F.col("text")).alias("lines"))  # at most 60 files
    rows = rows.withColumn("found", F.get(F.filter(symbol_array(F.col("lines"), F.col("path"), 1), same), F.lit(0))).filter("found IS NOT NULL")
    best = rows.orderBy(F.when(source, 0).otherwise(1), "tier", F.desc("n"), "path").limit(1)
    at = F.col("found.line")
    above = F.reverse(F.slice("lines", F.greatest(at - DOC_LINES, F.lit(1)), at - F.greatest(at - DOC_LINES, F.lit(1))))
    # Comment lines next to the definition; the first that is none ends them.
    doc = F.aggregate(
        above, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("doc")),
        lambda acc, x: F.when(acc["on"] & trimmed(x).rlike(DOC_LINE), F.struct(F.lit(True).alias("on"), F.concat(F.array(F.regexp_replace(x, r"\s+\z", "")), acc["doc"]).alias("doc"))).otherwise(F.struct(F.lit(False).alias("on"), acc["doc"].alias("doc"))),
        lambda acc: acc["doc"],
    )
    return best.select("path", at.alias("line"), F.col("found.kind").alias("kind"), doc.alias("doc"))


def capsule(files: DataFrame, symbol: str, ignore_case: bool = False, within: str | None = None, limit: int = 10) -> DataFrame:
    """One relation of a symbol's dossier: part (definition, caller, import), path, line, col, text; `limit` rows of a part."""
    if not symbol:
        raise ValueError("a symbol is needed")
    limit = max(1, min(PAGE_MAX, limit))
    inside = path_filter(F.col("path"), within)
    # Every part comes from files that contain the symbol: they are picked once, and the rest is work on those.
    files = stored(files.filter(mentions(symbol, ignore_case)).select("path", "text"))
    found = definition(files, symbol, ignore_case, within)
    parts = [found.select(F.lit("definition").alias("part"), "path", "line", F.lit(1).alias("col"), F.concat_ws("\n", F.array("kind"), "doc").alias("text"))]
    used = callers(files, symbol, 1, ignore_case).orderBy("path", "line").limit(limit).filter(inside)
    parts.append(used.select(F.lit("caller").alias("part"), "path", "line", "col", "text"))
    importing = IMPORT_WORDS + r"[^\n]*" + bounded(quoted(symbol))
    imports = grep(files, importing, literal=False, ignore_case=ignore_case).orderBy("path", "line", "col").limit(limit).filter(inside)
    parts.append(imports.select(F.lit("import").alias("part"), "path", "line", "col", "text"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def capsule_totals(files: DataFrame, symbol: str, ignore_case: bool = False, within: str | None = None) -> DataFrame:
    """part (caller, import, all), n, files: how many rows the parts of a dossier have before its limit, and in how many files; `all` counts the definition's file too."""
    inside = path_filter(F.col("path"), within)
    files = stored(files.filter(mentions(symbol, ignore_case)).select("path", "text"))
    part = lambda name, rows: rows.select(F.lit(name).alias("part"), "path")
    importing = IMPORT_WORDS + r"[^\n]*" + bounded(quoted(symbol))
    rows = part("caller", callers(files, symbol, 1, ignore_case)).unionByName(part("import", grep(files, importing, literal=False, ignore_case=ignore_case))).filter(inside)
    rows = stored(rows.unionByName(part("definition", definition(files, symbol, ignore_case, within))))
    count = (F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("files"))
    return rows.filter("part <> 'definition'").groupBy("part").agg(*count).unionByName(rows.agg(F.lit("all").alias("part"), *count))


__all__ = ["capsule", "capsule_totals", "definition", "import_keys", "in_degrees", "repo_map"]

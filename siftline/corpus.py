"""The library's front: a corpus of files and what can be asked of it. Every method gives a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.fixed_values import MAP_CHARS, MAX_CHARS
from siftline.operators import callers, find, frecency, grep, ignored, lexical, path_tree, repo_map, semantic, structural, symbols, tags
from siftline.operators.budget import fitting
from siftline.plans import pages
from siftline.plans.path_query import parse, path_filter, scope_pin
from siftline.sources import tables, tree
from siftline.sources.scratch import stored


@dataclass
class Shown:
    """A page as text, how many rows there are in all, and the token of the next page."""

    text: str
    total: int
    next: str | None


class Corpus:
    """files: path, text. modified: path. opens: path, ts."""

    def __init__(self, files: DataFrame, modified: DataFrame | None = None, opens: DataFrame | None = None):
        self.files, self.modified, self.opens = files, modified, opens

    @staticmethod
    def of_tree(spark: SparkSession, root: str, within: str | None = None, follow: bool = False) -> Corpus:
        """A live tree; a `within` that names a subtree is listed alone."""
        return Corpus(tree.contents(tree.listing(spark, root, scope_pin(within), follow), root), tree.modified(spark, root))

    @staticmethod
    def of_documents(spark: SparkSession, sf_dir: str) -> Corpus:
        return Corpus(tables.documents_corpus(spark, sf_dir), opens=tables.opens_log(spark, sf_dir))

    @staticmethod
    def of_code(spark: SparkSession, sf_dir: str) -> Corpus:
        return Corpus(tables.code_corpus(spark, sf_dir))

    def without_ignored(self, rules: DataFrame | None = None) -> Corpus:
        """The corpus less what its rule files (or the given rules) leave out."""
        return Corpus(ignored.without_ignored(self.files, rules), self.modified, self.opens)

    def within(self, pattern: str | None) -> DataFrame:
        return self.files.filter(path_filter(F.col("path"), pattern))

    def frecency(self) -> DataFrame | None:
        if self.opens is None:
            return None
        return frecency.scores(frecency.summed(self.opens), F.current_timestamp())

    def find(self, query: str, within: str | None = None) -> DataFrame:
        return find.ranked(find.find_relaxed(self.files, query, modified=self.modified, within=within), self.frecency())

    def grep(self, pattern: str, within: str | None = None, **options) -> DataFrame:
        return grep.in_order(grep.grep(self.within(within), pattern, **options))

    def grep_page(self, pattern: str, within: str | None = None, limit: int | None = None, token: str | None = None, max_chars: int | None = None, concise: bool = False, tagged: bool = True, **options) -> Shown:
        """A page of matches by file, each file under its tag; counts by file where the page is longer than max_chars."""
        files = self.within(within)
        rows = grep.grep(files, pattern, **options)
        found = pages.page(rows, pages.MATCHES, f"grep {pattern!r} {within!r} {sorted(options.items())!r}", limit, token, self.files)
        if not found.rows:
            return Shown(pages.nothing_found(pattern, options.get("literal", True)), found.total, None)
        paths = list({r.path for r in found.rows})
        marks = {r.path: r.tag for r in files.filter(F.col("path").isin(*paths)).select("path", tags.content_tag("text").alias("tag")).collect()} if tagged and not concise else {}
        text = pages.grep_text(found.rows, marks, concise)
        if max_chars is not None and len(text) > min(max_chars, MAX_CHARS):
            counts = {r.path: r.n for r in grep.summary(grep.file_counts(rows), "path", pages.SUMMARY_TOP).collect()}
            text = pages.within_budget(text, max_chars, counts)
        return Shown(text, found.total, found.next)

    def find_page(self, query: str, within: str | None = None, limit: int | None = None, token: str | None = None, max_chars: int | None = None) -> Shown:
        """A page of paths, best first; counts by directory where it is longer than max_chars."""
        rows = find.find_relaxed(self.files, query, modified=self.modified, within=within)
        known = None
        if self.opens is not None:
            # As of the last open: the same order at any later time, and the same values on every page.
            store = frecency.summed(self.opens)
            known = frecency.scores(store, F.lit(store.agg(F.max("last")).first()[0]).cast("timestamp"))
        rows = find.ranked(rows, known).withColumn("length", F.length("path"))
        keys = ((("frecency", True),) if known is not None else ()) + (("score", False), ("length", False), ("path", False))
        found = pages.page(rows, keys, f"find {query!r} {within!r}", limit, token, self.files)
        if not found.rows:
            words = parse(query).words
            return Shown(pages.nothing_found_by_path(query, self.files.count(), " ".join(words[:2]) if len(words) >= 3 else None), 0, None)
        text = "\n".join(r.path for r in found.rows)
        if max_chars is not None and len(text) > min(max_chars, MAX_CHARS):
            counts = {r.dir: r.n for r in grep.summary(find.directory_counts(rows), "dir", pages.SUMMARY_TOP).collect()}
            text = pages.within_budget(text, max_chars, counts)
        return Shown(text, found.total, found.next)

    def _page(self, rows: DataFrame, keys: tuple[pages.Key, ...], query: str, show, by: str, limit: int | None, token: str | None, max_chars: int | None) -> Shown:
        """A page of rows as text; where it is longer than max_chars, the counts of what `by` names."""
        found = pages.page(rows, keys, query, limit, token, self.files)
        if not found.rows:
            return Shown("0 matches", found.total, None)
        text = "\n".join(map(show, found.rows))
        if max_chars is not None and len(text) > min(max_chars, MAX_CHARS):
            counts = {r[by]: r.n for r in grep.summary(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by, pages.SUMMARY_TOP).collect()}
            text = pages.within_budget(text, max_chars, counts)
        return Shown(text, found.total, found.next)

    def outline_page(self, within: str | None = None, depth: int = 0, limit: int | None = None, token: str | None = None, max_chars: int | None = None, concise: bool = False) -> Shown:
        """A page of symbols; counts by kind where it is too long."""
        return self._page(symbols.outline(self.within(within), depth), pages.MATCHES, f"outline {within!r} {depth}", lambda r: pages.symbol_text(r, concise), "kind", limit, token, max_chars)

    def callers_page(self, symbol: str, depth: int = 1, within: str | None = None, limit: int | None = None, token: str | None = None, max_chars: int | None = None, **options) -> Shown:
        """A page of callers, ring by ring; counts by file where it is too long."""
        rows = self.callers(symbol, depth, within=within, **options)
        return self._page(rows, (("depth", False), *pages.MATCHES), f"callers {symbol!r} {depth} {within!r} {sorted(options.items())!r}", pages.caller_text, "path", limit, token, max_chars)

    def structural_page(self, pattern: str, within: str | None = None, limit: int | None = None, token: str | None = None, max_chars: int | None = None, concise: bool = False, **options) -> Shown:
        """A page of structural matches; counts by file where it is too long."""
        rows = structural.structural(self.within(within), pattern, **options)
        return self._page(rows, pages.MATCHES, f"structural {pattern!r} {within!r} {sorted(options.items())!r}", lambda r: pages.match_text(r, concise), "path", limit, token, max_chars)

    def tree(self, within: str | None = None) -> DataFrame:
        return path_tree.path_tree(self.within(within)).orderBy("key")

    def outline(self, within: str | None = None, depth: int = 0) -> DataFrame:
        return symbols.outline(self.within(within), depth).orderBy("path", "line", "col")

    def callers(self, symbol: str, depth: int = 1, ignore_case: bool = False, exact_only: bool = False, within: str | None = None) -> DataFrame:
        found = callers.callers(self.files, symbol, depth, ignore_case).filter(path_filter(F.col("path"), within))
        found = found.withColumn("certainty", callers.certainty(F.col("text"), F.col("via"), ignore_case))
        return (found.filter("certainty = 'exact'") if exact_only else found).orderBy("depth", "path", "line")

    def structural(self, pattern: str, rewrite: str | None = None, within: str | None = None, **options) -> DataFrame:
        found = structural.structural(self.within(within), pattern, **options)
        return (structural.rewrite_preview(found, pattern, rewrite) if rewrite is not None else found).orderBy("path", "line", "col")

    def map(self, within: str | None = None, max_chars: int | None = None) -> DataFrame:
        """Files by weight; with max_chars the heaviest that have symbols, as many as fit when shown."""
        rows = repo_map.repo_map(self.within(within), self.frecency(), self.modified)
        order = [F.desc("weight"), F.asc("path")]
        if max_chars is None:
            return rows.orderBy(*order)
        names = F.transform("symbols", lambda s: F.length(s["kind"]) + F.length(s["name"]) + 4)
        size = F.length("path") + 1 + F.aggregate(names, F.lit(0), lambda a, x: a + x)
        return fitting(rows.filter(F.size("symbols") > 0), size, order, min(max_chars, MAX_CHARS)).orderBy(*order)

    def map_text(self, within: str | None = None, max_chars: int = MAP_CHARS) -> str:
        """The map as text: each file's path and, below it, its symbols."""
        blocks = [[f"{r.path}:", *(f"  {x.kind} {x.name}" for x in r.symbols)] for r in self.map(within, max_chars).collect()]  # max_chars at most
        return "\n".join(line for block in blocks for line in block)

    def capsule(self, symbol: str, within: str | None = None, ignore_case: bool = False, limit: int = 10) -> DataFrame:
        return repo_map.capsule(self.files, symbol, ignore_case, within, limit)

    def capsule_totals(self, symbol: str, within: str | None = None, ignore_case: bool = False) -> DataFrame:
        return repo_map.capsule_totals(self.files, symbol, ignore_case, within)

    def search(self, question: str, within: str | None = None, extra: tuple[str, ...] = (), judge: semantic.Judge = semantic.lexical_judge) -> DataFrame:
        return semantic.search(self.within(within), question, judge, extra, self.frecency())

    def ask(self, question: str, judge: semantic.KeyedJudge, within: str | None = None, extra: tuple[str, ...] = ()) -> semantic.Outcome:
        """As search, with a judge of keyed entries, and with what became of its requests."""
        return semantic.cascade(self.within(within), question, judge, extra, self.frecency())

    def tags(self, within: str | None = None) -> DataFrame:
        rows = self.within(within).select("path", tags.content_tag("text").alias("tag"))
        return rows.withColumn("header", tags.header(F.col("path"), F.col("tag")))

    def rank(self, question: str, extra: tuple[str, ...] = ()) -> DataFrame:
        words = lexical.keywords(question, extra)
        counts = stored(lexical.keyword_counts(self.files, words))
        return lexical.lexical_scores(counts, words, lexical.idf(counts, words)).orderBy(F.desc("lex"), "path")

import pytest

from siftline.plans import pages
from siftline.sources import open_store


def test_pages(spark):
    rows = spark.range(75).withColumnRenamed("id", "n")
    first = pages.page(rows, [("n", False)], "q")
    assert len(first.rows) == 30 and first.total == 75
    second = pages.page(rows, [("n", False)], "q", 50, first.next)
    assert [r.n for r in second.rows] == list(range(30, 75)) and second.next is None
    with pytest.raises(ValueError):
        pages.page(rows, [("n", False)], "other", 50, first.next)
    with pytest.raises(ValueError):
        pages.Cursor.of("x", "q", "")
    assert [pages.page_size(x) for x in (None, 0, -1, float("nan"), 7, 99)] == [30, 30, 30, 30, 7, 50]
    assert pages.within_budget("abcdef", 3, {"x": 1, "y": 2}) == "y: 2, x: 1" and pages.within_budget("abc", 3, {}) == "abc"
    assert pages.human_size(10) == "10 B" and pages.human_size(2048) == "2.0 KB"


def test_page_of_matches(corpus):
    from siftline.operators import grep, tags

    files = corpus({"a.py": "def f():\n    hit\n    hit\ndef g():\n    hit\n", "b.txt": "hit\n"})
    rows = grep.in_order(grep.grep(files, "hit", enclosing=True)).collect()
    kept = {r.path: r.tag for r in files.select("path", tags.content_tag("text").alias("tag")).collect() if r.path == "a.py"}
    assert pages.grep_text(rows, kept).split("\n") == [f"[a.py#{kept['a.py']}]", "in def f", "a.py:2:5: hit", "a.py:3:5: hit", "in def g", "a.py:5:5: hit", "b.txt:1:1: hit"]
    assert pages.grep_text(rows, {}, concise=True).split("\n") == ["a.py:2", "a.py:3", "a.py:5", "b.txt:1"]
    hinted = {p: pages.nothing_found(p).count(";") for p in ("foo(bar)", "a || b", r"foo\.bar", "a|b", "where is it", r"what .* is")}
    assert hinted == {"foo(bar)": 0, "a || b": 1, r"foo\.bar": 1, "a|b": 1, "where is it": 1, r"what .* is": 2}
    assert pages.nothing_found("a.*b", literal=False) == '0 matches for "a.*b" (expression)'


def test_store(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"path":"a","opened":2,"last":"2024-01-01T00:00:00Z"}\n{"path":"b","opened":-1,"last":"2024-01-01T00:00:00Z"}\nnot json\n')
    kept = open_store.read(spark, str(tmp_path / "s"))
    assert [(r.path, r.opened) for r in kept.collect()] == [("a", 2)]
    more = spark.createDataFrame([("a", 1)], "path string, opened long").selectExpr("path", "opened", "timestamp'2024-02-01' AS last")
    open_store.save(more, kept, str(tmp_path / "t"))
    row = open_store.read(spark, str(tmp_path / "t")).first()
    assert (row.path, row.opened, row["last"].month) == ("a", 2, 2)


def test_rewritten_text_is_not_filled_again(corpus):
    from siftline.operators.structural import rewrite_preview, structural

    got = rewrite_preview(structural(corpus({"a.ts": "swap('$B', x)"}), "swap($A, $B)"), "swap($A, $B)", "swap($B, $A)").first()
    assert got.rewritten == "swap(x, '$B')"


def test_heat_of_equal_ranges(spark):
    from siftline.operators.lexical import merged_heat

    rows = [("a", 2, 2, 1.0, "x"), ("a", 4, 6, 0.9, "z"), ("a", 4, 6, 0.5, "y"), ("b", 1, 3, 0.4, "u"), ("b", 4, 4, 0.6, "v")]
    got = merged_heat(spark.createDataFrame(rows, "path string, start int, stop int, p double, snippet string"), 0.2).collect()
    assert sorted(map(tuple, got)) == [("a", 2, 2, 1.0, "x"), ("a", 4, 6, 0.9, "y"), ("b", 1, 4, 0.6, "u")]


def test_registry(spark):
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert entry.entry(spark).columns == ["path", "line", "col", "text"]


def test_calls_alone_in_pages(spark, tmp_path):
    """A page whose prose has an import word before the symbol's name is a site of the operator, but no row of the query, as its SQL has it."""
    import duckdb

    from siftline.operators.callers import callers
    from siftline.plans.corpus_sql import ORACLE_SQL
    from siftline.queries import QUERIES

    pages = [(1, "x;track(1);\n<p>St from erth</p> m.ads-track.example.com\n a.track\n"), (2, "from the track (a)\n")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["callers_pages"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(db.execute(ORACLE_SQL["callers_pages"]).fetchall())
    files = spark.createDataFrame([(str(n), text) for n, text in pages], "path string, text string")
    assert sorted((r.path, r.line) for r in callers(files, "track").collect()) == [("1", 1), ("1", 2), ("1", 3), ("2", 1)]


def test_merging_tasks_stay_small(spark, monkeypatch):
    """A task gets so many ranges, however small Spark finds them, and merges the same."""
    from siftline.operators import lexical

    rows = spark.range(4000).selectExpr("id % 400 AS path", "cast(id / 400 * 3 AS int) AS start", "cast(id / 400 * 3 AS int) + cast(id % 4 AS int) AS stop", "0.5 AS p", "'' AS snippet")
    whole = sorted(map(tuple, lexical.merged_heat(rows, 0.2).collect()))
    monkeypatch.setattr(lexical, "TASK_RANGES", 100)
    parts = lexical.merged_heat(rows, 0.2)
    assert parts.rdd.getNumPartitions() == 40 and sorted(map(tuple, parts.collect())) == whole

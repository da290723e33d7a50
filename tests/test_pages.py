import random

import pytest
from pyspark.sql import functions as F

from siftline.corpus import Corpus
from siftline.operators.budget import fitting
from siftline.operators.repo_map import capsule_totals
from siftline.plans import pages


def all_pages(rows, keys, limit, **more):
    got, token, n = [], None, 0
    while True:
        page = pages.page(rows, keys, "q", limit, token, **more)
        got += page.rows
        n += 1
        token = page.next
        if token is None:
            return got, n, page.total


def test_keyset_pages_with_nulls_and_directions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "b", "é"]), rnd.choice([None, 0.1, 0.30000000000000004, 2.5]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "s string, x double, n int").repartition(3)
    for keys in ([("s", False), ("x", True), ("n", False)], [("x", False), ("s", True), ("n", True)]):
        order = [F.desc_nulls_last(c) if d else F.asc_nulls_first(c) for c, d in keys]
        got, n, total = all_pages(df, keys, 7)
        assert got == df.orderBy(*order).collect() and n == 9 and total == 60
    assert all_pages(df.filter("false"), [("n", False)], 7) == ([], 1, 0)


def test_later_pages_do_not_count(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.range(100).withColumnRenamed("id", "n")
    first = pages.page(df, [("n", False)], "q", 10)
    monkeypatch.setattr(DataFrame, "count", lambda self: pytest.fail("counted"))
    assert [r.n for r in pages.page(df, [("n", False)], "q", 10, first.next).rows] == list(range(10, 20))


def test_changed_files_end_a_cursor(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40).write.parquet(path)
    first = pages.page(spark.read.parquet(path), [("id", False)], "q", 10)
    assert pages.page(spark.read.parquet(path), [("id", False)], "q", 10, first.next).rows[0].id == 10
    spark.range(40, 41).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="changed"):
        pages.page(spark.read.parquet(path), [("id", False)], "q", 10, first.next)


@pytest.mark.parametrize("budget", [0, 4, 5, 11, 300, 10**6])
def test_fitting(spark, budget):
    rnd = random.Random(2)
    rows = [(i, rnd.randrange(0, 9) or None) for i in range(500)]
    want, used = [], -1
    for i, n in rows:
        used += (n or 0) + 1
        if used > budget:
            break
        want.append((i, n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fitting(spark.createDataFrame(rows, "i int, n int").repartition(6), F.col("n"), [F.asc("i")], budget)
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


FILES = {f"src/m{i}.py": f"import core\ndef f{i}():\n    core()\n" for i in range(8)} | {"core.py": "def core():\n    pass\n", "data.txt": None}


def test_corpus_pages(spark, corpus):
    opens = spark.createDataFrame([("src/m3.py",)] * 3 + [("core.py",)], "path string").withColumn("ts", F.current_timestamp())
    c = Corpus(corpus(FILES), opens=opens)
    first = c.grep_page("core", limit=5)
    assert first.total == 17 and first.text.startswith("[core.py#") and first.text.count("src/m0.py:") == 2
    rest, token = [], first.next
    while token:
        page = c.grep_page("core", limit=5, token=token, concise=True)
        rest += page.text.split("\n")
        token = page.next
    assert len(rest) == 12 and rest[-1] == "src/m7.py:3"
    assert c.grep_page("core", max_chars=20).text.startswith("src/m0.py: 2, src/m1.py: 2")
    assert "try literal=False" in c.grep_page("co.*re").text
    paths, token = [], None
    while True:
        page = c.find_page("m", limit=3, token=token)
        paths += page.text.split("\n")
        token = page.next
        if not token:
            break
    assert paths[0] == "src/m3.py" and sorted(paths) == sorted(set(paths)) and len(paths) == 8
    assert c.find_page("zzz yyy xxx").text == "0 matches for 'zzz yyy xxx' (10 files scanned; relaxed to 'zzz yyy')"
    assert c.find_page("m", max_chars=10).text == "src: 8"


def test_map_within_budget(corpus):
    c = Corpus(corpus(FILES))
    whole = c.map_text(max_chars=10_000)
    assert whole.startswith("core.py:\n  def core\nsrc/m0.py:\n  def f0\n") and whole.count("\n") == 17
    for n in (1, 18, 19, 20, 60, len(whole) - 1, len(whole)):
        text = c.map_text(max_chars=n)
        assert len(text) <= n and whole.startswith(text)
    assert c.map_text(max_chars=len(whole)) == whole and c.map_text(max_chars=7) == ""


def test_capsule_totals(corpus):
    got = {r.part: (r.n, r.files) for r in capsule_totals(corpus(FILES), "core").collect()}
    assert got == {"caller": (16, 8), "import": (8, 8), "all": (25, 9)}


def test_pages_of_other_kinds(corpus):
    c = Corpus(corpus(FILES))
    first = c.outline_page(limit=4)
    assert first.text.split("\n")[:2] == ["core.py:1: def core", "src/m0.py:2: def f0"] and first.total == 9
    assert len(c.outline_page(limit=50, token=first.next, concise=True).text.split("\n")) == 5
    assert c.outline_page(max_chars=5).text == "def: 9"
    near = c.callers_page("core", 2, limit=3)
    assert near.text.startswith("src/m0.py:1:1: import core\nsrc/m0.py:3:5: core()") and near.total == 16
    assert c.callers_page("core", 2, limit=50, token=near.next).text.count("\n") == 12
    assert c.structural_page("kind:call", limit=2).text == "src/m0.py:3:5: core()\nsrc/m1.py:3:5: core()"
    assert c.structural_page("kind:class").text == "0 matches"
    context = c.grep_page("core()", limit=1, tagged=False, before=1)
    assert context.text == "core.py:1:5: def core():"
    assert c.grep_page("core()", within="src/", limit=1, tagged=False, before=2, after=1).text == "src/m0.py:3:5: core()\n  src/m0.py:1: import core\n  src/m0.py:2: def f0():"


def test_params():
    from siftline.plans import params

    assert [params.text({"a": x}, "a") for x in ("x", "", 3, None)] == ["x", None, None, None] and params.text({}, "a") is None
    assert params.strict_text({"a": "x"}, "a") == "x" and params.strict_text({"a": ""}, "a") is None
    assert [params.context({"a": x}, "a") for x in (2, -1, 99, None, "3", float("nan"), 4.0)] == [2, 0, 5, 0, 0, 0, 4]
    assert [params.chars({"a": x}, "a") for x in (7, None, "x", 10**9)] == [7, None, None, 1_000_000]
    assert params.root({"cwd": "/tmp"}) == "/tmp" and params.root({}) is None
    assert params.enclosing({"expand": "function"}) and not params.enclosing({"expand": "none"}) and not params.enclosing({})
    assert params.extra_keywords({"grep_keywords": ["a", "b"]}) == ("a", "b") and params.extra_keywords({}) == ()
    for act, given in ((params.strict_text, 3), (params.context, 1.5), (params.chars, 0), (params.chars, 1.5)):
        with pytest.raises(ValueError, match="^a"):
            act({"a": given}, "a")
    with pytest.raises(ValueError, match="absolute"):
        params.root({"cwd": "src"})
    with pytest.raises(ValueError, match="array of strings"):
        params.extra_keywords({"grep_keywords": "a"})

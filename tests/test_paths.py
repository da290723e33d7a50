import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.operators import find, frecency
from siftline.plans.path_query import fuzzy_score, glob_pattern, parse, scope_pin, selected

SCORES = [
    ("main.ts", "main.ts", -20), ("main", "main.ts", -10), ("mai", "main.ts", 0), ("maint", "main.ts", 2), ("mt", "main.ts", 8), ("zzz", "main.ts", None),
    ("main.ts", "src/main.ts", -12), ("main", "src/main.ts", -2), ("mn", "src/main.ts", 12), ("user.test", "user.test.ts", 0), ("a", "a.b", -10), ("main", "main.", 0),
]


@pytest.mark.parametrize("pattern,path,score", SCORES)
def test_fuzzy_scores(spark, pattern, path, score):
    row = spark.createDataFrame([(path,)], "path string").select(fuzzy_score(F.col("path"), pattern)).first()
    assert row[0] == score


def test_parse():
    q = parse("src/ *.ts !*.test.ts foo lib/ !")
    assert (q.directory, q.globs, q.excluded, q.words) == ("src", ["*.ts"], ["*.test.ts"], ["foo", "lib/", "!"])
    assert parse("  ").fuzzy == "" and parse("GIT:modified").modified_only


@pytest.mark.parametrize("glob,yes,no", [("**/a.ts", ["a.ts", "x/y/a.ts"], ["b.ts"]), ("?.ts", ["b.ts"], ["ab.ts", "a/b.ts"]), ("{a,b}.c", ["a.c", "b.c"], ["c.c"]), ("x{y", ["x{y"], ["xy"]), ("a+b", ["a+b"], ["aab"])])
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "path string").filter(F.col("path").rlike(glob_pattern(glob)))
    assert sorted(r[0] for r in rows.collect()) == sorted(yes)


def test_selection(spark):
    rows = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/a.test.ts", "src/x/b.ts", "lib/a.ts", "srcx/a.ts")], "path string")
    keep = lambda q: sorted(r[0] for r in rows.filter(selected(F.col("path"), parse(q))).collect())
    assert keep("src/ *.ts !*.test.ts") == ["src/a.ts", "src/x/b.ts"]
    assert keep("src/ !x") == ["src/a.test.ts", "src/a.ts"]
    assert keep("!src/") == ["lib/a.ts", "srcx/a.ts"]


def test_rank_and_relax(corpus):
    files = corpus({"alpha/readme.md": "", "myalpha.md": "", "alpha.md": ""})
    assert [r.path for r in find.ranked(find.find(files, "alpha")).collect()] == ["alpha.md", "alpha/readme.md", "myalpha.md"]
    assert find.find_relaxed(files, "alpha md zzz").count() == 3
    assert find.find(corpus({"src/map/fake_players.cpp": "", "src/map/fake.cpp": "", "src/user.cpp": ""}), "fakeplayer fake").count() == 1


def test_modified(spark, corpus):
    files = corpus({"a": "", "b": ""})
    assert [r.path for r in find.find(files, "git:modified", spark.createDataFrame([("b",)], "path string")).collect()] == ["b"]
    with pytest.raises(ValueError):
        find.find(files, "git:modified")


def test_scope_pin():
    assert scope_pin("./src/x") == "src/x" and scope_pin("*.py") is None and scope_pin("a.py") is None
    for bad in ("../x", "/x", "C:/x"):
        with pytest.raises(ValueError):
            scope_pin(bad)


def test_frecency(spark):
    from datetime import datetime, timedelta

    now = datetime(2024, 1, 15)
    log = spark.createDataFrame([("a", now - timedelta(days=7)), ("a", now - timedelta(days=14)), ("b", now), (None, now)], "path string, ts timestamp")
    store = frecency.summed(log)
    assert {r.path: round(r.frecency, 9) for r in frecency.scores(store, F.lit(now)).collect()} == {"a": 1.0, "b": 1.0}
    assert [r.path for r in frecency.cleared(store, now - timedelta(days=1), now).collect()] == ["b"]
    assert frecency.cleared(store, now + timedelta(days=1), now).count() == 2
    keys = spark.createDataFrame([("src\\a.ts:10:20",), ("file:///x/y?z#q",), ("https://h/p",)], "p string").select(frecency.path_key(F.col("p"))).collect()
    assert [r[0] for r in keys] == ["src/a.ts", "/x/y", None]


def greedy(pattern, path):
    total, path = 0, path.lower()
    for word in pattern.split():
        last = -1
        for c in word:
            at = path.find(c, last + 1)
            if at < 0:
                return None
            total += 2 * (at - last - 1)
            last = at
    return total


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("ab.-]^x", min_size=1, max_size=4), st.text("ab.-]^x/", min_size=1, max_size=12)), min_size=5, max_size=12))
def test_fuzzy_is_the_greedy_walk(spark, pairs):
    word = pairs[0][0]
    rows = spark.createDataFrame([(p + "/zz.zz.zz",) for _, p in pairs], "path string").select("path", fuzzy_score(F.col("path"), word).alias("s")).collect()
    assert [r.s for r in rows] == [greedy(word, r.path) for r in rows]

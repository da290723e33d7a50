import shutil
import subprocess

import pytest

from siftline.operators import ignored

CASES = {
    ".gitignore": "# a comment\n\n*.log\n!keep.log\n/build\nout/\nsrc/*.tmp\n**/deep/x.txt\na/**/z.txt\nlogs/**\n\\#odd\n\\!odd\n?.md\n[ab]c.txt\n[!x]y.txt\nspace \nescaped\\ \n",
    "sub/.gitignore": "!*.log\n*.dat\n/only.txt\nnested/\n",
    "sub/more/.gitignore": "!x.dat\n*\n!y.txt\n",
    "out/.gitignore": "!in.txt\n",
}
PATHS = """a.log keep.log x/keep.log x/b.log build/x.txt x/build/y.txt out/in.txt x/out/in.txt out.txt src/a.tmp x/src/a.tmp src/s/a.tmp deep/x.txt
q/deep/x.txt a/z.txt a/b/c/z.txt b/a/z.txt logs/1.txt logs/2/3.txt #odd !odd 1.md 12.md ac.txt cc.txt bc.txt xy.txt zy.txt space sub/a.log sub/s/b.log sub/a.dat
sub/only.txt sub/s/only.txt sub/nested/q.txt sub/nested sub/more/x.dat sub/more/y.txt sub/more/z.txt sub/more/s/y.txt build""".split() + ["escaped "]


def tree():
    files = {p: "x" for p in PATHS if p not in ("build", "sub/nested")}
    return files | CASES


def test_as_git_does(spark, corpus, tmp_path):
    if not shutil.which("git"):
        pytest.skip("no git")
    for path, text in tree().items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    asked = "\0".join(tree())
    done = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "-z", "--no-index", "--stdin"], input=asked, capture_output=True, text=True, check=False)
    want = {p for p in done.stdout.split("\0") if p}
    files = corpus(tree())
    assert {r.path for r in ignored.ignored(files, ignored.rules_of(files)).collect()} == want
    assert {r.path for r in ignored.without_ignored(files).collect()} == set(tree()) - want
    assert len(want) > 15


def test_order_and_depth(spark, corpus):
    files = corpus({"d/a.txt": "", "d/b.txt": "", "e/a.txt": ""})
    rules = lambda rows: spark.createDataFrame(rows, "dir string, n int, pattern string")
    found = lambda rows: sorted(r.path for r in ignored.ignored(files, rules(rows)).collect())
    assert found([("", 1, "!a.txt"), ("", 0, "*.txt")]) == ["d/b.txt"]
    assert found([("d", 0, "!a.txt"), ("", 0, "*.txt")]) == ["d/b.txt", "e/a.txt"]
    assert found([("", 0, "d/"), ("d", 0, "!a.txt")]) == ["d/a.txt", "d/b.txt"]
    assert found([("d", 0, "/a.txt"), (None, 1, "*"), ("", 2, None), ("", 3, "[")]) == ["d/a.txt"]
    assert found([]) == []


def test_nulls_and_repeats(spark):
    files = spark.createDataFrame([("a.log", "x", 1), ("a.log", "x", 1), (None, "y", 2), ("b", None, 3)], "path string, text string, dir int")
    rows = spark.createDataFrame([("", 0, "*.log")], "dir string, n int, pattern string")
    assert sorted(map(tuple, ignored.without_ignored(files, rows).collect()), key=repr) == [("b", None, 3), (None, "y", 2)]

import subprocess

import pytest
from pyspark.sql import functions as F

from siftline.operators import grep, lexical, repo_map, semantic, structural, symbols, tags
from siftline.operators.callers import callers, certainty
from siftline.plans.structural_pattern import lower
from siftline.sources import tree


def spots(rows):
    return sorted((r.path, r.line, r.col) for r in rows.collect())


@pytest.mark.parametrize("pattern,want", [("^", [(1, 1), (2, 1), (3, 1)]), ("^$", [(2, 1)]), ("z*", [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (3, 1), (3, 2), (3, 3), (3, 4)])])
def test_empty_matches(corpus, pattern, want):
    assert [x[1:] for x in spots(grep.grep(corpus({"a": "abc\n\nxyz\n"}), pattern, literal=False))] == want


def test_matches(corpus):
    assert [x[1:] for x in spots(grep.grep(corpus({"a": "Étude foo"}), "foo"))] == [(1, 7)]
    assert grep.grep(corpus({"a": "a" * 30_720}), "aaa").count() == 10_240
    assert spots(grep.grep(corpus({"a": "İ\nI\ni\n"}), "I", ignore_case=True)) == [("a", 2, 1), ("a", 3, 1)]
    assert spots(grep.grep(corpus({"a": "cat cats\n.cat"}), "cat", word=True)) == [("a", 1, 1), ("a", 2, 2)]
    assert grep.grep(corpus({"a": "Foo foo"}), "foo", smart_case=True).count() == 2
    assert grep.grep(corpus({"a": "Foo foo"}), "Foo", smart_case=True).count() == 1
    assert grep.grep(corpus({"a": None, "b": ""}), "x").count() == 0


def test_context_and_enclosing(corpus):
    row = grep.grep(corpus({"a": "l1\nl2\nl3\nHIT\nl5\nl6\nl7"}), "HIT", before=2, after=2).first()
    assert (row.before, row.after) == (["l2", "l3"], ["l5", "l6"])
    assert grep.grep(corpus({"a": "HIT\nx"}), "HIT", before=2).first().before == []
    rows = grep.grep(corpus({"a.ts": "function foo() {\n  HIT\n}\n\n\nfunction bar() {\n  HIT\n}", "b.txt": "HIT"}), "HIT", enclosing=True).collect()
    assert {(r.path, r.line): r.enclosing and r.enclosing.name for r in rows} == {("a.ts", 2): "foo", ("a.ts", 7): "bar", ("b.txt", 1): None}


def test_capped(corpus):
    files = corpus({f"f{i:02}.txt": "hit\n" * 400 for i in range(60)})
    rows = grep.capped(grep.grep(files, "hit")).collect()
    assert len(rows) == 20_000 and (rows[0].path, rows[0].line) == ("f00.txt", 1) and (rows[-1].path, rows[-1].line) == ("f49.txt", 400)


SOURCES = {
    "a.ts": "export class Foo {\n  bar() {}\n}\nfunction topFn() {}\ninterface Iface {}\nenum Colors {}\ntype Alias = 1\nconst arrow = () => 1\n// class Ghost {}\n",
    "b.py": "class Thing:\n    def inner(self): pass\ndef top(): pass\n",
    "c.go": "type Server struct {}\nfunc (s *Server) Start() {}\nfunc main() {}\n",
    "d.rs": "pub struct Point {}\nenum Dir {}\nimpl Point {}\npub async fn helper() {}\n",
    "e.java": "public class App {}\ninterface Api {}\n",
    "f.cpp": "class Widget {\nstruct Point {\nint add(int a, int b) {\n",
    "g.zig": "func alpha {}\nclass Beta {}\n",
}
NAMES = {"a.ts": ["Foo", "topFn", "Iface", "Colors", "Alias", "arrow"], "b.py": ["Thing", "top"], "c.go": ["Server", "Start", "main"], "d.rs": ["Point", "Dir", "Point", "helper"], "e.java": ["App", "Api"], "f.cpp": ["Widget", "Point", "add"], "g.zig": ["alpha", "Beta"]}


def test_outline(corpus):
    rows = symbols.outline(corpus(SOURCES)).orderBy("path", "line").collect()
    assert {p: [r.name for r in rows if r.path == p] for p in SOURCES} == NAMES
    assert [(r.kind, r.name) for r in symbols.outline(corpus(SOURCES), 1).filter("path = 'a.ts' AND kind = 'method'").collect()] == [("method", "bar")]
    members = corpus({"m.ts": "class A {\n  m() {}\n  n() {},\n  constructor() {\n  async run() {\n  sig(): void;\n  if (x) {\n}"})
    assert [r.name for r in symbols.outline(members, 1).orderBy("line").collect()] == ["A", "m", "n", "constructor", "run"]


def test_callers(corpus):
    files = corpus({"defs.ts": "export function greet(n) {\n", "a.ts": "\ngreet(1);\n", "b.ts": "import { greet } from './defs';\n", "c.ts": "import x, { greet } from 'y';\ngreet();\n", "d.ts": "\nobj.greet;\n"})
    assert [x[:2] for x in spots(callers(files, "greet"))] == [("a.ts", 2), ("b.ts", 1), ("c.ts", 1), ("c.ts", 2), ("d.ts", 2)]
    rows = callers(files, "greet").withColumn("c", certainty(F.col("text"), F.col("via"))).collect()
    assert {r.path: r.c for r in rows} == {"a.ts": "exact", "b.ts": "exact", "c.ts": "exact", "d.ts": "possible"}
    assert spots(callers(corpus({"x.ts": "foo()\n$foo()\nfoo$bar()\n"}), "foo")) == [("x.ts", 1, 1)]
    assert spots(callers(corpus({"x.ts": "foo()\n$foo()\n"}), "$foo")) == [("x.ts", 2, 1)]


def test_caller_rings(corpus):
    chain = corpus({"leaf.ts": "export function leaf() {\n}\n", "mid.ts": "\nexport function mid() {\n  leaf();\n}\n", "top.ts": "\nexport function top() {\n  mid();\n}\n"})
    assert sorted((r.path, r.line, r.depth, r.via) for r in callers(chain, "leaf", 2).collect()) == [("mid.ts", 3, 1, "leaf"), ("top.ts", 3, 2, "mid")]
    cycle = corpus({"a.ts": "\nfunction a() {\n  b();\n}\n", "b.ts": "\nfunction b() {\n  a();\n}\n"})
    assert sorted((r.path, r.line, r.depth) for r in callers(cycle, "a", 3).collect()) == [("a.ts", 3, 2), ("b.ts", 3, 1)]


def test_many_callers(corpus):
    tree_ = {"t.ts": "export function target() {\n}\n"}
    tree_ |= {f"mid{i}.ts": f"export function mid{i}() {{\n  target();\n}}\n" for i in range(40)}
    tree_ |= {f"call{i}.ts": f"export function call{i}() {{\n  mid{i}();\n  mid{i}();\n}}\n" for i in range(40)}
    tree_ |= {f"fill{i}.ts": "const x = 1;\n" for i in range(320)}
    rows = callers(corpus(tree_), "target", 2).groupBy("depth").count().collect()
    assert {r.depth: r["count"] for r in rows} == {1: 40, 2: 80}


def test_structural(corpus):
    files = corpus({"a.ts": 'console.log("hi")\nconsole.log(foo)\nconsole.log()\n', "b.ts": "import x\nrun(1)\nfunction run(a) {\n", "c.ts": "go(2)\na == a\na == b\n"})
    assert spots(structural.structural(files, "console.log($MSG)")) == [("a.ts", 1, 1), ("a.ts", 2, 1)]
    assert spots(structural.structural(files, "$A == $A")) == [("c.ts", 2, 1)]
    assert spots(structural.structural(files, "inside: import >> kind:call")) == [("b.ts", 2, 1), ("b.ts", 3, 10)]
    assert spots(structural.structural(files.filter("path = 'b.ts'"), "kind:call")) == [("b.ts", 2, 1)]
    hit = corpus({"x": "foo + f"})
    assert structural.rewrite_preview(structural.structural(hit, "$AB + $A"), "$AB + $A", "[$AB][$A][$MISSING]").first().rewritten == "[foo][f][$MISSING]"
    for bad in ("", "$$$", "kind: nope", "inside: a", "inside: has: x << y >> z", "$A $B $C $D $E $F $G $H $I $J"):
        with pytest.raises(ValueError):
            lower(bad)


def test_map_and_capsule(corpus):
    files = corpus({"src/alpha.py": "import beta\n\n# Alpha handler.\ndef alpha():\n    return beta.run()\n", "src/beta.py": "def run():\n    pass\n", "src/main.py": "from alpha import alpha\n\nalpha()\n", "docs/note.txt": "alpha\n"})
    degrees = {r.path: r.in_degree for r in repo_map.repo_map(files).collect()}
    assert degrees == {"src/alpha.py": 1, "src/beta.py": 1, "src/main.py": 0, "docs/note.txt": 0}
    rows = repo_map.capsule(files, "alpha").collect()
    found = [r for r in rows if r.part == "definition"][0]
    assert (found.path, found.line, found.text) == ("src/alpha.py", 4, "def\n# Alpha handler.")
    assert ("src/main.py", 3) in [(r.path, r.line) for r in rows if r.part == "caller"] and sum(r.part == "import" for r in rows) == 1
    docs = corpus({"src/parse.ts": "function mySymbol() {\n", "README.md": "mySymbol\nfunction mySymbol() x\nmySymbol\n"})
    assert repo_map.definition(docs, "mySymbol").first().path == "src/parse.ts"
    assert repo_map.definition(corpus({"docs/thing.md": "## mySymbol\n"}), "mySymbol").first().kind == "heading"


def test_keywords_and_ranking(corpus):
    words = lexical.keywords('how the Retry Budget gets compacted, "exact phrase"', ("Retry",))
    assert words == ["exact phrase", "retry", "budget", "compact"]
    counts = lexical.keyword_counts(corpus({"retry.ts": "", "b.ts": "Retry retry\nbudget\n"}), ["retry", "budget"])
    assert {r.path: r.counts for r in counts.collect()} == {"retry.ts": [0, 0], "b.ts": [2, 1]}
    scores = {r.path: r.lex for r in lexical.lexical_scores(counts, ["retry", "budget"], [2.0, 1.0]).collect()}
    assert scores["retry.ts"] == 4.0
    assert lexical.keyword_counts(corpus({"a": "x"}), []).first().counts == []


def test_passages(corpus, spark):
    rows = lexical.windows_of("aa\nbbbbbbbbbb\ncc\n", 10, [], [], clipped=True)
    assert [(r["start"], r["stop"]) for r in rows] == [(1, 1), (2, 2), (3, 3)] and rows[1]["text"] == "L2| bbbbb\n"
    made = lambda scores: spark.createDataFrame([("f", i + 1, i + 1, "", float(s)) for i, s in enumerate(scores)], "path string, start int, stop int, text string, score double")
    starts = lambda rows: sorted(r.start for r in rows.collect())
    assert starts(lexical.selected_windows(made(range(10)), 3)) == [8, 9, 10]
    assert starts(lexical.selected_windows(made([0] * 10), 3)) == [1, 5, 10]
    assert lexical.sketch_of("L1| a\nL2| retry(\n", 10, ["retry"], [1.0], 60) == "10: a\n11: retry("
    assert lexical.sketch_of("L1| a\n", 10, [], [], 8) == ""


def test_merged_heat(spark):
    rows = spark.createDataFrame([("f", 5, 8, 0.9, "a"), ("f", 9, 12, 0.5, "b"), ("f", 20, 22, 0.7, "c"), ("f", 30, 31, 0.1, "d")], "path string, start int, stop int, p double, snippet string")
    assert [tuple(r)[1:] for r in lexical.merged_heat(rows, 0.2).orderBy(F.desc("p")).collect()] == [(5, 12, 0.9, "a"), (20, 22, 0.7, "c")]


def test_search(corpus):
    files = corpus({"a.ts": "retry budget\n" * 240, "b.ts": "nothing\n" * 40, ".env": "retry", "node_modules/x.js": "retry", "Cargo.lock": "retry", "k.pem": "retry", "empty.ts": ""})
    rows = semantic.search(files, "the retry budget").collect()
    assert [r.path for r in rows] == ["a.ts"] and rows[0].ranges[0].start == 1

    def failing(pairs):
        raise RuntimeError

    assert semantic.search(files, "the retry budget", failing).count() == 0


def test_tags(corpus):
    texts = {"a": "a \n b \t\r\nc", "b": "hello\n", "c": "\ufeffhello \r\n", "d": "", "e": None, "f": " \t" * 5000 + "x", "g": "a\n b\nc"}
    got = {r.path: r.tag for r in corpus(texts).select("path", tags.content_tag("text").alias("tag")).collect()}
    assert (got["a"], got["b"], got["c"], got["d"], got["e"]) == ("80BA", "5BF9", "5BF9", "5D05", None) and got["a"] == got["g"] != got["f"]



def test_tree(spark, tmp_path):
    for path, data in {"real.js": b"x", ".env": b"k", "node_modules/m.js": b"x", ".git/config": b"x", ".cache/c": b"x", "sub/u16.txt": b"\xff\xfe" + "hé\n".encode("utf-16-le"), "sub/bin": b"a\0b", "sub/bad": b"a\xffb", "sub/big": b"x" * (2 * 1024 * 1024 + 64)}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    found = {r.path: r.text for r in tree.contents(tree.listing(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert found == {"real.js": "x", ".env": "k", "sub/u16.txt": "hé\n", "sub/bin": None, "sub/bad": "a�b", "sub/big": None}
    assert [r.path for r in tree.listing(spark, str(tmp_path), ".cache").collect()] == [".cache/c"]
    with pytest.raises(ValueError):
        tree.listing(spark, "/")
    assert tree.modified(spark, str(tmp_path / "sub")) is None
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".git").exists() and (tmp_path / "new file.txt").write_text("x")
    assert "new file.txt" in [r.path for r in tree.modified(spark, str(tmp_path)).collect()]

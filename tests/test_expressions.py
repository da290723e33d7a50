import random
import re
import time

import pytest

from siftline.functions import fixed_values as fixed
from siftline.functions.expressions import compiled, flattened, hits_of, in_columns, linear, linear_hits, restarts
from siftline.operators.grep import grep
from siftline.operators.structural import structural
from siftline.operators.symbols import outline

LONG = 30_000


def answered(act):
    """What act gives, or the name of the error that it raises, within ten seconds."""
    start = time.time()
    try:
        out = act()
    except Exception as wrong:  # whatever Spark wraps the task's error in
        assert "MatchOverBudget" in str(wrong), wrong
        out = "over budget"
    assert time.time() - start < 10
    return out


@pytest.mark.parametrize("pattern", ["(a|b)*c", "(a|aa)*$", "(a+)+$", "(a|a)*b", "a*a*a*b", r"(\w+\s*)+x", "((a+))+b", "(?:ab|cd)+", "(a|b)*?c"])
@pytest.mark.parametrize("line", ["ab" * (LONG // 2), "a" * LONG, "a" * LONG + "b"])
def test_long_lines(spark, corpus, pattern, line):
    files = corpus({"x": line + "\nabc\n"})
    answered(lambda: grep(files, pattern, literal=False).count())
    assert spark.range(3).count() == 3  # the session is alive


def test_long_lines_are_found(corpus):
    assert grep(corpus({"x": "a" * 35 + "b"}), "(a|a)*b", literal=False).first().col == 1
    assert grep(corpus({"x": "a" * 35}), "(a+)+$", literal=False).count() == 1
    assert grep(corpus({"x": "ab" * 15_000 + "c"}), "(a|b)*c", literal=False).first().col == 1
    literal = '"' + r"\"x" * 10_000 + '"'
    assert structural(corpus({"x.ts": f"f({literal})"}), "f($A)").first().col == 1
    assert structural(corpus({"x.ts": f"f({literal}"}), "f($A)").count() == 0
    chain = ".".join(["name"] * 6000)
    assert structural(corpus({"x.ts": f"{chain}(1)\n{chain}"}), "kind:call").count() == 1
    words = "public static " * 5000
    found = outline(corpus({"x.java": f"{words}class A {{\n  {words}int get(int a) {{\n", "y.ts": f"{words}foo() {{\n  {words}foo() {{\n"}), 1).collect()
    assert {(r.path, r.line, r.name) for r in found} == {("x.java", 1, "A"), ("x.java", 2, "get"), ("y.ts", 2, "foo")}


def test_budget_names_line(corpus):
    with pytest.raises(Exception, match=r"MatchOverBudget.*line 2 .*within 0.2 s"):
        grep(corpus({"x": "ok\n" + "a" * 60 + "!"}), "(a|a|aa)*[b-d]", literal=False, seconds=0.2).collect()
    with pytest.raises(ValueError, match="invalid regex: .a"):
        grep(corpus({"x": "a"}), "(a", literal=False)


def test_engines_agree(corpus):
    rnd = random.Random(2)
    files = corpus({f"f{i}": "\n".join("".join(rnd.choice("abc ") for _ in range(rnd.randrange(30))) for _ in range(20)) for i in range(10)})
    for plain, grouped in (("[ab]+c", "(a|b)+c"), ("(?:ab){1,64}c", "(?:ab)+c"), ("a[bc]*+a", "a(?:b|c)*a")):
        assert in_columns(plain) and not in_columns(grouped)
        assert sorted(map(tuple, grep(files, plain, literal=False).collect())) == sorted(map(tuple, grep(files, grouped, literal=False).collect()))


def test_groups_of_single_characters_are_classes():
    assert flattened("(a|b)*c") == "[ab]*c" and in_columns(flattened("(a|b)*c"))
    assert flattened(r"(?:\w|-)+x(\d|[ab_])+y") == r"(?:\w|-)+x[\dab_]+y"
    for kept in (r"(a|b)*\1", "(ab|c)*", "(a|b)", "(a|b)?", r"\(a|b\)*", "[(]a|b)*", "(a|^)*", "(?P<x>a|b)*"):
        assert flattened(kept) == kept
    rnd = random.Random(6)
    for pattern in ("(a|b)*c", "(?:a|b|_)+", r"x(\d|a){2,5}", "(c| )*?a", r"(\w|[ab])+ ", "(a)+(b)*"):
        flat = flattened(pattern)
        assert flat != pattern
        for _ in range(3000):
            line = "".join(rnd.choice("abcx1_ ") for _ in range(rnd.randrange(14)))
            assert [m.span() for m in re.finditer(pattern, line)] == [m.span() for m in re.finditer(flat, line)]


def test_choice_of_engine():
    assert all(map(in_columns, ["foo.*bar", r"\w+\s+\w+", "[aeiou]{3}r+e", r"\b(?:stand|der)\b", "(?i)license", "(ab){3}x", r"v\d+(?:\.\d+)?"]))
    assert not any(map(in_columns, ["foo.*bar.*baz", "a*a*b", "(a|b)*c", r"(?:\w+\.)+", "(ab){1000}", "((a{1,9}){1,9}b){1,9}", r"(.*?), (.*?)!"]))


def plain(pattern):
    """The same pattern with repeats that may give back, and without what stands against giving back."""
    for ahead in (r"(?!\()", r"(?!(?:\w+\s*)?\()"):
        pattern = pattern.replace(ahead, "")
    pattern = pattern.replace("]++|", "]|")
    return re.sub(r"(?<=[*+])\+", "", pattern)


WORDS = """public private protected static async abstract override readonly final sealed partial internal synchronized virtual export default
open data get set class function def fn func interface enum struct type record trait constructor foo pub new""".split()
MARKS = ["(", ")", "()", "(a, b)", " ", "  ", "\t", "*", "* ", "{", " {", ":", ": int ", "<T>", "[]", ".", ",", ";", '"a"', "'", '"', "\\", '\\"', "`", "$x"]


def test_possessive_patterns_find_the_same():
    rnd = random.Random(1)
    shapes = [(p, g) for rows in fixed.SYMBOL_SHAPES.values() for p, _, g, *_ in rows]
    shapes += [(p, 0) for p in (fixed.DEFINING, fixed.CONSTRUCTOR_LINE, *fixed.KINDS.values(), rf"foo\({fixed.ATOM}\)", rf"{fixed.ATOM} = {fixed.ATOM}")]
    shapes += [(fixed.DEFINITION_HEAD + r"(\w+)", 1), (fixed.DEFINING_SHAPE + r"(\w+)\s*\([^;]*\)\s*[:{]", 1), (fixed.CALL_DEFINITION_SHAPE + fixed.CALL_DEFINITION_BODY, 0)]
    changed = [(re.compile(p), re.compile(plain(p)), g) for p, g in shapes if plain(p) != p]
    assert len(changed) > 12
    met = 0
    for _ in range(40_000):
        line = "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", "", "  ", "\t"]) if rnd.random() < 0.65 else rnd.choice(MARKS) for _ in range(rnd.randrange(1, 9)))
        for new, old, g in changed:
            a, b = new.search(line), old.search(line)
            assert (a and (a.span(g), a.start())) == (b and (b.span(g), b.start())), (new.pattern, line)
            met += a is not None
    assert met > 10_000


def test_two_gaps_on_long_lines_in_linear_time(corpus):
    """Lines on which the matcher went over its three seconds at 0.5 GB: many starts, many middles, and no end."""
    open_end = "the " * 5_000 + "ing " * 5_000
    start = time.time()
    found = grep(corpus({"x": f"{open_end}\n{open_end}and é the ing\n"}), "the.*ing.*and", literal=False).collect()
    assert [(r.line, r.col) for r in found] == [(2, 1)] and time.time() - start < 10


def test_linear_agrees_with_the_matcher():
    rnd = random.Random(5)
    lines = ["".join(rnd.choice("abcd é_1\v") for _ in range(rnd.randrange(40))) for _ in range(400)]
    texts = ["\n".join(lines[i : i + 20]) + "\n" * (i % 40 == 0) for i in range(0, 400, 20)] + [None, "", "\n"]
    for pattern in ("a.*b.*c", "a.*?b", "(a|ab)(c|bcd)*d", r"\w+\s*b", r"\ba", "^a|b$", "[^ab]{2,3}c?", r"[\wé]+\d", r"\S+a", r"(?:ab|[\Wc])+?d", "a|aa", r"\.|a{2}", "[]a]b"):
        assert linear(pattern), pattern
        assert linear_hits(texts, linear(pattern)) == [hits_of(t, compiled(pattern), 3) for t in texts], pattern
    for pattern in ("a*", "(?i)ab", r"(a)\1", "(?=a)b", "a++b", "(a*)*b", "(?:ab){e<=1}", "[[:alpha:]]b", r"\Ba", "a{1,2000}", r"[\Sa]b"):
        assert linear(pattern) is None, pattern
    assert restarts("the.*ing.*and") and restarts("[ab]*c") and not restarts("[aeiou]{3}r+e") and not restarts("stand|der")

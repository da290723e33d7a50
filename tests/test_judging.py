import pytest
from pyspark.sql import functions as F

from siftline.operators import semantic
from siftline.operators.semantic import JudgeFailed, answered, answers, cascade, requests, unanswered


@pytest.fixture
def asked(spark):
    rows = spark.createDataFrame([(f"p{i}", f"text {i}", 10 - i) for i in range(7)], "path string, body string, lex int")
    return requests(rows, 3, [F.desc("lex")], "e", 3)


def test_requests_have_keys(asked):
    assert [(r.request, r.key, r.path) for r in asked.orderBy("request", "key").collect()] == [(i // 3, f"e{i % 3:03}", f"p{i}") for i in range(7)]


def test_answers_in_any_order_and_missing(asked):
    def judge(question, entries):
        assert question == "q"
        got = {k: 0.1 * (1 + int(t.split()[1])) for k, t in reversed(entries.items()) if t != "text 4"}
        return got | {"e099": 0.9, "e000": 2.0 if "text 6" in entries.values() else got.get("e000")}

    given = answers(asked, "body", "q", judge).cache()
    found = {r.path: r.p for r in answered(asked, given).collect()}
    assert {k: v and round(v, 6) for k, v in found.items()} == {"p0": 0.1, "p1": 0.2, "p2": 0.3, "p3": 0.4, "p4": None, "p5": 0.6, "p6": None}
    assert sorted(r.path for r in unanswered(asked, given).collect()) == ["p4", "p6"]


def test_a_request_without_any_answer(asked):
    given = answers(asked, "body", "q", lambda question, entries: {} if "text 6" in entries.values() else dict.fromkeys(entries, 0.5)).cache()
    assert [(r.path, r.p) for r in answered(asked, given).orderBy("path").collect()] == [(f"p{i}", 0.5 if i < 6 else None) for i in range(7)]
    assert [r.path for r in unanswered(asked, given).collect()] == ["p6"]
    assert answers(asked, "body", "q", lambda question, entries: {}).count() == 0


def test_a_failed_request_costs_its_answers(asked):
    def judge(question, entries):
        if "text 3" in entries.values():
            raise RuntimeError("no reply")
        return dict.fromkeys(entries, 0.5)

    given = answers(asked, "body", "q", judge).cache()
    assert [(r.request, r.key, r.failure) for r in given.filter("failure IS NOT NULL").collect()] == [(1, None, "no reply")]
    assert sorted(r.path for r in unanswered(asked, given).collect()) == ["p3", "p4", "p5"]


FILES = {"a.ts": "retry budget\n" * 240, "b.ts": "nothing\n" * 40, "long.ts": "\n".join(f"line {i} of the retry budget" + " filler" * 40 for i in range(3000))}


def test_judge_that_always_fails(corpus):
    calls = []

    def judge(question, entries):
        raise ValueError(f"down {sorted(entries)[0]} {len(entries)}")

    out = cascade(corpus(FILES), "the retry budget", judge)
    assert out.rows.count() == 0 and out.judged == 0 and out.errors == out.requests > 1
    kept = [(r.phase, r.message) for r in out.failures.collect()]
    assert kept[0] == ("names", "down e000 3") and len(kept) <= 5 and len(set(kept)) == len(kept)
    with pytest.raises(JudgeFailed, match="names: down"):
        out.checked()
    assert not calls


def test_some_failures_are_kept_and_harmless(corpus):
    def judge(question, entries):
        if len(entries) == 3 and all(k[0] == "e" for k in entries):
            raise RuntimeError("names down")
        return {k: 0.9 if "retry" in t else 0.0 for k, t in entries.items()}

    out = cascade(corpus(FILES), "the retry budget", judge)
    rows = {r.path: r for r in out.checked().collect()}
    assert {"a.ts", "long.ts"} == set(rows) and [(r.phase, r.message) for r in out.failures.collect()] == [("names", "names down")]
    assert out.errors == 1 and out.judged > 2
    assert not rows["a.ts"].truncated and rows["long.ts"].truncated


def test_judge_is_asked_once(spark, corpus):
    asked = spark.sparkContext.accumulator(0)

    def judge(question, entries):
        asked.add(1)
        return dict.fromkeys(entries, 0.8)

    out = cascade(corpus(FILES), "the retry budget", judge)
    out.rows.collect()
    out.rows.count()
    out.failures.collect()
    assert asked.value == out.requests and semantic.by_key(lambda pairs: [0.1] * len(pairs))("q", {"a": "x"}) == {"a": 0.1}

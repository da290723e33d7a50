import re
from fractions import Fraction

import pytest

from siftline.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, target int"


def filled(sizes, total, weights=mixing.WEIGHTS, epochs=3):
    """Targets by clamping and resharing in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = total - sum(target.values())
        shares = {s: Fraction(rest * weight[s], sum(weight[x] for x in open_)) for s in open_}
        above = {s for s in open_ if shares[s] > epochs * sizes[s]}
        if not above:
            return target | shares
        target |= {s: Fraction(epochs * sizes[s]) for s in above}
        open_ -= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture
def docs(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, "w " * (i * i % 50), "x", i) for i in range(200)]
    rows += [(1000 + i, "hot", f"hot {i} word" + "\n more" * (i % 4), None, None) for i in range(300)]
    rows += [(None, "hot", "a b c", None, None)] * 40 + [(7, "a", "x y", None, None)] * 3
    rows += [(2000, "tiny", "one", None, None), (2001, "blank", " \t", None, None), (2002, "blank", None, None, None), (2003, "é", "z " * 2000, None, None), (2004, "", "q", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_mixture(docs):
    rows = mixing.mixture(docs, keep=("doc_id", "source", "text")).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        assert r.size == words(r.text)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = filled({s: n for s, n in sizes.items()}, sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.part <= r.size and r.copies * r.size + r.part <= 3 * r.size
        taken[r.source] += r.copies * r.size + r.part
    for s, n in taken.items():
        assert abs(n - want[s]) <= (45 if s == "hot" else 4), s  # rows that share an id are rounded down each
    again = mixing.mixture(docs.coalesce(1), keep=("doc_id", "source", "text")).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_other_budget_and_seed(docs):
    half, whole = (mixing.mixture(docs, (5, 1), 2, 1, total=n, keep=("doc_id", "source")).collect() for n in (1000, 10**9))
    assert abs(sum(r.copies * r.size + r.part for r in half) - 1000) < 50
    assert all(r.copies == 2 and r.part == 0 for r in whole if r.size)  # more than two epochs of everything


def test_texts_of_the_mix(docs):
    mix = mixing.mixture(docs, keep=("doc_id", "source", "text"))
    counted = {}
    for r in mixing.mixed_texts(mix.filter("doc_id IS NOT NULL AND doc_id <> 7")).collect():
        assert words(r.text) == r.words
        counted[r.doc_id] = counted.get(r.doc_id, 0) + r.words
    assert counted == {r.doc_id: r.copies * r.size + r.part for r in mix.collect() if r.doc_id not in (None, 7) and r.copies * r.size + r.part}
    source = {r.doc_id: r.text for r in docs.collect()}
    assert all((source[r.doc_id] or "").startswith(r.text) for r in mixing.mixed_texts(mix.filter("doc_id > 7")).collect())


def test_sources_are_ranked_over_parts(spark):
    rows = [(i, f"s{i:04}", "a b") for i in range(999, -1, -1)] + [(5000, None, "n")]
    found = {r.source: r.weight for r in mixing.weighted(spark.createDataFrame(rows, "doc_id long, source string, text string").select("source").repartition(9)).collect()}
    assert found == {f"s{i:04}": i % 3 + 1 for i in range(1000)} | {None: 1000 % 3 + 1}


def test_empty(spark):
    assert mixing.mixture(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mixture(spark.createDataFrame([(1, "a", None, None, None)], SCHEMA)).first()[1:] == (0, 0, 0.0, 0, 0)

import random
import re
import zlib
from collections import Counter

import pytest

from siftline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(words):
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= 5 * n else None
        out[w] = (n, len(others), form, words[form] if form else None)
    rows = []
    for w, (n, k, form, form_n) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, n, k, form, form_n, root))
    return sorted(rows, key=repr)


def shown(rows):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows.collect()), key=repr)


@pytest.fixture
def words():
    rnd = random.Random(3)
    out = {}
    for _ in range(250):
        out["".join(rnd.choice("abé") for _ in range(rnd.randrange(6, 10)))] = rnd.choice([5, 6, 30, 200, 2000])
    for _ in range(150):  # a third of the words share a long prefix, others a suffix
        out["samebeginning" + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(3, 6)))] = rnd.choice([5, 50, 500])
        out["".join(rnd.choice("xyz") for _ in range(rnd.randrange(3, 6))) + "sameending"] = rnd.choice([5, 50, 500])
    long = "".join(rnd.choice("abcdefgh") for _ in range(700))
    out |= {long: 1000, long[:350] + long[351:]: 100, long[:10] + "z" + long[11:]: 10, "a" + long: 7, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "aaaaaaaaaa": 3125}
    return out


@pytest.mark.parametrize("most", [3, 40, spelling.UNIT_WORDS])
def test_variants(spark, words, most):
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert shown(spelling.variants(rows, most=most)) == brute(words)


def test_vocabulary(spark):
    texts = [(i, f"Straße Fenster{'x' * (i % 3)} fenster FENSTER ÉCOLIER écolier short a_b×÷×÷×÷ " * (1 + i % 2)) for i in range(300)] + [(None, "Fenster nullish nullish nullish nullish nullish"), (7, None), (8, ""), (9, "q" * 9000)]
    want = Counter()
    for ident, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    rows = spelling.vocabulary(spark.createDataFrame([(*t, "clash", 1) for t in texts], SCHEMA).repartition(5))
    assert {r.word: r.n for r in rows.collect()} == want
    assert shown(spelling.variants(rows)) == brute(want)


def test_empty(spark):
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([(1, None, None, None)], SCHEMA))).collect() == []
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([], SCHEMA))).collect() == []

"""The registered queries of the classifiers, against plain Python over every row."""

import collections
import math
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import language_id, quality_model
from siftline.llm.common import documents, remainder
from siftline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def plain_features(text, n_chars, bits):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw.lower())
    n, size = len(words), len(raw)
    buckets = collections.Counter((xxhash.xxh64_intdigest(w)) & ((1 << bits) - 1) for w in words)
    norm = math.sqrt(sum(c * c for c in buckets.values()))
    share = lambda chars: sum(raw.count(c) for c in chars) / max(size, 1)
    each = lambda text: [text[i : i + 1] for i in range(len(text))]
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    told = n_chars if n_chars is not None and n_chars >= 0 else len(text or "")
    stats = [
        math.log1p(n), math.log1p(size), sum(map(len, words)) / max(n, 1), share(each(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), share(each(b"abcdefghijklmnopqrstuvwxyz")), share(each(b"0123456789")), share(each(b"#*$%&|<>@^~{}[]\\")),
        share(each(b"!?")), share(each(b".,;:")), len(buckets) / max(n, 1), max(buckets.values(), default=0) / max(n, 1), sum(a == b for a, b in zip(words, words[1:])) / max(n, 1),
        (len(lines) - len(set(lines))) / max(len(lines), 1), len(lines) / max(n, 1), math.log1p(told), math.log1p(told) - math.log1p(len(text or "")),
    ]
    return {b: c / norm for b, c in buckets.items()}, np.array(stats)


def test_quality_query(spark, rows):
    docs = documents(spark, SF)
    machine = quality_model.learn(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(remainder("doc_id", 5) != 0))
    got = {r.doc_id: r.score for r in QUERIES["op6_quality_model"](spark, SF).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _, n_chars in rows:
        buckets, stats = plain_features(text, n_chars, machine.bits)
        z = np.clip((stats - machine.mean) / machine.scale, -6, 6) / 2
        x = {**buckets, **{(1 << machine.bits) + i: v for i, v in enumerate(z)}}
        ids = sorted(x)
        values, factors = np.array([x[i] for i in ids]), machine.v[ids]
        pairs = (factors @ factors.T) * np.outer(values, values)
        raw = machine.w0 + machine.w[ids] @ values + sum(pairs[i, :i].sum() for i in range(len(ids)))
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, raw)))), abs=1e-7), doc_id


def test_stated_characters(spark):
    text = "word " * 30
    given = [(1, text, "150"), (2, text, None), (3, text, "-4"), (4, text, "many"), (5, text, "9000")]
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(given, "doc_id long, text string, n_chars string")
    machine = quality_model.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality_model.scored(docs, machine).collect()}
    assert got[1] == got[2] == got[3] == got[4] != got[5]
    assert {r.score for r in quality_model.scored(docs.drop("n_chars"), machine).collect()} == {got[1]}


class PlainKneserNey:
    """Interpolated Kneser-Ney over dictionaries."""

    def __init__(self, grams, order, alphabet):
        self.uniform, self.levels, counts = 1 / (alphabet + 1), {}, dict(grams)
        for n in range(order, 0, -1):
            ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
            discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            total, kinds = collections.Counter(), collections.Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels[n] = (counts, total, kinds, discount)
            counts = collections.Counter(g[1:] for g in counts)

    def p(self, gram):
        out = self.uniform
        for n in range(1, len(gram) + 1):
            counts, total, kinds, discount = self.levels[n]
            g = gram[len(gram) - n :]
            if total[g[:-1]]:
                out = max(counts.get(g, 0) - discount, 0) / total[g[:-1]] + discount * kinds[g[:-1]] / total[g[:-1]] * out
        return out


def letters(text):
    out = re.sub(r"[\W\d_]+", " ", (text or "").lower())
    return out if any(c.isalpha() for c in out) else ""


def test_language_query(spark, rows):
    order = 4
    docs = documents(spark, SF)
    fitted = language_id.fit(docs.filter(remainder("doc_id", 4) != 2).select("doc_id", "lang", "text"))
    learnt = {r.doc_id for r in docs.filter((remainder("doc_id", 4) != 2) & (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) != 0)).select("doc_id").collect()}
    counts = collections.defaultdict(collections.Counter)
    for doc_id, text, lang, _ in rows:
        if doc_id in learnt and lang is not None and text is not None:
            padded = "\0" * (order - 1) + letters(text)
            counts[lang].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    alphabet = len({g[-1] for c in counts.values() for g in c})
    models = {lang: PlainKneserNey(c, order, alphabet) for lang, c in counts.items()}
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    assert len(got) == len(rows) and set(models) == set(fitted.langs)
    for doc_id, text, _, _ in rows[::3]:
        clean = letters(text)
        if not clean:
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        padded = "\0" * (order - 1) + clean
        every = collections.Counter(padded[i : i + order] for i in range(len(clean)))
        h = {lang: -sum(n * math.log2(m.p(g)) for g, n in every.items()) / len(clean) for lang, m in models.items()}
        best, second = sorted(h, key=lambda x: (h[x], x))[:2]
        assert got[doc_id].lang_pred == best
        assert got[doc_id].score == pytest.approx(1 / (1 + math.exp(-(fitted.slope * (h[second] - h[best]) + fitted.shift))), abs=1e-6), doc_id


def test_many_languages(spark):
    rows = [(i, f"l{i % 40:02}", "abc def ghi " * (1 + i % 40)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    fitted = language_id.fit(docs, most_langs=7)
    assert fitted.langs == [f"l{i}" for i in range(33, 40)]
    assert language_id.identify(docs, fitted).filter("lang_pred IS NULL").count() == 0

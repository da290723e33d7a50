"""The ten operators on small tables, against brute force, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm import bpe, chat_template, exact_dedup, language_id, license_scan, packing, quality_model, quality_rules, simhash, suffix_tree, tokens
from siftline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09-\x0d"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, fp long, block long, row_key long"


def words(text, lower=True):
    text = text or ""
    return re.findall(f"[^{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank, very long and repeated texts, ties, clashing column names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf " * 4
    texts = [None, "", " \t\n", "a", "a", "A b", base, base, base.replace(" ", "  "), base + "end", "word " * 60, "x" * 200_000, "é ü ß 日本語 😀 \x85  ", "the mit license", "line\nline\nline\n"]
    rows = [(i if i != 5 else None, t, None if i % 3 else "en", None if i % 4 else "s", None, None, None, None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[6]], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sample():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id").df()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    got = QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == sorted(map(repr, want.select(*columns).fetchall()))


# 1


def test_suffix_tree(spark, sample):
    got = QUERIES["op1_suffix_tree"](spark, SF).toPandas().set_index("doc_id")
    texts = {i: words(t) + ["\n"] for i, t in zip(sample.doc_id, sample.text)}
    c = collections.Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n = sum(c.values())
    for i, t in texts.items():
        row = got.loc[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert row.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def brute_tree(train, least, least_count, depth, least_gain, discount):
    """The same model by dictionaries: a function from words to the log10 probability of their text."""
    lines = [[*words(t), "\n"] for t in train]
    c = collections.Counter(w for x in lines for w in x)
    n, hot = sum(c.values()), {w for w in c if c[w] >= least}
    root = lambda w: (c[w] + 1) / (n + len(c) + 1)
    grams = [collections.Counter(tuple(x[i : i + k]) for x in lines for i in range(len(x) - k + 1)) for k in range(depth + 2)]
    tree = {(v,): {} for v in hot if v != "\n"}
    for k in range(2, depth + 2):
        for g, m in grams[k].items():
            if m >= least and set(g) <= hot and g[:-1] in tree:
                tree[g[:-1]][g[-1]] = m
                if k <= depth and g[-1] != "\n":
                    tree[g] = {}
    rare = {(v,): {w: grams[2][v, w] for w in hot if grams[2][v, w] > 1} for v in c if v not in hot and c[v] >= least_count}
    all_ = tree | {k: v for k, v in rare.items() if v}
    count = lambda s: c[s[0]] if len(s) == 1 else grams[len(s)][s]
    left = {s: 1 - sum(m - discount for m in x.values()) / count(s) for s, x in all_.items()}

    def p(w, s):
        if not s:
            return root(w)
        direct = (all_[s][w] - discount) / count(s) if w in all_[s] else 0
        return direct + left[s] * p(w, s[1:])

    states = set()
    for s, x in all_.items():
        rest = max(1 - sum(x.values()) / count(s), 0)
        gain = sum(m * math.log(m / count(s) / p(w, s[1:])) for w, m in x.items())
        if rest > 0:
            gain += count(s) * rest * math.log(max(rest, 1e-12) / min(max(1 - sum(p(w, s[1:]) for w in x), 1e-12), 1))
        if gain >= least_gain:
            states |= {s[i:] for i in range(len(s))}

    def score(text):
        x, out, used = [*words(text), "\n"], 0.0, 0
        for i, w in enumerate(x):
            s = next((tuple(x[i - k : i]) for k in range(min(depth, i), 0, -1) if tuple(x[i - k : i]) in states), ())
            out, used = out + math.log10(p(w, s)), used + len(s)
        return out, used / len(x), len(states & set(rare)), max(map(len, states), default=0)

    return score


def test_suffix_tree_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    zipf = 1 / np.arange(1, 61) ** 1.3
    train = [" ".join(rng.choice(vocabulary, 30, p=zipf / zipf.sum())) for _ in range(60)] + ["w1 w2 w3 w1 w2 w4 odd w5 w6"] * 9 + ["rare5 w1", "rare5 w1 rare6 w2"] * 3
    texts = [*train[:20], *train[-16:], "", "rare5 w2 unseen w1 w2 w3", None, "odd odd rare6"]
    model = suffix_tree.learn(spark.createDataFrame([(t,) for t in train], "text string"), least_share=10 / 2400, least_count=3, depth=3, least_gain=2.0)
    least = max(3, math.ceil(10 / 2400 * model.tree.total))
    brute = brute_tree(train, least, 3, 3, 2.0, 0.6)
    got = suffix_tree.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(got) == len(texts) and brute("")[2] > 0 and brute("")[3] == 3
    for r in got:
        assert (r.score, r.mean_depth) == pytest.approx(brute(texts[r.doc_id])[:2])


def test_places():
    rnd = np.random.default_rng(3)
    for table in (np.unique(rnd.integers(-(1 << 62), 1 << 62, 9000)), np.arange(5000) * 7, np.sort(rnd.choice(1 << 20, 6000, replace=False)) << 40):
        keys = np.concatenate([rnd.choice(table, 6000), rnd.integers(-(1 << 62), 1 << 62, 3000), table[:50] + 1])
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        want = np.where(table[at] == keys, at, -1)
        assert (suffix_tree.find(table, keys) == want).all() and (suffix_tree.find(table, keys[:100]) == want[:100]).all()
        assert (suffix_tree.find(table, keys[::2]) == want[::2]).all()


def test_symbols_of_regular_words():
    morse = [0]
    while len(morse) < 4096:
        morse += [1 - x for x in morse]
    import pyarrow as pa

    words = [w for n in (8, 64, 1024, 2048, 4096) for one in ("ab", "ba", "xy") for w in ["".join(one[x] for x in morse[:n]), "".join(one[1 - x] for x in morse[:n])]]
    words += ["a" * n for n in range(1, 3000)] + ["ab" * n for n in range(1, 500)] + ["a" * n + "b" + "a" * (700 - n) for n in range(700)]
    hashes, _ = suffix_tree.symbols(pa.array([" ".join(words)]))
    assert len(set(hashes.tolist())) == len(set(words)) + 1


def test_symbols():
    texts = [None, "", " ", "A b", "b a  \t", "é É aB", "x" * 5000, "\x0b\x0cword\x1c\x85", "ab"]
    import pyarrow as pa

    hashes, lengths = suffix_tree.symbols(pa.array(texts))
    want = [w for t in texts for w in [*words(t), ""]]
    assert lengths.tolist() == [len(words(t)) + 1 for t in texts] and len(hashes) == len(want)
    assert len(set(zip(want, hashes.tolist()))) == len(set(want)) == len(set(hashes.tolist()))


def test_suffix_tree_edges(spark, odd, empty):
    model = suffix_tree.learn(odd)
    assert suffix_tree.score(odd, model, keep=("doc_id", "score", "row_key")).count() == odd.count()
    model = suffix_tree.learn(empty)
    rows = suffix_tree.score(odd, model).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(0) for r in rows)
    assert suffix_tree.score(empty, model).count() == 0


# 2


def test_packing(spark, sample):
    got = QUERIES["op2_packing"](spark, SF).toPandas()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, text in zip(sample.doc_id, sample.text):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert (mine.start.to_numpy() == np.cumsum(mine.length) - mine.length).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(mine.start, mine.length, mine.ids_crc32))
    by_sequence = got.sort_values(["sequence_id", "offset"])
    assert (by_sequence.groupby("sequence_id").length.cumsum() - by_sequence.length == by_sequence.offset).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= 1024 and sizes.sum() / (1024 * len(sizes)) > 0.97


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=120), st.integers(1, 20))
def test_differencing(lengths, k):
    lengths = np.array(lengths, np.int64)
    windows = packing.pack(lengths, 1024)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert all(lengths[w].sum() <= 1024 for w in windows)
    parts = packing.differencing(lengths, k)
    assert sorted(i for w in parts for i in w) == list(range(len(lengths))) and len(parts) <= k


def test_packing_edges(odd, empty):
    rows = packing.packed(odd, packing.public_paths()).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 1024 and rows[rows.doc_id == 0].length.sum() == 1
    assert packing.packed(empty, packing.public_paths()).count() == 0


# 3


def test_language_id(spark, sample):
    got = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    truth = duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").df()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_kneser_ney_sums_to_one():
    text = "abracadabra " * 5 + "cabbage "
    points, ends, _ = language_id.grams([text], 3)
    _, first = language_id.distinct(language_id.hashed(language_id.window(points, ends, 3)))
    rows = np.stack(language_id.window(points, ends[first], 3), axis=1)
    inverse, _ = language_id.distinct(language_id.hashed(language_id.window(points, ends, 3)))
    alphabet = sorted(set(text))
    model = language_id.KneserNey(rows, np.bincount(inverse), len(alphabet))
    for history in ("ab", "zz", "a ", "\0\0"):
        p = 2 ** model.logs(np.array([[*map(ord, history), ord(c)] for c in [*alphabet, "?"]]))
        assert p.sum() == pytest.approx(1.0, abs=1e-6)


def test_language_id_edges(odd, empty):
    fitted = language_id.fit(odd.select("doc_id", "lang", "text"))
    rows = {r.doc_id: r for r in language_id.identify(odd, fitted).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == "und" and rows[6].lang_pred == "en" and rows[0].score == 0
    none = language_id.fit(empty.select("doc_id", "lang", "text"))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(empty, fitted).count() == 0


# 4


def brute_licenses(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    texts = [None, "", "mit license", "MIT-License mit license license", "the Apache License, Version 2.0; GNU General Public License", "x mitlicense MIT Licensé", "général public license", "mit " * 3 + "license " * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scanned(docs).collect()}
    for i, t in enumerate(texts):
        n, n_base, first, last, labels = brute_licenses(t)
        places = [x.place for x in rows[i].base]
        assert (rows[i].n_words, len(places), min(places, default=None), max(places, default=None)) == (n, n_base, first, last)
        assert ",".join(sorted({x.label for x in rows[i].base})) == labels


def test_license_rules(spark):
    assert len(license_scan.RULES) > 200 and len({r[4] for r in license_scan.RULES}) == len(license_scan.RULES)
    found = lambda t: [(x.first, x.last, x.label) for x in license_scan.scanned(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().found]
    assert found("We are licensed under the MIT License today") == [(2, 6, "mit")]  # the bare name within is suppressed
    assert found("SPDX-License-Identifier: Apache-2.0") == [(0, 5, "apache")]
    assert [x[2] for x in found("released under the BSD license; see LICENSE. Creative Commons Attribution ShareAlike license")] == ["bsd", "cc-by-sa"]
    assert found("no permit here") == []


def shortest(parsed):
    """A text that the parsed expression matches, with the first branches and the fewest repeats."""
    out = ""
    for op, x in parsed:
        match str(op):
            case "LITERAL":
                out += chr(x)
            case "IN":
                out += chr(x[0][1]) if str(x[0][0]) == "LITERAL" else chr(x[0][1][0]) if str(x[0][0]) == "RANGE" else "x"
            case "MAX_REPEAT":
                out += x[0] * shortest(x[2])
            case "SUBPATTERN":
                out += shortest(x[3])
            case "BRANCH":
                out += shortest(x[1][0])
            case "ASSERT":
                out += shortest(x[1])
            case other:
                raise ValueError(other)
    return out


def test_each_license_rule_fires_alone(spark):
    rules = license_scan.RULES
    texts = [shortest(re._parser.parse(pattern)) for *_, pattern in rules]
    assert all(keyword in f" {text} " for (_, _, _, keyword, _), text in zip(rules, texts))
    rows = license_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    silent = [(rules[r.doc_id][0], texts[r.doc_id]) for r in rows if rules[r.doc_id][0] not in {x.label for x in r.found}]
    assert not silent and len(rows) == len(rules)


def brute_detections(line):
    """All rules on a line of words by a plain regular expression, then suppression by pairs."""
    hits = []
    for rank, (label, priority, weight, _, pattern) in enumerate(license_scan.RULES):
        for m in re.finditer(rf"(?<= )(?:{pattern})(?= )", line):
            first = line[: m.start()].count(" ") - 1
            hits.append((first, -(first + m[0].count(" ")), -priority, rank, label))
    hits.sort()
    out = []
    for i, (first, less_last, less_priority, _, label) in enumerate(hits):
        if not any(h[1] <= less_last and h[2] <= less_priority for h in hits[:i]):
            out.append((first, -less_last, label))
    return out


def test_licenses_of_whole_texts(spark):
    """The query's operator on real documents and on mixtures of the rules' own passages, against brute force."""
    rng = np.random.default_rng(8)
    passages = [shortest(re._parser.parse(r[4])) for r in license_scan.RULES]
    texts = [" ".join(str(x) for x in rng.choice([*passages, "the", "licensed under", "a", "version 2 0"], 40)) for _ in range(40)] + ["mit license " * 300]
    texts += duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text ILIKE '%licen%' ORDER BY doc_id LIMIT 40").df().text.tolist()
    rows = license_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        line = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))) + " "
        assert [(x.first, x.last, x.label) for x in r.found] == brute_detections(line)
    assert sum(len(r.found) for r in rows) > 1000


def test_license_edges(odd, empty):
    assert license_scan.scanned(odd).count() == odd.count() and license_scan.scanned(empty).count() == 0


# 5


def test_template_language():
    run = lambda s, m=(): chat_template.Template(s).render(list(m))[0]
    assert run("{% if 1 == 1 %}a{{ 'x' + 'y' | upper }}{% else %}b{% endif %}{# no #}") == "axY"
    assert run("{% set n = 3 %}{{ n }}{% for m in messages %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", [{}, {}, {}]) == "31,2,3"
    assert run("{% for m in messages %}{{ m['role'] ~ ':' }}{% endfor %}", [{"role": "u"}]) == "u:"
    for bad in ("{% for x in %}", "{{ a( }}", "{% endif %}", "{% if x %}", "{{ x | nope }}", "{{ }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.Template(bad)
    with pytest.raises(chat_template.TemplateError):
        run("{{ messages.__class__ }}")
    folded = chat_template.Template("x{{ 'a' ~ 'b' }}{% if false %}{{ messages }}{% endif %}y")
    assert folded.fold_body(chat_template.parse("x{{ 'a' ~ 'b' }}{% if false %}{{ messages }}{% endif %}y")) == [("text", "xaby")]


FRAGMENT = st.sampled_from([*chat_template.CONTROLS, "\\", "<", "|", "[", "INST", "/", "\n", "é", "😀", ">", "a"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>"]), st.lists(FRAGMENT, max_size=8).map("".join)), min_size=1, max_size=5))
def test_template_round_trip(said):
    text, spans = chat_template.Template(chat_template.DEFAULT).render([{"role": r, "text": t} for r, t in said])
    assert chat_template.turns(text) == said
    assert [chat_template.unescape(text[a:b]) for a, b in spans] == [t for r, t in said if r == "assistant"]


def test_chat_edges(spark):
    rows = spark.createDataFrame([(None, 0, None, None, 1), (1, 1, "assistant", "b", 1), (1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, None, "user", "first", 1)], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat_template.read_back(chat_template.formatted(rows)).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(b"user\nfirst\nuser\na\nuser\na\nassistant\nb\n").hexdigest()
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chat_template.read_back(chat_template.formatted(rows.limit(0))).count() == 0


# 6


def test_quality_model(spark):
    got = QUERIES["op6_quality_model"](spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all() and len(got) == 1000


def test_pairwise_identity():
    rng = np.random.default_rng(0)
    m = quality_model.Machine(4, 3)
    m.w[:] = rng.normal(size=len(m.w))
    x = np.zeros(len(m.w))
    bucket, value, z = np.array([1, 3, 7]), rng.normal(size=3), rng.normal(size=(1, quality_model.STATISTICS))
    x[bucket], x[16:] = value, z[0]
    raw = m.raw(np.zeros(3, int), bucket, value, z)[0][0]
    direct = m.w0 + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert raw == pytest.approx(direct)


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1), (10, 0), (None, 1), (7, None)], "doc_id long, quality int")
    machine = quality_model.learn(odd, labels)
    assert quality_model.scored(odd, machine, ("doc_id", "row_key", "text")).filter("score BETWEEN 0 AND 1").count() == odd.count()
    assert quality_model.scored(empty, machine).count() == 0
    assert quality_model.scored(odd, quality_model.learn(odd, labels.limit(0))).filter("score = 0.5").count() == odd.count()


# 7


@pytest.fixture(scope="module")
def ranks():
    return tokens.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoders(ranks):
    return bpe.BlockEncoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "é", "'s", "aaa", "the", "12", "\t", "\u2003", "日本", "!", "ing", "\x1c", " \n", "x "]), max_size=30).map("".join))
def test_units_and_replay(encoders, text):
    block, reference = encoders
    assert "".join(tokens.units(text)) == text
    assert np.frombuffer(block.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=12), st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=20))
def test_replay_of_any_ranks(tokens_, words_):
    """Vocabularies in any order, in which a merge may give rise to a pair of lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens_)}
    want = []
    for w in words_:
        parts = [bytes([b]) for b in w.encode()]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if w.encode() in ranks:
                parts = [w.encode()]
            if not found or w.encode() in ranks:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want.append([ranks[x] for x in parts])
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.MergeReplay(ranks).encode([w.encode() for w in words_])] == want


def test_long_words(ranks):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("a" * 30_000, "ab" * 20_000, "xyzzy" * 3000):
        assert np.frombuffer(bpe.MergeReplay(ranks).encode([text.encode()])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe(spark, sample, ranks):
    got = QUERIES["op7_bpe"](spark, SF).toPandas().set_index("doc_id")
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in zip(sample.doc_id, sample.text):
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        assert (got.loc[i].n_tokens, got.loc[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got.loc[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_texts_without_spaces(ranks, monkeypatch):
    """Units are whole texts there; what a task remembers of them is bounded by characters, and the ids stay the same."""
    rng = np.random.default_rng(9)
    texts = ["".join(chr(0x3042 + int(x)) for x in rng.integers(0, 60, 3000)) for _ in range(40)] + ["短い", "a" * 100, None]
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "MEMO_CHARS", 10_000)
    block = bpe.BlockEncoder(ranks, P.PATTERN, {"known": np.array(reference.encode_ordinary("known"), "<u4").tobytes()})
    for at in range(0, len(texts), 5):
        got = block.encode(texts[at : at + 5])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference.encode_ordinary(t or "") for t in texts[at : at + 5]]
        assert block.numbers.chars <= 10_000


def test_bpe_edges(odd, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.decode(bpe.encode(odd, path, P.PATTERN, keep=("doc_id", "row_key", "text"), table_units=3), path).collect()
    assert len(rows) == odd.count() and all(bytes(r.decoded).decode() == (r.text or "") for r in rows)
    assert bpe.encode(empty, path, P.PATTERN).count() == 0
    assert len(base64.b64encode(bytes(rows[0].ids))) % 4 == 0


# 8


def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub(f"[{SPACE}]", "", text or "")].append((-len(text or ""), i is None, i))
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda body: F.substring(F.sha2(body, 256), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(odd, digest):
    got = exact_dedup.exact_duplicates(odd, digest=digest).collect()
    groups = brute_dedup([(r.doc_id, r.text) for r in odd.collect()])
    best = {i: (min(g)[2], len(g)) for g in groups.values() for _, _, i in g}
    assert len(got) == odd.count() and sum(r.kept for r in got) == len(groups)
    assert all((r.keep_id, r.group_size) == best[r.doc_id] for r in got)


def test_exact_dedup_grows(spark, tmp_path):
    rows = lambda *texts: exact_dedup.rows_for_state(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", "doc_id")
    rows("a", "b", "a").write.parquet(str(tmp_path / "rows"))
    schema = rows("a").schema
    assert {r.group_size for r in exact_dedup.ingest(spark, str(tmp_path / "rows"), schema, str(tmp_path / "state")).collect()} == {2, 1}
    rows("b", "b").write.mode("append").parquet(str(tmp_path / "rows"))
    sizes = exact_dedup.ingest(spark, str(tmp_path / "rows"), schema, str(tmp_path / "state")).collect()
    assert sorted(r.group_size for r in sizes) == [2, 3]


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0


# 9


def brute_fingerprint(text, size=3):
    w = words(text)
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(fps, max_bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints(sample):
    for text in [None, "", "a", "A b", *sample.text[:40]]:
        assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


@pytest.mark.parametrize("max_bits,crowd", [(2, 12), (2, 300), (3, 40), (1, 300), (0, 20)])
def test_links(spark, max_bits, crowd):
    """Random classes, chains of near ones, and a crowd around one point that shares all buckets."""
    rng = np.random.default_rng(max_bits * 1000 + crowd)
    fps = [int(x) for x in rng.integers(0, 2**63, 150)]
    for base in fps[:40]:
        fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    for _ in range(crowd):
        fps.append(fps[0] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
    fps = list(dict.fromkeys(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(signed(x), i) for i, x in enumerate(fps)], "fp long, node long")
    found = {r.node: r.root for r in simhash.components(simhash.links(classes, max_bits)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps, max_bits)


def test_forest_and_pairs():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**20, 400).astype(np.uint64)
    wide = np.stack([fp, np.zeros(400, np.uint64)], axis=1)
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = simhash.forest(wide, 4).tolist()
    for bits in (2, 3, 4):
        for a, b in links:
            if bin(int(fp[a]) ^ int(fp[b])).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
        assert [find(i) for i in range(400)] == brute_components([int(x) for x in fp], bits)
    runs = np.sort(rng.integers(0, 9, 400))
    found = set(zip(*(x.tolist() for x in simhash.pairs_in_runs(runs, wide, np.arange(400), 5))))
    bits = lambda i, j: bin(int(fp[i]) ^ int(fp[j])).count("1")
    assert found == {(i, j, bits(i, j)) for i in range(400) for j in range(i) if runs[i] == runs[j] and bits(i, j) <= 5}


@pytest.mark.parametrize("n", [2, 1000, 10**6, 10**9])
def test_covering_meets_pairs_at_the_limit(n):
    """Random flips at the limit's share leave pairs within a threshold of some partition as often as the plan says."""
    rng = np.random.default_rng(n % 97)
    both = np.full((128, 128), n / 4)
    np.fill_diagonal(both, n / 2)
    flipped = rng.random((20_000, 128)) < simhash.limit_share(0.8)
    met = np.zeros(20_000, bool)
    for group, t in simhash.covering(n, both, simhash.limit_share(0.8), 0.98):
        met |= flipped[:, group].sum(axis=1) <= t
    assert met.mean() > 0.975 and (flipped.sum(axis=1) <= 29).mean() > 0.98


def test_plans_of_nothing():
    nothing = np.zeros((64, 64))
    assert all(simhash.masks(len(g), t) <= simhash.MASKS for n in (0, 1, 10) for r in (2, 10) for g, t in simhash.plan(n, nothing, r))


def test_simhash_op(spark, sample):
    got = QUERIES["op9_simhash"](spark, SF).toPandas().set_index("doc_id").loc[sample.doc_id]
    fps = [brute_fingerprint(t) for t in sample.text]
    assert [int(x, 16) for x in got.fingerprint] == fps
    assert [int(sample.doc_id[i]) for i in brute_components(fps, 2)] == got.component_id.tolist()


def test_simhash_edges(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.fp == 0} == {0}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar_documents(empty).count() == 0


def test_similar_documents(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, truth = [], []
    for g in range(40):
        w = list(rng.choice(vocabulary, 300))
        for c in range(3):
            v = list(w)
            for at in rng.choice(300, 2 * c, replace=False):
                v[at] = str(rng.choice(vocabulary))
            truth.append(3 * g)
            rows.append((len(rows), " ".join(v)))
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(rows))] == truth


def edited(rng, w, vocabulary, how, n):
    """w with n words replaced in a block or appended as a passage, or spread over it."""
    new = [str(x) for x in rng.choice(vocabulary, n)]
    if how == "block":
        at = int(rng.integers(0, len(w) - n))
        return w[:at] + new + w[at + n :]
    if how == "appended":
        return w + new
    out = list(w)
    for at, x in zip(rng.choice(len(w) // 5, n, replace=False) * 5, new):
        out[at] = x
    return out


def test_similar_documents_at_the_limit(spark):
    """Of pairs at Jaccard 0.80 to 0.9 nine tenths at least are linked, pairs at 0.6 to 0.8 never."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, linked = [], {}
    for how, above, below in (("block", range(18, 29), range(32, 55, 2)), ("appended", range(53, 74), range(78, 145, 3)), ("scattered", range(5, 7), range(8, 12))):
        for n in [*above, *below] * 2:
            w = [str(x) for x in rng.choice(vocabulary, 300)]
            v = edited(rng, w, vocabulary, how, n)
            j = len(shingles(w) & shingles(v)) / len(shingles(w) | shingles(v))
            assert 0.6 < j < 0.9
            linked[len(rows)] = (how, n, j, j >= 0.8)
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    right = [found[i + 1] == i for i, x in linked.items() if x[3]]
    assert len(right) > 60 and sum(right) >= 0.9 * len(right)
    below = [found[i + 1] == i for i, x in linked.items() if not x[3]]
    assert len(below) > 60 and not any(below)


def test_a_crowd_gets_pivots(spark, monkeypatch):
    """A crowd of near copies of one text, and pairs beside it, with crowds of 30 counting as such."""
    monkeypatch.setattr(simhash, "CROWD", 30)
    monkeypatch.setattr(simhash, "OVER", 1)
    monkeypatch.setattr(simhash, "RUN", 50)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [str(x) for x in rng.choice(vocabulary, 300)]
    rows = [edited(rng, base, vocabulary, "block", int(rng.integers(1, 12))) for _ in range(200)]
    for _ in range(20):
        w = [str(x) for x in rng.choice(vocabulary, 300)]
        rows += [w, edited(rng, w, vocabulary, "block", 10)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()}
    assert all(found[i] == 0 for i in range(200)) and all(found[i] == i - i % 2 for i in range(200, 240))


def test_a_crowd_loses_no_links(spark, monkeypatch):
    """Near copies of one text of all degrees, most pairs below the limit: the same components as all pairs give, whatever the blocks."""
    rng = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [str(x) for x in rng.choice(vocabulary, 120)]
    rows = [edited(rng, base, vocabulary, "scattered", int(rng.integers(1, 14))) for _ in range(500)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = [find(i) for i in range(len(rows))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "PAIRS", 1)
    monkeypatch.setattr(simhash, "UNIT_ROWS", 90)
    for unit_bytes in (simhash.UNIT_BYTES, 0):
        monkeypatch.setattr(simhash, "UNIT_BYTES", unit_bytes)
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
        assert 100 < len(set(want)) < 450
        assert all(want[i] == want[c] for i, c in found.items())  # nothing is joined that all pairs keep apart
        assert len(set(found.values())) <= len(set(want)) + 2


def test_recall_on_the_tables(spark):
    """Every pair of documents at the limit or above is in one component, and no component joins what all pairs keep apart."""
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    sets = {i: {tuple(w[k : k + 5]) for w in [words(t)] for k in range(max(1, len(w) - 4))} for i, t in rows if words(t)}
    by_shingle = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    shared = collections.Counter((a, b) for ids in by_shingle.values() for k, a in enumerate(ids) for b in ids[:k])
    alike = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in alike:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(alike) >= 3 and all(found[a] == found[b] for a, b in alike)
    assert all(find(i) == find(found[i]) for i in sets)


def test_similar_documents_repeats_and_ids(spark):
    """A much repeated passage doesn't make texts alike; rows with one doc_id stay apart."""
    rng = np.random.default_rng(12)
    fresh = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    passage = fresh(12)
    rows = [(i, " ".join([passage] * 60) + " " + fresh(80)) for i in range(6)] + [(50, fresh(90)), (50, fresh(90))]
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.component for r in found}) == 8


# 10


def test_quality_rules(spark, sample):
    got = QUERIES["op10_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    for i, text in [*zip(sample.doc_id, sample.text)]:
        w, seen, doubled = words(text, lower=False), set(), 0
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        for line in (text or "").split("\n"):
            if re.search(f"[^{SPACE}]", line):
                doubled += line in seen
                seen.add(line)
        row = got.loc[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(covered))
        assert row.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (row.base_failed and row.kept)


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "spam " * 80
    rows = [(i, good if h != "bad" or i % 10 == 0 else bad, h) for i in range(400) for h in ("a", "b", "bad")]
    rows += [(9999, good, None), (10000, bad, "tiny")]
    got = quality_rules.rated(spark.createDataFrame(rows, "doc_id long, text string, source string"), ("doc_id", "source")).collect()
    verdicts = {(r.source, r.base_failed): r.kept for r in got}
    assert verdicts[("a", False)] and verdicts[("b", False)] and verdicts[(None, False)] and not verdicts[("bad", False)]
    assert [r.host_failed for r in got if r.source == "tiny"] == [False]  # one document says little of its host


def test_rules_edges(odd, empty):
    got = quality_rules.rated(odd, ("doc_id", "row_key", "block")).collect()
    assert len(got) == odd.count() and {r.n_words for r in got if r.doc_id in (0, 1, 2)} == {0} and quality_rules.rated(empty).count() == 0


def test_a_crowd_is_tested_on_its_sets_alone(spark):
    """Pairs at the limit count whatever their fingerprints, also of members that none is near: against all pairs of random sets."""
    rng = np.random.default_rng(8)
    base = rng.choice(1 << 20, 40, replace=False).astype(np.int32)
    sets = [np.unique(np.concatenate([rng.choice(base, 36, replace=False), rng.choice(1 << 20, int(rng.integers(0, 8))).astype(np.int32)])) for _ in range(120)] + [np.zeros(0, np.int32)]
    pairs = {(i, j) for i in range(len(sets)) for j in range(i) if len(s := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(s)) - 1e-9 and len(s)}

    def roots(links):
        edges = spark.createDataFrame(sorted(links), "a long, b long")
        return {(r.node, r.root) for r in simhash.components(edges).collect()}

    assert 50 < len(pairs) < 5000
    crowd = spark.createDataFrame([(7, len(sets), i) for i in range(len(sets))], "spot long, size long, node long")
    given = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "row_key long, shingles array<int>")
    none = spark.createDataFrame([], "node long, root long")
    assert roots(tuple(r) for r in simhash.crowd_links(crowd, none, given, 0.8).collect()) == roots(pairs)


def test_a_unit_of_long_sets_stays_small():
    """Memory follows the members, not sets times different members; whatever is common, the components are those of all pairs."""
    import tracemalloc

    rng = np.random.default_rng(9)
    page = rng.choice(1 << 20, 200, replace=False)
    sets = [np.unique(rng.integers(-(1 << 31), 1 << 31, 600)) for _ in range(900)]
    sets += [np.unique(np.concatenate([page, x[: 10 + i // 2]])) for i, x in enumerate(sets[:60])]  # alike by common members alone, some pairs above the limit
    sets += [np.concatenate([x[: 600 - k], np.arange(k) - k * 1000]) for k, x in zip(range(30, 130), sets[100:200])]  # Jaccard 0.90 down to 0.65
    sets = [x.astype(np.int32) for x in (*sets, np.zeros(0))]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (len(sets[i]) < 300 or j == i - 960 + 100) and (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9 and n]

    def roots(links):
        root = list(range(len(sets)))
        for a, b in links:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        return root

    node, flat, sizes = np.arange(len(sets)), np.concatenate(sets), np.array([len(x) for x in sets])
    for side in (np.zeros(len(sets), int), node % 2):
        tracemalloc.start()
        links = simhash.links_in_unit(side, node.copy(), node, flat, sizes, 0.8)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 * len(flat)  # the sets as bits: 900 and more a member
        assert roots(links) == roots([x for x in pairs if len(set(side)) == 1 or side[x[0]] != side[x[1]]])
    assert 80 < len(pairs) < 2000


def test_blocks_of_a_crowd_by_members(spark, monkeypatch):
    """A crowd of few rows with long sets is dealt out to more blocks than one of short sets, and loses no link by it."""
    rng = np.random.default_rng(10)
    base = rng.choice(1 << 20, 300, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, 280, replace=False), rng.choice(1 << 20, int(rng.integers(0, 30)))])) for _ in range(60)]
    pairs = {(i, j) for i in range(len(sets)) for j in range(i) if len(s := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(s)) - 1e-9}
    crowd = spark.createDataFrame([(7, len(sets), i) for i in range(len(sets))], "spot long, size long, node long")
    given = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "row_key long, shingles array<int>")
    none = spark.createDataFrame([], "node long, root long")
    roots = lambda links: {(r.node, r.root) for r in simhash.components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    counts = []
    for members in (simhash.UNIT_MEMBERS, 2000):
        monkeypatch.setattr(simhash, "UNIT_MEMBERS", members)
        links = [tuple(r) for r in simhash.crowd_links(crowd, none, given, 0.8).collect()]
        assert roots(links) == roots(pairs)
        counts.append(len(links))
    assert counts[0] == len(sets) - 1 < counts[1]  # a tree in one block; more where blocks don't know of each other


def test_bpe_decodes_in_one_process(spark):
    """Ids and bytes of one pass are those of encode and decode one after the other, and the plan has a Python step less."""
    import public_tokenizers

    from siftline.llm import bpe

    path, texts = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ["", None, "aé b" * 50, "x" * 3000, "one two\n two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    apart = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    assert sorted(map(tuple, both.collect()), key=lambda r: r[0]) == sorted(map(tuple, apart.collect()), key=lambda r: r[0])
    assert {r.doc_id: bytes(r.decoded) for r in both.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert [x._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for x in (both, apart)] == [1, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "é", " ", "  ", "\n", "\x00", "\x1c", "\x85", "\xa0", "«", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u2060", "“", "\u3000", "日", " \xa0", " “", " \u3000"]), max_size=12).map("".join) | st.none(), max_size=8), st.integers(0, 3))
def test_units_over_bytes(texts, skipped):
    """The cuts of Arrow buffers are those of each text, in slices too."""
    found, ends = bpe.stretches(pa.array(texts, pa.string()).slice(skipped))
    got, ends = found.to_pylist(), [0, *ends.tolist()]
    assert [got[a:b] for a, b in zip(ends, ends[1:])] == [tokens.units(t or "") for t in texts[skipped:]]


@pytest.mark.parametrize("step", [1, 3, 50, 1 << 12])
def test_replay_takes_many_ranks_at_once(ranks, monkeypatch, step):
    """The replay looks pairs up for thousands of places at once, not rank by rank, and the ids don't depend on how many."""
    rng = np.random.default_rng(4)
    words_ = ["".join("etaoinshrdlu"[i] for i in rng.integers(0, 12, n)) for n in rng.integers(2, 12, 3000)] + ["ab" * 500, "aaa" * 333]
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "STEP_PAIRS", step, raising=False)
    replay, looks = bpe.MergeReplay(ranks), []
    monkeypatch.setattr(replay, "joined", lambda left, right: looks.append(len(left)) or bpe.MergeReplay.joined(replay, left, right))
    assert [np.frombuffer(x, "<u4").tolist() for x in replay.encode([w.encode() for w in words_])] == [reference.encode_ordinary(w) for w in words_]
    if step == 1 << 12:
        assert len(looks) < 300, len(looks)  # rank by rank: over 2,000


def test_pattern_that_leaves_characters_out(ranks):
    """What the pattern doesn't match has no ids, whichever unit it stands in."""
    texts = ["ab 12 cd", " 34", "ef5 gh", None, "", "12"]
    block, letters = bpe.BlockEncoder(ranks, r" ?[a-z]+"), tiktoken.Encoding("own", pat_str=r" ?[a-z]+", mergeable_ranks=ranks, special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in block.encode(texts)] == [letters.encode_ordinary(t or "") for t in texts]


def test_counted_units(spark):
    """Counts are whole however often a task sums them and hands them on; units of more than TABLE_CHARS characters are left out."""
    texts = [None, "", " ", "a b  c", "a b", "é " * 70, "x" * 65 + " " + "é" * 63] * 5
    want = collections.Counter(u for t in texts for u in tokens.units(t or "") if len(u) <= 64)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_a_batch)
    spark.conf.set(rows_a_batch, "2")
    try:
        for limits in ((1 << 20, 1 << 20), (0, 1 << 20), (0, 5), (0, 0)):
            assert {r.unit: r.n for r in bpe.counted(docs, *limits).collect()} == want
    finally:
        spark.conf.set(rows_a_batch, before)


def test_replay_of_equal_pairs_side_by_side():
    """cb cb: once the first is merged, cbc comes before the second."""
    ranks_ = {bytes([b]): b for b in range(256)} | {b"cbc": 256, b"cb": 257}
    replay = bpe.MergeReplay(ranks_)
    assert [np.frombuffer(x, "<u4").tolist() for x in replay.encode([b"cbcb", b"cbcbcb"])] == [[256, 98], [256, 98, 257]]

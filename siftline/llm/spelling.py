"""Spelling variant grouping: words of a corpus's vocabulary at distance one, by a trie self-join over a partitioned trie.

Two words at distance one (one code point inserted, deleted or replaced) differ in one place, so with m the shorter one's length they agree in their first
m // 2 code points or in their last m - m // 2. So the vocabulary's trie is partitioned by prefix for differences in the second half of words,
and by suffix for those in the first half; a partition (a unit) holds the words of length m and m + 1 that agree outside a window. A
unit with more than UNIT_WORDS words is partitioned again by a longer prefix, or by prefix and suffix, so that its window halves, until it is small or its
window is a single code point, where the alphabet bounds it. So no prefix or suffix that many words share gathers them in one task, and the rounds are the logarithm of
the longest word.

In a unit, a trie of what stands in the window is walked from its root: each node passes on to its children the set of nodes at distance one
from it (its active nodes; the node itself is the only one at distance zero). Pairs of ends of words in a set are near words. A
pair that agrees in the first and in the last half is given by the unit of the prefix alone.

Edge cases: a null text has no words, a null doc_id counts as empty text; repeated rows count each; an empty vocabulary gives no rows; words of any length
and any code points are handled alike; further columns aren't looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import WORD_BYTES, documents, slices, small, stored

#: Words of at least LETTERS code points that occur LEAST times; a form occurs TIMES as often as its variants.
LETTERS, LEAST, TIMES = 6, 5, 5
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LETTERS)
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
#: Every SLIPth run (by hash) lacks a code point, as a misspelling whose form is known.
SLIP = 199
UNIT_WORDS = 2048
#: Distinct words that a task counts before it hands on what it has.
HELD_WORDS = 150_000
UNIT = ("m", "i", "j", "upto", "pre", "suf")


def slipped(ident: str, run: str) -> str:
    """The run as it counts for this document."""
    h = zlib.crc32(f"{ident}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least: int = LEAST, slip=slipped) -> DataFrame:
    """word, n of the words of all whole texts. slip(id as text, run) gives what a run counts as. Shorter runs cannot become words."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("ident"), F.coalesce("text", F.lit("")).alias("text"))

    def flush(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches):
        counts: Counter = Counter()
        for part in slices(batches, "text", WORD_BYTES):
            for ident, text in zip(part.column("ident").to_pylist(), part.column("text").to_pylist()):
                for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
                    counts[slip(ident, run)] += n
                if len(counts) > HELD_WORDS:
                    yield flush(counts)
                    counts.clear()
        if counts:
            yield flush(counts)

    sums = rows.mapInArrow(count, "word string, n long").filter(F.length("word") >= LETTERS).groupBy("word").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= least)


def units(words: DataFrame) -> DataFrame:
    """word, n and a unit's key for each unit in which a word may meet another: m (length of the shorter), i and j (agreeing prefix and suffix), upto (pairs that agree further are met elsewhere)."""
    size = F.length("word")

    def halves(m):
        h = F.floor(m / 2).cast("int")
        one = lambda i, j, upto: F.struct(m.alias("m"), i.cast("int").alias("i"), j.cast("int").alias("j"), upto.cast("int").alias("upto"))
        return [one(h, F.lit(0), m + 2), one(F.lit(0), m - h, h)]

    windows = F.filter(F.array(*halves(size), *halves(size - 1)), lambda w: w["m"] >= LETTERS)
    return keyed(words.select("word", "n", F.inline(windows)))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pre", F.expr("substring(word, 1, i)")).withColumn("suf", F.expr("right(word, j)"))


def halved(rows: DataFrame) -> DataFrame:
    """Rows of units that are too large, in units with half the window."""
    half = F.expr("(m - i - j) div 2").cast("int")
    left = F.struct((F.col("i") + half).alias("i"), F.col("j"), F.col("upto"))
    right = F.struct(F.col("i"), (F.col("m") - F.col("i") - half).alias("j"), F.least(F.col("upto"), F.col("i") + half).alias("upto"))
    return keyed(rows.select("word", "n", "m", F.inline(F.array(left, right))))


def small_units(words: DataFrame, most: int) -> DataFrame:
    rows, done = units(words), None
    while True:
        rows = stored(rows, "units")
        large = stored(rows.filter("m - i - j > 1").groupBy(*UNIT).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most).select(*UNIT), "large-units")
        if not large.limit(1).count():
            return rows if done is None else done.unionByName(rows)
        large = small(large)
        kept = rows.join(large, list(UNIT), "left_anti")
        done = kept if done is None else done.unionByName(kept)
        rows = halved(rows.join(large, list(UNIT), "left_semi"))


def common_prefix(a: str, b: str) -> int:
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return min(len(a), len(b))


def near_in_unit(words: list[str], m: int, i: int, j: int, upto: int) -> dict[int, list[int]]:
    """For each word (by place) the places of the words at distance one, less pairs that agree in their first `upto` code points and pairs of two longer words."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for at, word in enumerate(words):
        node = 0
        for c in word[i : len(word) - j]:
            below = children[node].get(c)
            if below is None:
                below = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = below
        ends[node] = at
    found: dict[int, list[int]] = {}
    open_ = [(0, set(children[0].values()))]
    while open_:
        node, active = open_.pop()
        at = ends[node]
        if at >= 0:
            a = words[at]
            near = [o for o in (ends[x] for x in active) if o >= 0 and len(a) + len(words[o]) <= 2 * m + 1 and (upto > m or common_prefix(a, words[o]) < upto)]
            if near:
                found[at] = near
        for c, below in children[node].items():
            reached = {children[x][c] for x in active if c in children[x]}  # c follows on both sides
            reached.update(children[node].values())  # c replaced
            reached.update(children[below].values())  # one more after c
            reached.add(node)  # c left out
            reached.discard(below)
            open_.append((below, reached))
    return found


def near_words(words: DataFrame, most: int = UNIT_WORDS) -> DataFrame:
    """word, n_near, best (near word of largest n, the first by code point) and best_n of each word that has near words."""
    rows = small_units(words, most).repartition(*UNIT).sortWithinPartitions(*UNIT, "word")

    def groups(batches):
        now, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*UNIT, "word", "n")]
            for *key, word, n in zip(*columns):
                if key != now:
                    if len(held) > 1:
                        yield now, held
                    now, held = key, []
                held.append((word, n))
        if len(held) > 1:
            yield now, held

    def run(batches):
        out: list[tuple] = []
        for (m, i, j, upto, _, _), held in groups(batches):
            for at, near in near_in_unit([w for w, _ in held], m, i, j, upto).items():
                best = min(near, key=lambda o: (-held[o][1], held[o][0]))
                out.append((held[at][0], len(near), -held[best][1], held[best][0]))
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["word", "n_near", "less", "best"])

    parts = rows.mapInArrow(run, "word string, n_near long, less long, best string")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root from (word, form) without rings: each round doubles the distance that is looked ahead."""
    state = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = small(state.select(F.col("word").alias("root"), F.col("root").alias("next")))
        state = stored(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not state.filter("moved").limit(1).count():
            return state.select("word", "root")
        state = state.drop("moved")


def variants(words: DataFrame, times: int = TIMES, most: int = UNIT_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n)."""
    words = stored(words, "vocabulary")
    near = words.join(near_words(words, most), "word", "left")
    common = F.col("best_n") >= times * F.col("n")
    known = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n")), "forms")
    return known.join(roots(known.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(documents(spark, sf_dir)))


ORACLE_OP12 = r"""
WITH RECURSIVE polynomial AS (
  SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS t(i))
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS ident, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents
), counted AS (
  SELECT ident, run, count(*) AS n, list_concat([ascii(x)::BIGINT FOR x IN string_split(ident || ':', '')], flatten([CASE WHEN ascii(x) < 128 THEN [ascii(x)::BIGINT] ELSE [195, ascii(x)::BIGINT - 64] END FOR x IN string_split(run, '')])) AS bytes FROM runs GROUP BY ident, run
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda r, b: xor(crcs[xor(r, b) % 256 + 1], r // 256)), 4294967295) AS h FROM counted, polynomial
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
  SELECT DISTINCT word, i, left(word, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, v FROM less JOIN (SELECT word AS w FROM words) ON v = w UNION SELECT v, word FROM less JOIN (SELECT word AS w FROM words) ON v = w
), near AS (
  SELECT a, count(*) AS n_near, arg_min(b, row(-n, b)) AS best, max(n) AS best_n FROM pairs JOIN words ON b = word GROUP BY a
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM words LEFT JOIN near ON a = word
), steps AS (
  SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL
)
SELECT f.word, n, n_near, form, form_n, r.root FROM forms f JOIN (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word) r ON r.word = f.word
"""

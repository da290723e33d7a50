"""Quality rules of documents and verdicts on their hosts.

Each document is measured alone, then rule failures are summed by host (the `source` column; null is a host of its own). A host's
failure rate is shrunk towards all hosts' by a beta prior whose mean and strength come from the hosts themselves (moments of
their rates, less what binomial noise explains). Documents of a host whose shrunk rate is above `host_limit` go, as do documents that
fail a base rule. Hosts are pre-aggregated before they meet, and the verdicts that reject are joined back: broadcast if
they are at most HOST_ROWS, else by shuffle, where adaptive execution splits hot hosts.

Edge cases: null and empty texts have no words and fail; null sources form one host; repeated rows count each; one host alone gets
the weakest prior; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import added, byte_class, documents, marks_by_text, named, starts_of, stored, utf8, words_of

SYMBOLS = byte_class(b"#*$%&|<>")
WHITE = byte_class(b" \t\n\x0b\x0c\r")
#: Rejecting verdicts up to this many are broadcast.
HOST_ROWS = 100_000
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


class Codes(dict):
    """Numbers words from 0 as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def classes(keys: np.ndarray) -> np.ndarray:
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)


def repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    found = classes(keys)
    return np.bincount(found)[found] > 1 if len(found) else np.zeros(0, bool)


def repeat_words(codes: np.ndarray, lengths: np.ndarray, window: int = 3) -> np.ndarray:
    """Words of each text in windows that the text has twice or more."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(codes)) + window <= np.repeat(starts_of(lengths) + lengths, lengths)
    at = np.flatnonzero(inside)
    key = text[at]
    for i in range(window):
        # Renumbered each time, so that the next product stays within 64 bits.
        key = classes(key * np.int64(codes.max() + 1 if len(codes) else 1) + codes[at + i])
    twice = at[repeats(key)]
    covered = np.zeros(len(codes), bool)
    for i in range(window):
        covered[twice + i] = True
    return marks_by_text(covered, np.concatenate(([0], np.cumsum(lengths))))


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and how many of them equal an earlier line, by text."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    text = pc.list_parent_indices(lines).to_numpy()
    found = pc.list_flatten(lines).dictionary_encode()
    worded = pc.match_substring_regex(found.dictionary, "[^ \t-\r]").to_numpy(zero_copy_only=False) if len(found.dictionary) else np.zeros(0, bool)
    code = found.indices.to_numpy()
    keep = worded[code]
    key = np.unique(text[keep].astype(np.int64) * max(1, len(worded)) + code[keep])
    n = np.bincount(text[keep], minlength=len(texts))
    return n, n - np.bincount(key // max(1, len(worded)), minlength=len(texts))


def measures(texts: pa.Array) -> list[np.ndarray]:
    flat, offsets = utf8(texts)
    symbols = marks_by_text(SYMBOLS[flat], offsets)
    chars = marks_by_text(~WHITE[flat] & ((flat & 0xC0) != 0x80), offsets)
    codes, words = Codes(), [words_of(t, lower=False) for t in texts.to_pylist()]
    lengths = np.array([len(w) for w in words], np.int64)
    get = codes.__getitem__
    flat_codes = np.fromiter((get(x) for w in words for x in w), np.int64, int(lengths.sum()))
    lines, doubled = duplicate_lines(texts)
    return [np.asarray(x, np.int64) for x in (lengths, chars, symbols, lines, doubled, repeat_words(flat_codes, lengths))]



def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed():
    """Any rule, the stricter ones that count against the host alone included."""
    return base_failed() | (10 * F.col("n_symbols") > F.col("word_chars")) | (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))


def bad_hosts(rows: DataFrame, host_limit: float, host_col: str = "host", least_strength: float = 2.0, most_strength: float = 1e4) -> DataFrame:
    """(host, no_host, rate) of the hosts to reject. rows: measured documents."""
    by_host = rows.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(rule_failed().cast("long")).alias("f"))
    hosts = stored(by_host, "hosts")
    n, f, squares, k = hosts.agg(F.sum("n"), F.sum("f"), F.sum(F.col("f") * F.col("f") / F.col("n")), F.count(F.lit(1))).first()
    mean = (f + 0.5) / (n + 1) if n else 0.5
    # Between-host variance of the rates, weighted by documents, without binomial noise (k hosts' worth of it).
    spread = max((squares - n * mean * mean - k * mean * (1 - mean)) / n, 0.0) if n else 0.0
    strength = min(max(mean * (1 - mean) / spread - 1 if spread > 0 else most_strength, least_strength), most_strength) if k and k > 1 else least_strength
    rate = (F.col("f") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select(F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), rate.alias("rate")).filter(F.col("rate") > host_limit)


def judged(rows: DataFrame, bad: DataFrame, host_col: str = "host") -> DataFrame:
    """rows with base_failed, host_failed and kept."""
    bad = stored(bad.select("host", "no_host"), "bad-hosts").select(F.col("host").alias("__host"), F.col("no_host").alias("__no_host"), F.lit(True).alias("__bad"))
    if bad.limit(HOST_ROWS + 1).count() <= HOST_ROWS:
        bad = F.broadcast(bad)
    same = (F.coalesce(F.col(host_col).cast("string"), F.lit("")) == F.col("__host")) & (F.col(host_col).isNull() == F.col("__no_host"))
    out = rows.join(bad, same, "left").withColumn("base_failed", base_failed()).withColumn("host_failed", F.col("__bad").isNotNull())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("__host", "__no_host", "__bad")


def rated(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", host_col: str = "source", host_limit: float = 0.6) -> DataFrame:
    """The kept columns, the measures, base_failed, host_failed and kept. Each text is measured once; the measures are stored."""
    rows = added(docs, text_col, (*keep, host_col), MEASURES, lambda: measures)
    rows = stored(rows.withColumnRenamed(f"k{len(keep)}", "host"), "measures")  # a few numbers a document
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return named(judged(rows, bad_hosts(rows, host_limit)), keep, *names, "base_failed", "host_failed", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rated(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


ORACLE_OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), grams AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), covered AS (
  SELECT DISTINCT k, i + o AS at FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM grams), (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1
), repeated AS (SELECT k, count(*) AS n FROM covered GROUP BY k
), lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k
), m AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (k) LEFT JOIN repeated USING (k) LEFT JOIN lines USING (k)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), r AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 100 * n_dup_lines > 30 * n_lines AS failed FROM b
), hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM r GROUP BY source
), totals AS (SELECT sum(n) AS n, sum(f) AS f, sum(f * f / n) AS squares, count(*) AS k, (sum(f) + 0.5) / (sum(n) + 1) AS mean FROM hosts
), prior AS (
  SELECT mean, k, greatest((squares - n * mean * mean - k * mean * (1 - mean)) / n, 0) AS spread FROM totals
), strong AS (
  SELECT mean, CASE WHEN k <= 1 THEN 2.0 WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 2.0), 1e4) ELSE 1e4 END AS strength FROM prior
), bad AS (SELECT source FROM hosts, strong WHERE (f + mean * strength) / (n + strength) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM r.source) AS kept,
  EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM r.source) AS host_failed
FROM r
"""

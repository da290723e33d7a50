"""Search by meaning: cheap lexical ranking first, then ever fewer candidates go to a pluggable judge.

Waves depend on each other, so each feeds the next; every wave's size is a constant, whatever the corpus. A wave is a relation of requests, whose entries have
keys, and a relation of answers by request and key, stored, so that no judge is asked twice. Answers may come in any order, and some or all may be
missing; what a judge raises is kept as the answer of its request.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.fixed_values import CANDIDATES, CUTOFF, FAILURES_KEPT, FILE_BYTES, FULL_LIMIT, NAME_BATCH, PASSAGES_A_REQUEST, READ_BYTES, READ_FILES, SKETCH_CARDS, THRESHOLD
from siftline.functions.text import line_array
from siftline.operators import lexical
from siftline.sources.scratch import stored
from siftline.sources.tree import bounded

#: Takes (question, text) pairs and gives a probability or None for each.
Judge = Callable[[list[tuple[str, str]]], list[float | None]]
#: Takes the question and texts by key and gives probabilities by key.
KeyedJudge = Callable[[str, dict[str, str]], Mapping[str, float | None]]
ANSWERS = "request long, key string, p double, failure string"


class JudgeFailed(RuntimeError):
    """Every request failed, so nothing was judged."""


def lexical_judge(pairs: list[tuple[str, str]]) -> list[float | None]:
    """Default judge: the share of the question's words that the text has, a little more for repetition. Deterministic."""
    out: list[float | None] = []
    for question, text in pairs:
        words, low = lexical.keywords(question), text.lower()
        hits = [low.count(w) for w in words]
        share = sum(h > 0 for h in hits) / len(words) if words else 0.0
        out.append(min(1.0, 0.9 * share + 0.1 * share * math.tanh(sum(hits) / 10)))
    return out


def probability(p: Column) -> Column:
    """p if it is one, else null."""
    return F.when(~F.isnan(p) & p.between(0.0, 1.0), p)


def by_key(judge: Judge) -> KeyedJudge:
    """A judge of pairs as one of keyed entries: its answers are taken in order."""
    return lambda question, entries: dict(zip(entries, judge([(question, text) for text in entries.values()])))


def requests(rows: DataFrame, batch: int, order: list[Column], letter: str, digits: int) -> DataFrame:
    """rows with the request that they go with (`batch` rows each) and their key in it. For a wave's few hundred rows."""
    at = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn("__at", at).withColumn("request", F.floor(F.col("__at") / batch)).withColumn("key", F.format_string(f"{letter}%0{digits}d", F.col("__at") % batch)).drop("__at")


def answers(asked: DataFrame, text: str, question: str, judge: KeyedJudge) -> DataFrame:
    """request, key, p, failure: a row for each key that was answered, in parallel by request; of a request that failed one row with its message."""

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["request"].iloc[0])
        try:
            got = {str(k): None if p is None else float(p) for k, p in judge(question, dict(zip(frame["key"], frame["text"]))).items()}
        except Exception as wrong:  # a judge is outside code: its failure costs its answers, not the search
            return pd.DataFrame({"request": [number], "key": [None], "p": [float("nan")], "failure": [str(wrong) or type(wrong).__name__]})
        if not got:
            return pd.DataFrame()  # Spark takes no rows only without columns
        return pd.DataFrame({"request": [number] * len(got), "key": list(got), "p": [float("nan") if p is None else p for p in got.values()], "failure": [None] * len(got)}, columns=["request", "key", "p", "failure"])

    return asked.select("request", "key", F.col(text).alias("text")).groupBy("request").applyInPandas(ask, ANSWERS)


def answered(asked: DataFrame, given: DataFrame) -> DataFrame:
    """The rows asked for, with p: null where no probability was given. Keys that were not asked for are left aside; of repeated ones the largest p counts."""
    known = given.filter("key IS NOT NULL").withColumn("p", probability(F.col("p"))).groupBy("request", "key").agg(F.max("p").alias("p"))
    return asked.join(known, ["request", "key"], "left")


def unanswered(asked: DataFrame, given: DataFrame) -> DataFrame:
    """The rows asked for that got no probability."""
    return asked.join(given.filter(probability(F.col("p")).isNotNull()), ["request", "key"], "left_anti")


@dataclass
class Outcome:
    """What a search found, and how the judge fared: failures is (phase, message), FAILURES_KEPT distinct ones at most, the first ones."""

    rows: DataFrame
    failures: DataFrame
    requests: int
    errors: int
    judged: int

    def checked(self) -> DataFrame:
        """The rows; JudgeFailed where requests failed and nothing was judged."""
        if self.errors and not self.judged:
            raise JudgeFailed("; ".join(f"{r.phase}: {r.message}" for r in self.failures.collect()))
        return self.rows


def ledger(waves: list[tuple[str, DataFrame]]) -> DataFrame:
    """phase, message of the first FAILURES_KEPT distinct failures of the waves' answers."""
    every = [given.filter("failure IS NOT NULL").select(F.lit(i).alias("wave"), F.lit(phase).alias("phase"), F.col("failure").alias("message"), "request") for i, (phase, given) in enumerate(waves)]
    failed = every[0]
    for more in every[1:]:
        failed = failed.unionByName(more)
    first = failed.groupBy("phase", "message").agg(F.min(F.struct("wave", "request")).alias("first"))
    return first.orderBy("first", "message").limit(FAILURES_KEPT).select("phase", "message")


def cascade(files: DataFrame, question: str, judge: KeyedJudge, extra: tuple[str, ...] = (), frecency: DataFrame | None = None) -> Outcome:
    """rows: path, score (best p), ranges (start, stop, p, snippet; best first), lines_seen, truncated (not all lines were seen) of the files that answer. Never raises for a judge."""
    words = lexical.keywords(question, extra)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    listed = files.filter(lexical.eligible(F.col("path"), size) & (size <= FILE_BYTES))
    counts = stored(lexical.keyword_counts(listed, words))
    weights = lexical.idf(counts, words)
    waves: list[tuple[str, DataFrame]] = []
    n_requests = 0

    def wave(phase: str, rows: DataFrame, text: str, batch: int, order: list[Column], letter: str, digits: int) -> DataFrame:
        nonlocal n_requests
        asked = stored(requests(rows, batch, order, letter, digits))
        given = stored(answers(asked, text, question, judge))
        n_requests += int(asked.agg(F.count_distinct("request")).first()[0])
        waves.append((phase, given))
        return answered(asked, given).drop("request", "key")

    shortlist = lexical.lexical_scores(counts, words, weights).orderBy(F.desc("lex"), "path").limit(CANDIDATES)
    named = wave("names", shortlist, "path", NAME_BATCH, [F.desc("lex"), F.asc("path")], "e", 3)
    # The two best by words are read whatever their names say.
    by_lex = F.row_number().over(Window.orderBy(F.desc("lex"), "path"))
    chosen = named.withColumn("head", F.when(by_lex <= 2, 0).otherwise(1)).orderBy("head", F.desc(F.coalesce("p", F.lit(0.0))), F.desc("lex"), "path").limit(READ_FILES)
    texts = listed.join(F.broadcast(chosen.select("path", "lex")), "path")  # READ_FILES rows
    texts = stored(texts.select("path", bounded(F.col("text").cast("binary"), READ_BYTES).alias("r")).filter("r.status = 'text'").select("path", "r.text", "r.truncated", F.size(line_array(F.col("r.text"))).alias("n_lines")))
    windows = lexical.selected_windows(lexical.passages(texts.select("path", "text"), words, weights))
    cards = wave("sketches", lexical.sketches(windows, words, weights), "sketch", SKETCH_CARDS, [F.desc("score"), F.asc("path"), F.asc("start")], "p", 2)
    # Without an answer a passage stays in: better to read it in vain than to miss it.
    cards = cards.withColumn("p", F.coalesce("p", F.lit(1.0))).filter(F.col("p") >= CUTOFF)
    full = cards.orderBy(F.desc("p"), F.desc("score"), "path", "start").limit(FULL_LIMIT).drop("p", "sketch")
    read = wave("passages", full, "text", PASSAGES_A_REQUEST, [F.asc("path"), F.asc("start")], "p", 2).filter("p IS NOT NULL")
    snippet = F.regexp_extract(F.regexp_replace("text", r"(?m)^L\d+\| ", ""), r"\S.*", 0)
    heat = lexical.merged_heat(read.select("path", "start", "stop", "p", F.substring(snippet, 1, 120).alias("snippet")), THRESHOLD)
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("less"), "start", "stop", "snippet")))
    ranges = heat.groupBy("path").agg(F.max("p").alias("score"), F.transform(best_first, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"), (-r["less"]).alias("p"), r["snippet"].alias("snippet"))).alias("ranges"))
    seen = read.groupBy("path").agg(F.sum(F.col("stop") - F.col("start") + 1).alias("lines_seen"))
    whole = texts.select("path", F.col("truncated").alias("cut"), "n_lines")
    out = ranges.join(seen, "path").join(whole, "path").filter(F.col("score") >= THRESHOLD).withColumn("truncated", F.col("cut") | (F.col("lines_seen") < F.col("n_lines"))).drop("cut", "n_lines")
    if frecency is None:
        out = out.orderBy(F.desc("score"), "path")
    else:
        known = out.join(frecency.select("path", "frecency"), "path", "left")
        out = known.orderBy(F.desc("score"), F.desc(F.coalesce("frecency", F.lit(0.0))), "path")
    fared = [given.agg(F.count_if(F.col("failure").isNotNull()), F.count_if(probability(F.col("p")).isNotNull())).first() for _, given in waves]
    return Outcome(out, ledger(waves), n_requests, sum(x[0] for x in fared), sum(x[1] for x in fared))


def search(files: DataFrame, question: str, judge: Judge = lexical_judge, extra: tuple[str, ...] = (), frecency: DataFrame | None = None) -> DataFrame:
    """The rows of `cascade`."""
    return cascade(files, question, by_key(judge), extra, frecency).rows

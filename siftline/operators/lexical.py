"""Ranking of files by the words of a question, and byte-bounded passages of their texts."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.fixed_values import (
    BINARY_EXTENSIONS, DENIED_DIRS, DENIED_FILES, ENV_TEMPLATES, IDF_LEAST, IDF_MOST, SECRET_EXTENSIONS, SECRET_FILES, SKETCH_BYTES, SKETCH_LEAST,
    SKETCH_MOST, SKETCH_OVERHEAD, STOPWORDS, SUFFIXES, WINDOW_BYTES, WINDOWS,
)
from siftline.functions.text import base_name, line_array, occurrences, quoted, row_text


def stem(word: str) -> str:
    """Without its ending, if four characters at least are left."""
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= 4), word)


def keywords(question: str, extra: tuple[str, ...] = ()) -> list[str]:
    """Quoted phrases whole, then the other words that carry meaning, stemmed, then extra ones as they are; each once."""
    phrases, rest = [], []
    at = 0
    while at < len(question):
        c = question[at]
        end = question.find(c, at + 1) if c in "\"'" else -1
        if c not in "\"'":
            rest.append(c)
            at += 1
            continue
        body = question[at + 1 : end if end >= 0 else len(question)].strip().lower()
        if end >= 0 and len(body.encode()) >= 3:
            phrases.append(body)
            body = ""
        rest.append(body + " ")
        at = end + 1 if end >= 0 else len(question)
    out = phrases
    for word in re.split(r"\W+", "".join(rest).lower()):
        if len(word.encode()) >= 3 and word not in STOPWORDS and not re.fullmatch("[0-9]+", word) and stem(word) not in out:
            out.append(stem(word))
    for word in extra:
        if (word := word.strip().lower()) and word not in out:
            out.append(word)
    return out


def eligible(path: Column, size: Column, hidden: bool = False) -> Column:
    """Files worth searching by meaning: not empty, hidden, generated, binary, locked or secret."""
    parts, name = F.split(path, "/"), base_name(path)
    dirs, lower = F.slice(parts, 1, F.size(parts) - 1), F.lower(base_name(path))
    ends = lambda some: lower.rlike(r".\.(?:" + "|".join(map(quoted, some)) + r")\z") | lower.rlike(r"^\.(?:" + "|".join(map(quoted, some)) + r")\z")
    bad_dir = F.exists(dirs, lambda d: d.isin(*DENIED_DIRS) | (F.lit(False) if hidden else d.startswith(".")))
    secret = name.isin(*SECRET_FILES) | F.when(name.startswith(".env."), ~name.isin(*ENV_TEMPLATES)).otherwise(ends(SECRET_EXTENSIONS))
    out = (size > 0) & ~bad_dir & ~name.isin(*DENIED_FILES) & ~secret & ~ends(BINARY_EXTENSIONS)
    return out if hidden else out & ~name.startswith(".")


def keyword_counts(files: DataFrame, words: list[str], clipped: bool = False) -> DataFrame:
    """path and counts (array by keyword) over the lines that have any; within each file's row. clipped: over what a result row shows of a line, its first 500 characters."""
    any_word = "(?iu)" + "|".join(map(quoted, words)) if words else r"\z\A."
    zero = F.array(*[F.lit(0).cast("long") for _ in words]).cast("array<bigint>")
    hits = F.filter(line_array(F.col("text")), lambda x: x.rlike(any_word))
    rows = files.select("path", F.transform(hits, lambda x: F.lower(row_text(x) if clipped else x)).alias("lines"))
    add = lambda acc, x: F.zip_with(acc, F.array(*[occurrences(x, w).cast("long") for w in words]).cast("array<bigint>"), lambda a, b: a + b)
    return rows.select("path", F.aggregate("lines", zero, add).alias("counts"))


def idf(counts: DataFrame, words: list[str]) -> list[float]:
    """Weight of each keyword: ln((files + 1) / (files with it + 1)), within limits. One aggregate over narrow rows."""
    row = counts.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.get("counts", F.lit(i)) > 0).alias(f"k{i}") for i in range(len(words))]).first()
    return [min(IDF_MOST, max(IDF_LEAST, math.log((row["n"] + 1) / (row[f"k{i}"] + 1)))) for i in range(len(words))]


def lexical_scores(counts: DataFrame, words: list[str], weights: list[float]) -> DataFrame:
    """path, lex: a keyword's weight x (ln(1 + count) + 2 if it is in the path)."""
    lower = F.lower("path")
    score = F.lit(0.0)
    for i, (w, weight) in enumerate(zip(words, weights)):
        score = score + weight * (2 * F.contains(lower, F.lit(w)).cast("int") + F.log1p(F.get("counts", F.lit(i))))
    return counts.select("path", score.alias("lex"))


PASSAGES = "array<struct<start:int,stop:int,text:string,score:double>>"


def clip(text: str, size: int) -> str:
    """The longest head of at most so many UTF-8 bytes."""
    return text.encode()[: max(0, size)].decode(errors="ignore")


def pieces_of(line: str, room: int) -> list[str]:
    """The line in pieces of at most `room` UTF-8 bytes (of one character at least)."""
    out = []
    while line:
        head = clip(line, room) or line[0]
        out.append(head)
        line = line[len(head) :]
    return out


def windows_of(text: str | None, size: int, words: list[str], weights: list[float], clipped: bool = False) -> list[dict]:
    """Runs of whole lines, each behind its number, of at most `size` bytes. A longer line stands alone, in as many windows as it takes; clipped: cut to one."""
    lines = (text or "").split("\n")
    if lines[-1] == "":
        lines.pop()
    out: list[dict] = []

    def add(first: int, last: int, whole: str) -> None:
        low = whole.lower()
        out.append({"start": first, "stop": last, "text": whole, "score": float(sum(w * math.log1p(low.count(k)) for k, w in zip(words, weights)))})

    first, used, parts = 1, 0, []
    for number, line in enumerate(lines, 1):
        line, lead = line.removesuffix("\r"), f"L{number}| "
        need = len(line.encode()) + len(lead) + 1
        if parts and used + need > size:
            add(first, number - 1, "".join(parts))
            used, parts = 0, []
        if need > size:
            room = size - len(lead) - 1
            for piece in [clip(line, room)] if clipped else pieces_of(line, room):
                add(number, number, f"{lead}{piece}\n")
            continue
        first = first if parts else number
        parts.append(f"{lead}{line}\n")
        used += need
    if parts:
        add(first, len(lines), "".join(parts))
    return out


def passages(files: DataFrame, words: list[str], weights: list[float], size: int = WINDOW_BYTES, clipped: bool = False) -> DataFrame:
    """path, start, stop, text, score of the byte-bounded passages of each file; see windows_of."""

    @F.pandas_udf(PASSAGES)
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: windows_of(t, size, words, weights, clipped))

    return files.select("path", F.explode(cut("text")).alias("p")).select("path", "p.start", "p.stop", "p.text", "p.score")


def selected_windows(found: DataFrame, limit: int = WINDOWS) -> DataFrame:
    """A file's best passages by score, then place; evenly spread ones where no passage of the file has a score."""
    by_file = Window.partitionBy("path")
    rows = found.withColumn("n", F.count(F.lit(1)).over(by_file)).withColumn("best", F.max("score").over(by_file))
    rows = rows.withColumn("at", F.row_number().over(by_file.orderBy("start", "text")) - 1).withColumn("rank", F.row_number().over(by_file.orderBy(F.desc("score"), "start", "text")))
    # at = floor(k (n - 1) / step) for some k below the limit
    step = max(limit - 1, 1)
    k = F.ceil(F.col("at") * step / (F.col("n") - 1))
    even = (F.floor(k * (F.col("n") - 1) / step) == F.col("at")) & (k < limit)
    return rows.filter((F.col("n") <= limit) | F.when(F.col("best") == 0, even).otherwise(F.col("rank") <= limit)).drop("n", "best", "at", "rank")


def sketch_of(text: str, start: int, words: list[str], weights: list[float], budget: int = SKETCH_BYTES) -> str:
    """The lines of a passage that say most, verbatim, in their order, within a budget of bytes."""
    lines = [re.sub(r"^L\d+\| ", "", x) for x in text.split("\n")[:-1]]
    scored = [(-(0.1 if "(" in x else 0.0) - sum(w for k, w in zip(words, weights) if k in x.lower()), i) for i, x in enumerate(lines) if x.strip()]
    used, kept = 0, []
    for _, i in sorted(scored):
        room = budget - used - SKETCH_OVERHEAD
        if room < SKETCH_LEAST:
            break
        line = f"{start + i}: {clip(lines[i].strip(), min(room, SKETCH_MOST))}"
        used += len(line.encode()) + 1
        kept.append((i, line))
    return "\n".join(line for _, line in sorted(kept))


def sketches(found: DataFrame, words: list[str], weights: list[float], budget: int = SKETCH_BYTES) -> DataFrame:
    @F.pandas_udf("string")
    def of(text: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([sketch_of(t, s, words, weights, budget) for t, s in zip(text, start)], dtype=object)

    return found.withColumn("sketch", of("text", "start"))


#: Ranges that a task merges: narrow rows, of which Spark would else put tens of MB as compressed, millions of them, together.
TASK_RANGES = 250_000


def merged_heat(ranges: DataFrame, threshold: float) -> DataFrame:
    """path, start, stop, p, snippet: ranges of enough p, joined where they touch, with the largest p and the first snippet."""
    tasks = -(-ranges.count() // TASK_RANGES)
    kept = ranges.filter((F.col("p") >= threshold) & (F.col("p") > 0) & (F.col("start") <= F.col("stop"))).repartition(max(1, tasks), "path")
    # Equal ranges are one, so that the order has no ties; the shuffle by path serves this, the windows and the groups.
    kept = kept.groupBy("path", "start", "stop").agg(F.max("p").alias("p"), F.min("snippet").alias("snippet"))
    order = Window.partitionBy("path").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach + 1, 0).otherwise(1)
    islands = kept.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("snippet", F.struct("start", "stop"))
    return islands.groupBy("path", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("p").alias("p"), first.alias("snippet")).drop("island")

"""License scans by ordered signature rules; DataFrame and SQL functions only.

Texts are lower-cased (A-Z) and reduced to their words, single spaces between and around. Three base phrases are counted
wherever their words stand consecutively. Beyond them the ordered rules of license_rules, regular expressions over words written
by hand, are tried. They are gated twice by keywords: a text without any of the rules' keywords is not looked at, and a rule's
expression runs only on texts that contain its own. A rule's matches are found by splitting the text at them, so their word
intervals follow from lengths and counts of spaces.

Overlapping detections are resolved by priority and containment: sorted by start, then longest, then rule order, a detection is
suppressed if an interval of the same or a higher priority that contains it came earlier, or one of a higher
priority contains it at all. Labels are those of the base phrases and of the detections that remain.

Edge cases: a null or empty text has no words; a phrase at either end of a text counts like any other; words keep all characters
from U+0080 on; repeated rows and null doc_ids are scanned like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import chunks, let, sums_before
from siftline.llm.common import documents
from siftline.llm.license_rules import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: What the rules are as a Spark value.
TABLE = "array<struct<label:string,priority:int,weight:double,keyword:string,pattern:string>>"


def gates() -> list[str]:
    """A text is scanned only if it contains one of these; a text that any rule matches does."""
    every = sorted({keyword for _, _, _, keyword, _ in RULES})
    return [g for g in every if not any(other in g for other in every if other != g)]


def spaced_words(text: Column) -> Column:
    """' word word ... ' in lower case; two spaces without words."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, BETWEEN, " ")), F.lit(" "))


def n_spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def intervals(line: Column, pattern: Column) -> Column:
    """Array of (first, last) word numbers of the pattern's matches between spaces of a line from spaced_words."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    # Piece i ends where match i begins. A word's number is the number of spaces before it, less one.
    matches = F.transform(F.regexp_extract_all(line, whole, F.lit(0)), n_spaces)
    pieces = F.transform(F.split(line, whole, F.lit(-1)), n_spaces)

    def places(x: Column) -> Column:
        between = F.slice(x["pieces"], F.lit(1), F.size(x["matches"]))
        before = sums_before(F.zip_with(between, x["matches"], lambda p, m: (p + m).cast("long")))
        first = F.zip_with(before, between, lambda b, p: b + p - 1)
        return F.zip_with(first, x["matches"], lambda f, m: F.struct(f.cast("long").alias("first"), (f + m).cast("long").alias("last")))

    return let(F.struct(matches.alias("matches"), pieces.alias("pieces")), places)


def phrase_places(words: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase stands."""
    parts = phrase.split(" ")
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i):
        out = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + k) == part)
        return out

    return F.when(F.size(words) >= len(parts), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def detections(line: Column) -> Column:
    """All rules' matches that no other suppresses, as an array of (first, last, label, priority, weight), by first."""
    fields = ("label", "priority", "weight", "keyword", "pattern")
    table = F.from_json(F.lit(json.dumps([dict(zip(fields, rule)) for rule in RULES])), TABLE)
    ranked = F.transform(table, lambda r, i: F.struct(r.alias("rule"), i.alias("rank")))
    tried = F.filter(ranked, lambda r: F.contains(line, r["rule"]["keyword"]))
    # In this order whatever contains an interval comes before it.
    place = lambda r, x: F.struct(x["first"].alias("first"), (-x["last"]).alias("less_last"), (-r["rule"]["priority"]).alias("less_priority"), r["rank"].alias("rank"), r["rule"]["label"].alias("label"), r["rule"]["weight"].alias("weight"))
    found = F.array_sort(F.flatten(F.transform(tried, lambda r: F.transform(intervals(line, r["rule"]["pattern"]), lambda x: place(r, x)))))
    out = "array<struct<first:bigint,last:bigint,label:string,priority:int,weight:double>>"
    # reach[q]: the furthest end so far of any detection of priority q or more.
    reach = F.array_repeat(F.lit(-1).cast("long"), 6)
    none = F.array().cast(out)

    def step(acc, x):
        last, priority = -x["less_last"], -x["less_priority"]
        hit = F.array(F.struct(x["first"].alias("first"), last.alias("last"), x["label"].alias("label"), priority.alias("priority"), x["weight"].alias("weight")))
        stays = F.get(acc["reach"], priority) < last
        return F.struct(F.transform(acc["reach"], lambda t, q: F.when(q <= priority, F.greatest(t, last)).otherwise(t)).alias("reach"), F.when(stays, F.concat(acc["kept"], hit)).otherwise(acc["kept"]).alias("kept"))

    def chunk(acc, some):
        inner = F.aggregate(some, F.struct(acc["reach"].alias("reach"), none.alias("kept")), step)
        return let(inner, lambda x: F.struct(x["reach"].alias("reach"), F.concat(acc["parts"], F.array(x["kept"])).alias("parts")))

    start = F.struct(reach.alias("reach"), F.array().cast(f"array<{out}>").alias("parts"))
    return let(found, lambda all_: F.aggregate(chunks(all_), start, chunk, lambda acc: F.flatten(acc["parts"])))


def scanned(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_words, base (array of label, place by phrase), found (see detections)."""
    rows = docs.select(*keep, spaced_words(F.col(text_col)).alias("__line"))
    line = F.col("__line")
    any_of = lambda some: F.lit(False) if not some else some[0] if len(some) == 1 else some[0] | any_of(some[1:])
    words = F.when(any_of([F.contains(line, F.lit(f" {p} ")) for p in BASE]), F.split(F.trim(line), " ", -1)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__words", words)
    labelled = lambda label: lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("place"))
    places = F.concat(*[F.transform(phrase_places(F.col("__words"), p), labelled(label)) for p, label in BASE.items()])
    none = "array<struct<first:bigint,last:bigint,label:string,priority:int,weight:double>>"
    found = F.when(any_of([F.contains(line, F.lit(t)) for t in gates()]), detections(line)).otherwise(F.array().cast(none))
    return rows.select(*keep, F.when(F.length(F.trim(line)) == 0, F.lit(0)).otherwise(n_spaces(line) - 1).cast("long").alias("n_words"), places.alias("base"), found.alias("found"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(documents(spark, sf_dir))
    place, base = F.transform("base", lambda x: x["place"]), F.transform("base", lambda x: x["label"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["weight"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"),
    )

"""Mixing sources to target weights: capped water-filling over sources, then seeded whole and fractional repetitions of documents.

A source's target is its share of the budget by weight, but `epochs` times its size at most: sources above that are clamped there, and what
they can't take is shared among the others by weight, again and again until none is above. A target is then met by whole
repetitions of all the source's documents and by a part of one more: documents in the order of a seeded hash of their id up to a cut, where the
document at the cut gives the words that are still missing.

Nothing is gathered: sources are ranked by parts of a sort, each round of water-filling is one aggregate, whose state is two numbers, and
the cut of all sources is found by three aggregates over ever finer buckets of the hash. A source with a third of all rows is combined
before each shuffle, like any other. DataFrame functions only.

Edge cases: a null text has size 0 and takes nothing; the null source is a source, the last by code point; rows that share an id
(null ids too) have one hash and share what is missing at the cut in proportion, rounded down; repeated rows count each; a source without words has target 0; an
empty table gives an empty mix; columns beyond those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import documents, small, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 13
#: Bits of a document's hash that are left below each level of the search for the cut; the last level is the hash itself.
HASH_BITS, LEVELS = 60, (48, 36, 0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(ident: Column, seed: int) -> Column:
    """A number of HASH_BITS bits by which documents are ordered."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def weighted(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """sources with `weight`: the weights in turn, by code point of the source, null last. Sorted parts are counted, so no task sees all."""
    parts = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, n = {}, 0
    for part, size in sorted((r.part, r["count"]) for r in parts.groupBy("part").count().collect()):  # a row a partition
        before[part], n = n, n + size
    offset = F.element_at(F.create_map(*[F.lit(x) for p, k in before.items() for x in (p, k)]), F.col("part")) if before else F.lit(0)
    rank = offset + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(int(w)) for w in weights])
    return parts.withColumn("weight", F.get(turn, (rank % len(weights)).cast("int")).cast("long")).drop("part")


def water_filled(sources: DataFrame, total: int, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, source_size, weight) with `target`: shares of `total` by weight, none above epochs * source_size."""
    wide = "decimal(19,0)"
    cap = F.col("source_size") * epochs
    rest, weight, clamped = total, int(sources.agg(F.sum("weight")).first()[0] or 0), 0
    while weight:
        above = cap.cast(wide) * F.lit(Decimal(weight)).cast(wide) < F.lit(Decimal(rest)).cast(wide) * F.col("weight").cast(wide)
        now = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if now.n == clamped:
            break
        clamped, rest, weight = now.n, total - int(now.taken or 0), int(now.weight or 0)
    if not weight:
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(weight))))


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with the hash at which each source's last repetition ends (`cut`), the words still missing there and the words that have that hash (`tie`).

    rows: source, size, place. plan: source and words of the last repetition (`missing`), fewer than the source has.
    """
    at, above = plan.select("source", "missing", F.lit(0).cast("long").alias("cut")), HASH_BITS
    for level in LEVELS:
        known = small(stored(at, "mix-cuts"))
        bucket = F.shiftright("place", level)
        here = rows.alias("r").join(known.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.shiftright(F.col("r.place"), above) == F.col("p.cut")))
        sums = here.groupBy("r.source", "p.missing", bucket.alias("cut")).agg(F.sum("size").alias("tie"))
        upto = F.sum("tie").over(Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = sums.withColumn("upto", upto).filter("upto - tie <= missing AND missing < upto")
        at, above = found.select("source", (F.col("missing") - F.col("upto") + F.col("tie")).alias("missing"), "cut", "tie"), level
    return stored(at, "mix-cuts")


def mixture(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, total: int | None = None, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """The kept columns, size, source_size, target, copies (whole repetitions) and part (words of one more) of each document.

    total: words of the mix, all documents' words if None. `keep` must not name one of the added columns.
    """
    of = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place(F.col(id_col), seed).alias("place"))
    rows = stored(of.select("source", "size", "place"), "mix-rows")
    sources = stored(weighted(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-weights")
    everything = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    planned = water_filled(sources, everything if total is None else total, epochs)
    words, size = F.round("target").cast("long"), F.col("source_size")
    copies = F.when(size > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    planned = stored(planned.select("source", "source_size", "target", copies.alias("copies"), (words - copies * size).alias("missing")), "mix-plan")
    ends = cuts(rows, planned.filter("source_size > 0"))
    plan = planned.drop("missing").alias("p").join(ends.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", "missing", "cut", "tie")
    plan = small(stored(plan, "mix-plan"))
    last = F.when(F.col("place") < F.col("cut"), F.col("size")).when(F.col("place") == F.col("cut"), F.expr("cast((cast(missing as decimal(19,0)) * cast(size as decimal(19,0))) div tie as bigint)")).otherwise(0)
    out = of.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", "copies", F.coalesce(last, F.lit(0)).cast("long").alias("part"))


def mixed_texts(mix: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: a row for each repetition of each document, numbered from 1 (`repetition`); the last may hold only the first words of its text."""
    shares = F.filter(F.concat(F.array_repeat(F.col("size"), F.col("copies").cast("int")), F.array("part")), lambda x: x > 0)
    rows = mix.select("*", F.posexplode(shares).alias("repetition", "words")).withColumn("repetition", F.col("repetition") + 1)
    pieces = F.regexp_extract_all(text_col, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    return rows.withColumn(text_col, F.when(F.col("words") == F.col("size"), F.col(text_col)).otherwise(cut))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixture(documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


ORACLE_OP13 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5('13:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source) AS place, sum(cap) OVER () // 3 - sum(cap) OVER (ORDER BY cap / w, source) + cap AS rest, sum(w) OVER (ORDER BY cap / w DESC, source DESC) AS heavy FROM s
), level AS (
  SELECT arg_min(rest, place)::BIGINT AS rest, arg_min(heavy, place)::BIGINT AS heavy, min(place) AS first FROM o WHERE rest * w <= cap * heavy
), t AS (
  SELECT source, source_size, CASE WHEN place < first THEN cap::DOUBLE ELSE level.rest::DOUBLE * w / level.heavy::DOUBLE END AS target FROM o, level
), g AS (
  SELECT source, h, sum(size)::BIGINT AS tie FROM d GROUP BY source, h
), u AS (
  SELECT source, h, tie, sum(tie) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM g
)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(CASE WHEN t.source_size = 0 THEN 0 ELSE round(t.target)::BIGINT // t.source_size * d.size
  + CASE WHEN u.upto <= round(t.target)::BIGINT % t.source_size THEN d.size
         WHEN u.upto - u.tie <= round(t.target)::BIGINT % t.source_size THEN (round(t.target)::BIGINT % t.source_size - u.upto + u.tie)::HUGEINT * d.size // u.tie ELSE 0 END END, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.h = u.h
"""

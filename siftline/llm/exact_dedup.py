"""Exact deduplication with stateful streaming; DataFrame and SQL functions only.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; null counts as empty. Each document
is reduced to a SHA-256 digest of its normalised text, its code points and a content locator: the number of its row, which is its
file and its place in the file. A Structured Streaming aggregation without watermark or expiry keeps, in disk-backed (RocksDB)
state keyed by digest, the stable identifier and locator of the row that stays and the number of rows seen. A later `ingest` of
new rows continues from that state.

Hits are then checked over full bytes: the texts of rows whose digest was met more than once are fetched by their locators, and
for each digest the smallest and the largest are compared, an associative aggregate that combines before the shuffle, so a
group with a third of all rows costs a task no more than any other. Digests whose texts differ are regrouped by the texts
themselves, so even colliding digests give exact groups.

Edge cases: null and empty texts are one group; a null doc_id sorts last among ties and is never a stable identifier if
another row has one; fully equal rows are told apart by their place in the table; an empty table gives no rows; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import ROW, documents, numbered, scratch_path, small, stored

WHITE = " \t\n\x0b\x0c\r"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: str | Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WHITE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def rows_for_state(docs: DataFrame, id_col: str, text_col: str, row_col: str, digest=sha256) -> DataFrame:
    """One narrow row per document; row_key is its locator."""
    return docs.select(
        F.col(row_col).alias("row_key"), F.col(id_col).alias("doc_id"), digest(normalised(text_col)).alias("digest"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars")
    )


def ingest(spark: SparkSession, rows_dir: str, schema, state_dir: str) -> DataFrame:
    """Feed the files of rows_dir that the state has not seen yet; return the state: digest, keep, group_size."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        # Of equal texts the longest original stays, then the smallest id; nulls last.
        keep = F.struct((-F.col("n_chars")).alias("less_chars"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("row_key").alias("keep_key"))
        state = spark.readStream.schema(schema).parquet(rows_dir).groupBy("digest").agg(F.min(keep).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        state.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir).trigger(availableNow=True).start().awaitTermination()
        held = spark.read.format("statestore").option("path", state_dir).load()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fields = [f"value.`{f.name}`" for f in held.schema["value"].dataType.fields]
    return held.select(F.col("key.digest").alias("digest"), F.col(fields[0]).alias("keep"), F.col(fields[1]).alias("group_size"))


def colliding(texts: DataFrame) -> DataFrame:
    """Digests of rows (digest, body) under which full texts differ (for SHA-256: none, but they are looked at)."""
    return texts.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a != b").select("digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, row_col: str | None = None) -> DataFrame:
    """One row per document: row_key, doc_id, keep_key, keep_id, group_size, kept, digest. row_col: a column that numbers the rows, the same in every scan."""
    spark = docs.sparkSession
    if row_col is None:
        docs, row_col = numbered(docs), ROW
    rows_dir = scratch_path(spark, "dedup-rows")
    rows = rows_for_state(docs, id_col, text_col, row_col, digest)
    rows.write.parquet(rows_dir)
    rows = spark.read.schema(rows.schema).parquet(rows_dir)
    state = ingest(spark, rows_dir, rows.schema, scratch_path(spark, "dedup-state"))
    found = rows.join(state, "digest").select("row_key", "doc_id", "digest", F.col("keep.keep_key").alias("keep_key"), F.col("keep.keep_id").alias("keep_id"), "group_size")
    found = stored(found, "dedup-found")
    hits = small(found.filter("group_size > 1").select("row_key"))
    fetched = docs.select(F.col(row_col).alias("row_key"), F.col(text_col).alias("text")).join(hits, "row_key", "left_semi").select(normalised("text").alias("body"))
    clashes = stored(colliding(fetched.select(digest(F.col("body")).alias("digest"), "body")), "dedup-clashes")
    if not clashes.isEmpty():
        texts = docs.select(F.col(row_col).alias("row_key"), F.col(id_col).alias("doc_id"), normalised(text_col).alias("body"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"))
        texts = stored(texts.withColumn("digest", digest(F.col("body"))).join(clashes, "digest", "left_semi"), "dedup-clash-texts")
        best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("keep_id"), F.col("row_key").alias("keep_key"))).alias("keep")
        groups = stored(texts.groupBy("digest", "body").agg(best, F.count(F.lit(1)).alias("group_size")), "dedup-clash-groups")
        again = texts.join(groups, ["digest", "body"]).select("row_key", "doc_id", "digest", F.col("keep.keep_key").alias("keep_key"), F.col("keep.keep_id").alias("keep_id"), "group_size")
        found = found.join(clashes, "digest", "left_anti").select(again.columns).unionByName(again)
    return found.select("row_key", "doc_id", "keep_key", "keep_id", "group_size", (F.col("row_key") == F.col("keep_key")).alias("kept"), "digest")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE_OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), s AS (SELECT doc_id, length(t) AS n, sha256(body) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM s WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

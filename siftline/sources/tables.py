"""Corpora as files (path, text): views over tables, the same in Spark and in SQL (see plans/corpus_sql.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), "text")


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each part, for each order one that imports its first part and calls all its parts, for each customer
    one that calls the orders."""
    # Texts are small and costly to look through: as many partitions as the session asks for, which AQE does not join.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    part = lambda x: F.concat(F.lit("part_"), x["l_partkey"].cast("string"))
    calls = F.transform("items", lambda x: F.concat(F.lit("    "), part(x), F.lit("("), x["l_quantity"].cast("int").cast("string"), F.lit(")")))
    first = F.coalesce(part(F.get("items", F.lit(0))), F.lit("part_1"))
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("from "), first, F.lit(" import "), first, F.lit("\n# "), F.col("o_orderpriority"), F.lit("\ndef order_"), key, F.lit("():\n"), F.coalesce(F.array_join(calls, "\n"), F.lit("    return 0")), F.lit("\n")
    )
    orders = table(spark, sf_dir, "orders").repartition(n, "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = orders.select(F.concat(F.lit("orders/o_"), key, F.lit(".py")).alias("path"), text.alias("text"))
    number = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("def part_"), number, F.lit("(quantity):\n    return quantity\n"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("parts/part_"), number, F.lit(".py")).alias("path"), body.alias("text"))
    by_customer = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("c"), "o_orderkey").repartition(n, "c").groupBy("c").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    uses = F.array_join(F.transform("keys", lambda k: F.concat(F.lit("    order_"), k.cast("string"), F.lit("()\n"))), "")
    reports = by_customer.select(F.concat(F.lit("reports/r_"), "c", F.lit(".py")).alias("path"), F.concat(F.lit("def report_"), "c", F.lit("():\n"), uses).alias("text"))
    return orders.unionByName(parts).unionByName(reports)


def polyglot_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small sources in other languages: a module for each part (TypeScript), supplier (Go and C), customer (Java), nation (Rust) and region (Markdown)."""

    def made(name: str, key: str, path: str, *lines: str | Column) -> DataFrame:
        n = F.col(key).cast("string")
        filled = lambda x: F.replace(F.lit(x), F.lit("#n"), n) if isinstance(x, str) else x
        text = F.concat(F.concat_ws("\n", *map(filled, lines)), F.lit("\n"))
        return table(spark, sf_dir, name).select(filled(path).alias("path"), text.alias("text"))

    imported = F.when(F.col("p_partkey") % 2 == 0, "import a from '../ts/part_1'").otherwise("const a = require('../ts/part_2')")
    out = made("part", "p_partkey", "ts/part_#n.ts", imported, "/** Part #n. */", "export class Part_#n {", "  size(a) {", "  }", "}", "const make_#n = () => 1")
    out = out.unionByName(made("supplier", "s_suppkey", "go/supplier_#n.go", "// Supplier #n", "type Supplier_#n struct {}", "func (s *Supplier_#n) Name_#n() {}"))
    out = out.unionByName(made("supplier", "s_suppkey", "c/supplier_#n.c", '#include "supplier_1.h"', "struct Box_#n {", "int supplier_#n(int a) {"))
    out = out.unionByName(made("customer", "c_custkey", "java/Customer_#n.java", "// Customer #n", "public class Customer_#n {", "  public Customer_#n(int a) {", "  public static int total_#n(int a) {", "}"))
    out = out.unionByName(made("nation", "n_nationkey", "rust/nation_#n.rs", "use nation_1;", "pub struct Nation_#n {}", "impl Nation_#n {}", "pub async fn of_#n() {}"))
    return out.unionByName(made("region", "r_regionkey", "doc/region_#n.md", "# Region_#n", "- item_#n"))


def opens_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, ts: events as a log of opened paths."""
    rows = table(spark, sf_dir, "events").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), F.col("user_id") == F.col("doc_id"))
    return rows.select(F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "ts")

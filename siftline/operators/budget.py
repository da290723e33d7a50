"""The head of an order that fits a budget of characters, by prefix sums over the parts of a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.sources.scratch import stored


def fitting(ranked: DataFrame, size: Column, order: list[Column], budget: int) -> DataFrame:
    """The longest head of the (total) order whose blocks of `size` characters, with a newline between, fit the budget.

    Rows are sorted by range; each part's total, one row a part, says where it begins in the whole, and only parts that begin within the budget are read
    again. A null size counts as 0; a budget below the first block gives no rows.
    """
    width = F.coalesce(size, F.lit(0)).cast("long") + 1
    parts = stored(ranked.withColumn("__size", width).orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    begins, total = {}, 0
    for part, n in sorted(tuple(r) for r in parts.groupBy("__part").agg(F.sum("__size")).collect()):  # a row a partition
        if total > budget:
            break
        begins[part], total = total, total + n
    if not begins:
        return ranked.limit(0)
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in begins.items() for x in pair]), F.col("__part"))
    upto = offset + F.sum("__size").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)) - 1
    kept = parts.filter(F.col("__part").isin(*begins)).withColumn("__upto", upto).filter(F.col("__upto") <= budget)
    return kept.select(*ranked.columns)

"""Stored counts of opens: rows (path, opened, last) as JSON lines, merged on save."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.frecency import cleared, merged

SCHEMA = "path string, opened double, last timestamp, damaged string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """What is whole in the store: finite counts of zero and more, with a path and a time."""
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damaged").json(path)
    good = F.col("damaged").isNull() & F.col("path").isNotNull() & (F.col("opened") >= 0) & ~F.isnan("opened") & F.col("last").isNotNull()
    return rows.filter(good).select("path", F.col("opened").cast("long").alias("opened"), "last")


def save(store: DataFrame, before: DataFrame | None, path: str, cleared_at: datetime | None = None, now: datetime | None = None) -> None:
    """Write store merged with what was there before, less what was opened last before it was cleared, to a new path."""
    whole = merged(store, before) if before is not None else store
    if cleared_at is not None:
        whole = cleared(whole, cleared_at, now or datetime.now())
    whole.write.mode("errorifexists").json(path)

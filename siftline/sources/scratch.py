"""Tables between the steps of a search, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampType

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """Under spark.checkpoint.dir; a temporary folder only where that is unset on a local master (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or _local.get(sc.applicationId)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="siftline-")
    return f"{base.rstrip('/')}/siftline-search-{sc.applicationId}"


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written once as Parquet: what follows reads them as often as it likes, and lost executors cost tasks alone."""
    path = f"{folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rows of paths or keys up to this many, and so many bytes of texts in them, are broadcast; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def small(rows: DataFrame) -> DataFrame:
    """The stored rows, marked for broadcast if they are within both bounds; arrays and structs count by their JSON."""
    plain = (NumericType, BooleanType, DateType, TimestampType)
    size = F.lit(0)
    for f in rows.schema.fields:
        if not isinstance(f.dataType, plain):
            text = F.col(f.name) if isinstance(f.dataType, StringType) else F.to_json(F.struct(f.name))
            size = size + F.coalesce(F.octet_length(text), F.lit(0))
    n, held = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and held <= BROADCAST_BYTES else rows


def release(spark: SparkSession) -> None:
    """Delete what `stored` wrote in this application. Call it once results have been saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Helpers that the training-data operators share: scratch tables, row numbers, Arrow batch slicing, word codes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Bytes of text that one step of a Python task holds at a time (one longer text still forms a step).
STEP_BYTES = 8 << 20
#: As much for steps whose words become Python objects.
WORD_BYTES = 2 << 20
#: Entries of a per-task memo before it is emptied; bounds a worker's memory, never the result.
MEMO_ENTRIES = 400_000

#: Row numbers up to this many are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts in rows that are broadcast.
BROADCAST_BYTES = 16 << 20
#: The column that numbers rows.
ROW = "__siftline_row"

_local_scratch: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster use --py-files or an installed wheel."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset on a local master (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or _local_scratch.get(sc.applicationId)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_scratch[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="siftline-")
    return f"{base.rstrip('/')}/siftline-{sc.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_parquet_scan(docs: DataFrame) -> bool:
    """Whether docs is a plain read of Parquet files, nothing joined, filtered or renamed."""
    plan = docs._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in plan.relation().fileFormat().toString()


def numbered(docs: DataFrame, name: str = ROW) -> DataFrame:
    """docs with a number for each row that is the same in every scan, however the files are split.

    Rows of Parquet files are numbered by file and place in the file, so texts needn't be stored again; any other docs are
    numbered in a stored copy.
    """
    if not is_parquet_scan(docs):
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    path = F.col("_metadata.file_path")
    files = stored(docs.select(path.alias(f"{name}_path")).distinct().coalesce(1).withColumn(f"{name}_file", F.monotonically_increasing_id()), "files")  # a row a file
    place = docs.withColumn(name, F.col("_metadata.row_index")).withColumn(f"{name}_path", path)
    number = F.shiftleft(F.col(f"{name}_file"), 36) + F.col(name)
    return place.join(F.broadcast(files), f"{name}_path").select(*docs.columns, number.alias(name))


def small(rows: DataFrame) -> DataFrame:
    """The stored rows, marked for broadcast if they are at most BROADCAST_ROWS, and their texts BROADCAST_BYTES."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in rows.schema.fields if isinstance(f.dataType, StringType)]
    if texts:
        n, size = rows.agg(F.count(F.lit(1)), F.sum(reduce(lambda a, b: a + b, texts))).first()
        return F.broadcast(rows) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else rows
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def release(spark: SparkSession) -> None:
    """Delete every scratch table that this application wrote. Call it once results have been saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as empty text."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit(""))), F.lit(modulus)).cast("int")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that each slice holds about `limit` bytes of `column` at most."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Hashes(dict):
    """Memo of a word's signed 64-bit XXH64; emptied between steps once it is large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = int.from_bytes(xxhash.xxh64_digest(word), "big", signed=True)
        return h

    def trim(self) -> None:
        if len(self) > MEMO_ENTRIES:
            self.clear()


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """UTF-8 words between characters of [\\x20\\x09-\\x0D]; lower changes A-Z alone. Null has none."""
    if not text:
        return []
    raw = text.encode("utf-8")
    return (raw.lower() if lower else raw).split()


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))[:-1]


def sum_by(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (empty runs give 0)."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its texts; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def marks_by_text(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    return np.diff(np.searchsorted(np.flatnonzero(marked), offsets))


def added(docs: DataFrame, text_col: str, keep: tuple[str, ...], fields: str, make, beside: tuple[Column, ...] = ()) -> DataFrame:
    """The kept columns (as k0, k1, ..., whatever their names) and further ones. make() is called once a task and gives a function
    from a text array (and the arrays of the columns beside it) to the further columns' values. See named()."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[c.alias(f"b{i}") for i, c in enumerate(beside)], F.col(text_col).alias("text"))
    schema = docs.sparkSession.createDataFrame([], fields).schema
    out = StructType([*rows.schema.fields[: len(keep)], *schema.fields])

    def run(batches):
        act = make()
        for part in slices(batches, "text", WORD_BYTES):
            new = [x if isinstance(x, pa.Array) else pa.array(x) for x in act(part.column("text"), *part.columns[len(keep) : -1])]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new], out.names)

    return rows.mapInArrow(run, out)


def named(rows: DataFrame, keep: tuple[str, ...], *more: str) -> DataFrame:
    """k0, k1, ... under their own names again, and more columns."""
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *more)

"""Opens as a stream, with clears: the same counts as the batch operator, kept in the query's keyed state. An addition of this library.

Events are rows (path, ts, cleared): an open, or where cleared is true a tombstone, which deletes the path's counts; opens at its time or later count again.
`clear` empties the whole store as of a time. Each run writes what changed under batch=N; `compact` joins what there is into one snapshot, so that `current`
reads a snapshot and the runs since, not all runs ever.

Edge cases: a null path or ts is left aside; null cleared is an open; an open that comes late, before its path's tombstone or before the store's clear, doesn't count; a tombstone
has to come in the run of the opens after it or earlier. A run that is repeated after a failure replaces its own rows. One path's events of one micro-batch are held
together as 8 bytes each; maxFilesPerTrigger bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "path string, ts timestamp, cleared boolean"
CHANGES = "path string, opened long, last timestamp, gone boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def opens(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Rows (path, ts, cleared) from Parquet files as they arrive in a folder; files without the last column hold opens."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def counted(events: DataFrame) -> DataFrame:
    """path, opened, last of a batch of events: the opens since each path's last tombstone."""
    known = events.filter("path IS NOT NULL AND ts IS NOT NULL").withColumn("cleared", F.coalesce("cleared", F.lit(False)))
    tombs = known.filter("cleared").groupBy("path").agg(F.max("ts").alias("at"))
    after = known.filter("NOT cleared").join(tombs, "path", "left").filter("at IS NULL OR ts >= at")
    return after.groupBy("path").agg(F.count(F.lit(1)).alias("opened"), F.max("ts").alias("last"))


class Counts(StatefulProcessor):
    """State of a path: its opens and the last of them, and apart from that when it was last cleared."""

    def __init__(self, emptied: float | None):
        self.emptied = emptied  # microseconds; what was opened last before that doesn't count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "opened long, last long")
        self.tomb = handle.getValueState("tomb", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, marks = [], []
        for frame in rows:
            times.append(frame["ts"].to_numpy("datetime64[us]").astype(np.int64))
            marks.append(frame["cleared"].to_numpy(bool))
        at, cleared = np.concatenate(times), np.concatenate(marks)
        opened, last = self.counts.get() if self.counts.exists() else (0, None)
        tomb = self.tomb.get()[0] if self.tomb.exists() else None
        if cleared.any():
            newest = int(at[cleared].max())
            if tomb is None or newest > tomb:
                tomb = newest
                self.tomb.update((tomb,))
            if last is not None and last < tomb:
                opened, last = 0, None
        since = max(x for x in (tomb, self.emptied, np.iinfo(np.int64).min) if x is not None)
        if last is not None and self.emptied is not None and last < self.emptied:
            opened, last = 0, None
        fresh = at[~cleared & (at >= since)]
        if len(fresh):
            opened, last = opened + len(fresh), max(int(fresh.max()), last if last is not None else int(fresh.max()))
        if opened:
            self.counts.update((opened, last))
        else:
            self.counts.clear()
        yield pd.DataFrame({"path": [key[0]], "opened": [opened], "last": [pd.Timestamp(last, unit="us") if opened else pd.NaT], "gone": [not opened]})

    def close(self) -> None:
        pass


def tracked(stream: DataFrame, emptied: datetime | None = None) -> DataFrame:
    """path, opened, last, gone of each path that a micro-batch touches. The session's state store has to be RocksDB (see into_table)."""
    known = stream.filter("path IS NOT NULL AND ts IS NOT NULL").select("path", "ts", F.coalesce("cleared", F.lit(False)).alias("cleared"))
    micros = None if emptied is None else int(emptied.timestamp() * 1_000_000)
    return known.groupBy("path").transformWithStateInPandas(Counts(micros), CHANGES, "update", "None")


def _folders(spark: SparkSession, folder: str, kind: str) -> dict[int, str]:
    """Complete folders kind=N by N: a row a run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for status in fs.listStatus(path) if fs.exists(path) else []:
        name = status.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(f"{kind}=") and fs.exists(done):
            out[int(name.split("=")[1])] = status.getPath().toString()
    return out


def clear(spark: SparkSession, folder: str, at: datetime) -> None:
    """Empty the store as of a time: what was opened last before it is gone."""
    micros = int(at.timestamp() * 1_000_000)
    spark.range(1).select(F.lit(micros).alias("at")).write.mode("overwrite").parquet(f"{folder}/emptied={micros}")


def emptied(spark: SparkSession, folder: str) -> datetime | None:
    found = _folders(spark, folder, "emptied")
    return datetime.fromtimestamp(max(found) / 1_000_000) if found else None


def into_table(spark: SparkSession, source: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Run over the events that came since the last run, writing the counts that changed under folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    changed = tracked(opens(spark, source), emptied(spark, folder))
    return changed.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(spark: SparkSession, folder: str) -> tuple[DataFrame, int, dict[str, dict[int, str]]]:
    """Each path's last row, the last run there is, and the folders that were read."""
    snapshots, runs = _folders(spark, folder, "snapshot"), _folders(spark, folder, "batch")
    base = max(snapshots, default=-1)
    parts = [(base, snapshots[base])] if snapshots else []
    parts += [(n, path) for n, path in sorted(runs.items()) if n > base]
    rows = spark.createDataFrame([], f"{CHANGES}, run long")
    if parts:
        run = F.regexp_extract(F.input_file_name(), r"/(?:batch|snapshot)=(\d+)/", 1).cast("long")
        rows = spark.read.schema(CHANGES).parquet(*[path for _, path in parts]).withColumn("run", run)
    newest = rows.groupBy("path").agg(F.max_by(F.struct("opened", "last", "gone"), "run").alias("x")).select("path", "x.*")
    return newest, max((n for n, _ in parts), default=-1), {"snapshot": snapshots, "batch": runs}


def current(spark: SparkSession, folder: str) -> DataFrame:
    """path, opened, last as of the last run."""
    newest, _, _ = _latest(spark, folder)
    since = emptied(spark, folder)
    kept = newest.filter("NOT gone")
    return (kept if since is None else kept.filter(F.col("last") >= F.lit(since))).select("path", "opened", "last")


def compact(spark: SparkSession, folder: str) -> None:
    """Write what is current as one snapshot, then delete the runs and snapshots that are in it. Not while a run is under way."""
    _, last, old = _latest(spark, folder)
    if last < 0 or last in old["snapshot"] and not any(n > last for n in old["batch"]):
        return
    current(spark, folder).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{folder}/snapshot={last}")
    for kind, found in old.items():
        for n, path in found.items():
            if n < last or kind == "batch" and n == last:
                gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

"""A live directory tree as files (path, size, mtime, text): listed by tasks, level by level, and read by tasks. The root is on shared storage."""

from __future__ import annotations

import os
import subprocess
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.fixed_values import FILE_BYTES, PROBE_BYTES, READ_BYTES, TREE_DEPTH
from siftline.functions.text import decoded, trimmed
from siftline.sources.scratch import small, stored

LISTED = "path string, size long, mtime timestamp"
FOUND = "path string, folder boolean, real string, size long, mtime timestamp"


def checked_root(root: str) -> str:
    full = os.path.realpath(root)
    if full in (os.path.realpath("/"), os.path.realpath(os.path.expanduser("~"))):
        raise ValueError(f"refusing to scan {full}")
    if not os.path.isdir(full):
        raise ValueError(f"no such directory: {root}")
    return full


def _entries(root: str, folder: str, follow: bool) -> list[tuple]:
    """What stands in one directory: no node_modules, no dot directories, nothing named .git, links only if followed."""
    out = []
    try:
        found = list(os.scandir(os.path.join(root, folder)))
    except OSError:
        return out
    for e in found:
        if e.name == ".git" or e.is_symlink() and not follow:
            continue
        path = f"{folder}/{e.name}" if folder else e.name
        try:
            if e.is_dir():
                if e.name != "node_modules" and e.name[0] != ".":
                    out.append((path, True, os.path.realpath(e.path), None, None))
            elif e.is_file():
                s = e.stat()
                out.append((path, False, None, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC)))
        except OSError:
            continue
    return out


def _listed(folders: DataFrame, root: str, follow: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                if found := _entries(root, folder, follow):
                    columns = zip(("string", "bool", "string", "int64", "timestamp"), zip(*found))
                    kinds = {"string": pa.string(), "bool": pa.bool_(), "int64": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
                    yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for k, x in columns], ["path", "folder", "real", "size", "mtime"])

    return folders.select("path").mapInArrow(run, FOUND)


def listing(spark: SparkSession, root: str, pin: str | None = None, follow: bool = False) -> DataFrame:
    """path, size, mtime of the files below root; tasks list the directories of a level, and what they find is the next level.

    The driver holds no paths. A level's directories are dealt out anew, so no subtree is one task's work. With links followed, each
    place is listed once, by its shortest path, the first of equal ones. A pin starts there, hidden or not; a pinned file is listed itself.
    Depth ends at TREE_DEPTH. A directory that can't be read is empty.
    """
    full = checked_root(root)
    start = os.path.join(full, pin) if pin else full
    if os.path.isfile(start):
        s = os.stat(start)
        return spark.createDataFrame([(pin, s.st_size, datetime.fromtimestamp(s.st_mtime, UTC))], LISTED)
    folders = spark.createDataFrame([(pin or "", os.path.realpath(start))], "path string, real string")
    seen, found = folders.select("real"), []
    for _ in range(TREE_DEPTH + 1):
        level = stored(_listed(folders, full, follow))
        found.append(level.filter("NOT folder").select("path", "size", "mtime"))
        folders = level.filter("folder").select("path", "real")
        if follow:
            first = F.min(F.struct(F.length("path").alias("n"), "path"))
            folders = stored(folders.join(small(seen), "real", "left_anti").groupBy("real").agg(first.alias("x")).select("x.path", "real"))
            seen = seen.unionByName(folders.select("real"))
        if folders.limit(1).count() == 0:
            break
        folders = folders.repartition("path")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def last_line_end(head: Column) -> Column:
    """How many bytes the whole lines of some bytes have; 0 where there is no end of a line."""
    each_byte_a_char = F.decode(head, "ISO-8859-1")
    back = F.locate("\n", F.reverse(each_byte_a_char))
    return F.when(back > 0, F.length(head) - back + 1).otherwise(0)


def bounded(content: Column, most: int = READ_BYTES) -> Column:
    """struct(status, text, bytes, truncated) of a file's first bytes (most + 1 are enough).

    status: io (null content: it could not be read), binary (a NUL among the first bytes), empty (nothing but blanks), else text; the text of
    more than `most` bytes is cut back to its last whole line, or to `most` bytes where that is a part of one line. Text stands with
    status text alone.
    """
    long = F.length(content) > most
    head = F.substring(content, 1, most)
    kept = F.when(long, F.when(last_line_end(head) > 0, F.substring(content, F.lit(1), last_line_end(head))).otherwise(head)).otherwise(content)
    text = F.regexp_replace(F.make_valid_utf8(kept.cast("string")), "^\ufeff", "")
    status = F.when(content.isNull(), "io").when(F.contains(F.substring(content, 1, PROBE_BYTES), F.lit(b"\0")), "binary").when(trimmed(text) == "", "empty").otherwise("text")
    good = status == "text"
    return F.struct(status.alias("status"), F.when(good, text).alias("text"), F.when(good, F.length(kept)).alias("bytes"), (good & long).alias("truncated"))


def _raw(listed: DataFrame, full: str, most: int, larger: bool) -> DataFrame:
    """listed with content: at most `most` + 1 bytes of each file, null where it can't be read (or, unless larger, is longer)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part, out = batch.slice(at, 16), []
                for path, size in zip(part.column("path").to_pylist(), part.column("size").to_pylist()):
                    try:
                        with open(os.path.join(full, path), "rb") as f:
                            out.append(f.read(most + 1) if larger or size <= most else None)
                    except OSError:
                        out.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "content"])

    return listed.select("path", "size", "mtime").mapInArrow(run, f"{LISTED}, content binary")


def reads(listed: DataFrame, root: str, most: int = READ_BYTES) -> DataFrame:
    """listed with status, text, bytes and truncated: files of any length, of which at most `most` bytes are read."""
    return _raw(listed, checked_root(root), most, True).select("path", "size", "mtime", bounded(F.col("content"), most).alias("r")).select("path", "size", "mtime", "r.*")


def contents(listed: DataFrame, root: str, most: int = FILE_BYTES) -> DataFrame:
    """listed with text: null where binary or larger than `most`, which is then never read."""
    rows = _raw(listed, checked_root(root), most, False)
    return rows.select("path", "size", "mtime", decoded(F.when(F.length("content") <= most, F.col("content"))).alias("text"))


def modified(spark: SparkSession, root: str) -> DataFrame | None:
    """path of files that git sees as changed; None where there is no work tree."""
    done = subprocess.run(["git", "-C", root, "status", "--porcelain", "-z"], capture_output=True, check=False)
    if done.returncode:
        return None
    parts, paths = done.stdout.decode(errors="replace").split("\0"), []
    while parts:
        line = parts.pop(0)
        if line:
            paths.append((line[3:],))
            if line[0] in "RC" and parts:
                parts.pop(0)  # where it was before
    return spark.createDataFrame(paths, "path string")

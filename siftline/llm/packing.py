"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are those of the `tokenizers` file, then one end id. Windows that one document fills are cut off first.
The rest of a document is cut into equal pieces of at most `piece` ids, so that a window takes several of them; in every
fourth row the rest is halved again and again instead, and its small pieces even out what the others leave. The pieces are
dealt by document into blocks of about `block_windows` windows, and each block is solved on its own: every piece starts as a
partial partition of k sums, all but one zero; the two with the largest spread (largest less smallest sum) are merged, largest
sums with smallest, until one partition is left. Its windows are near-equal. k is the least count that could hold the block
and rises whenever a window exceeds the capacity. Only lengths meet in a block, never ids or texts.

Edge cases: null and empty texts are the end id alone; repeated rows and null doc_ids are packed like any other row; a
document's pieces may lie in several sequences; ties are broken by the order of rows in the table; an empty table gives
no rows; extra columns are ignored. Texts that contain the file's special token get its id, as `tokenizers` gives it.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from bisect import insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import documents, slices, stored

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row_key long"


def encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> ids as little-endian bytes, equal to the `tokenizers` file's. They come from the same vocabulary's ranks
    (byte-level BPE, checked to agree, and faster); a text with a special token's string goes to `tokenizers` itself, which
    is loaded when the first such text comes."""
    import tiktoken

    from siftline.llm.tokens import load_ranks

    with open(json_path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    by_ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={}).encode_ordinary

    @lru_cache(1)
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        ids = whole().encode(text, add_special_tokens=False).ids if any(s in text for s in special) else by_ranks(text)
        return array("I", ids).tobytes()

    return encode


def cuts(n: int, capacity: int, piece: int, fine: bool = False) -> list[tuple[int, int]]:
    """(start, length): full windows, then near-equal pieces of at most `piece`; fine: each half of what is left at most."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    rest, at = n - full * capacity, full * capacity
    while fine and rest:
        length = min(piece, -(-rest // 2))
        out.append((at, length))
        at, rest = at + length, rest - length
    for i in range(parts := -(-rest // piece)):
        length = rest // parts + (i < rest % parts)
        out.append((at, length))
        at += length
    return out


def pieces(docs: DataFrame, paths: tuple[str, str, str], id_col: str, text_col: str, capacity: int, piece: int, end_id: int) -> DataFrame:
    def run(batches):
        encode = encoder(*paths)
        end = np.array([end_id], "<u4").tobytes()
        for part in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_key", "text"))):
                ids = encode(text) + end
                n = len(ids) // 4
                for start, length in cuts(n, capacity, piece, fine=key % 4 == 0):
                    for column, x in zip(out, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, key)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


def differencing(lengths: np.ndarray, k: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of the lengths in each of k windows. A partial partition lists its non-empty windows as
    (sum, number), ascending; the other windows of the k are empty."""
    members = [[i] for i in range(len(lengths))]
    spread = lambda a: a[-1][0] - (a[0][0] if len(a) == k else 0)
    heap = [(-spread(a), i, a) for i, x in enumerate(lengths.tolist()) for a in [[(x, i)]]]
    heapq.heapify(heap)
    serial = len(heap)

    def joined(x, y):
        members[x[1]] += members[y[1]]
        return x[0] + y[0], x[1]

    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if len(b) == 1:
            insort(a, joined(a.pop(0), b[0]) if over > 0 else b[0])
        elif over <= 0:
            a = sorted(a + b)
        else:  # the smallest of one with the largest of the other, and the reverse, until k are left
            a = sorted([*(joined(x, y) for x, y in zip(a[:over], reversed(b[:over]))), *a[over:], *b[over:]])
        heapq.heappush(heap, (-spread(a), serial, a))
        serial += 1
    return [members[i] for _, i in heap[0][2]] if heap else []


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`; the count rises from the least possible one until all fit."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        windows = differencing(lengths, k)
        if max((int(lengths[w].sum()) for w in windows), default=0) <= capacity:
            return [w for w in windows if w]
        k += 1


def packed(docs: DataFrame, paths: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, piece: int = 256, block_windows: int = 512, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids are even for windows that one document fills and odd (block and window) for packed ones.
    """
    found = stored(pieces(docs, paths, id_col, text_col, capacity, piece, end_id), "pieces")
    whole = found.filter(F.col("length") == capacity)
    whole = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(2) * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = found.filter(F.col("length") < capacity)
    total = parts.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / (capacity * block_windows)))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row_key", "start"], ignore_index=True)
        lengths = frame["length"].to_numpy()
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        for w, window in enumerate(pack(lengths, capacity)):
            window = sorted(window)  # a document's pieces stay in order
            sequence[window] = 2 * ((int(frame["block"].iloc[0]) << 20) + w) + 1
            offset[window] = np.concatenate(([0], np.cumsum(lengths[window])))[:-1]
        frame["sequence_id"], frame["offset"] = sequence, offset
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    solved = parts.withColumn("block", F.pmod(F.xxhash64("row_key"), F.lit(blocks))).groupBy("block").applyInPandas(solve, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(solved)


def public_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), public_paths())

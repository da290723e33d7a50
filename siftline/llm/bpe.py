"""Byte-level BPE by corpus-level merge replay.

Texts are cut into units that can be encoded apart (see tokens.units). A first pass counts the distinct units of the whole corpus.
The frequent ones, at most `table_units` of them, form a table whose partitions are each laid out as one corpus of symbols, with links to the
next and the previous symbol of the same word. An inverted index leads from a merge's rank to the positions of its pairs.
Merges are replayed over all positions in rank order; each touches only the pair and its two neighbours, whose new pairs enter the
index. As words don't touch each other, a step takes the positions of the next few thousand pairs, whatever their ranks, and merges in
each word those of the word's lowest rank; the others wait in the index. The ids go back to the tasks as a broadcast of bounded size. A second pass encodes the texts: units beyond the table,
most of which occur once, are replayed where they stand, by the same replay over a block of texts. Words that are in the
vocabulary get their id at once, as `tiktoken` gives it. A very long word costs no more per symbol than a short one.

A merge that gives rise to a pair of lower rank would have to yield to it (always the lowest pair, leftmost first); a word to
which that happens is encoded apart in exactly that order.

Edge cases: null and empty texts have no ids; ids decode to exactly the text's UTF-8 bytes; repeated rows, null doc_ids and
extra columns make no difference; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import documents, slices, stored
from siftline.llm.tokens import load_ranks

#: Units beside the table that a block hands on to the next: few of them come again.
BLOCK_MEMO = 100_000
#: Bytes of text whose new units are replayed together.
BLOCK_BYTES = 4 << 20
#: Characters of units that a task remembers from block to block; characters of a unit that may come into the corpus's table.
MEMO_CHARS, TABLE_CHARS = 16 << 20, 64
#: Places of pairs that a step of the replay takes from its index, of as many ranks as it takes.
STEP_PAIRS = 1 << 12
#: Counts of units that a task holds, for about COUNTED_BYTES of text each, before it sums them; those that it hands on at once.
COUNTED_ROWS, COUNTED_BYTES, HANDED_ROWS = 1_000_000, 8 << 20, 20_000
#: Bytes of UTF-8 that are white space, and those with which longer white space may begin.
SPACE_BYTES = np.array([chr(i).isspace() if i < 128 else False for i in range(256)])
SPACE_LEADS = np.isin(np.arange(256), sorted({chr(i).encode()[0] for i in range(128, 0x10000) if chr(i).isspace()}))


def changes(values: np.ndarray) -> np.ndarray:
    """Where a sorted array has another value than before."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


class MergeReplay:
    """Ranks (bytes -> id, single bytes included) and the merges that follow from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: left id << 32 | right id -> id of the two joined: every way to cut a token into two tokens.
        self.merges = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.sort(np.fromiter(self.merges, np.int64, len(self.merges)))
        self.values = np.array([self.merges[k] for k in self.keys.tolist()], np.int32)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they don't merge."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit bytes."""
        out = [self.ranks.get(w, -1).to_bytes(4, "little", signed=True) if w in self.ranks else b"" for w in words]
        todo = [i for i, x in enumerate(out) if not x and words[i]]
        if todo:
            ids, counts, odd = self.replay([words[i] for i in todo])
            data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            for i, start, end, again in zip(todo, (ends - 4 * counts).tolist(), ends.tolist(), odd.tolist()):
                out[i] = np.array(self.one(words[i]), "<u4").tobytes() if again else data[start:end]
        return out

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, their number by word, and the words to encode apart."""
        corpus = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        # A block has far fewer than 2^31 symbols: half the memory of 64-bit places.
        starts, places = ends - lengths, np.arange(len(corpus), dtype=np.int32)
        word, odd = np.repeat(np.arange(len(words), dtype=np.int32), lengths), np.zeros(len(words), bool)
        symbol, following, before = self.byte_ids[corpus], places + 1, places - 1
        following[ends - 1], before[starts] = -1, -1
        #: The inverted index: a merge's rank -> positions of its pairs' left symbols. current: the rank at a position now.
        current, index, queue = np.full(len(corpus), -1, np.int32), {}, []
        live = np.ones(len(corpus), bool)

        def enter(rank: np.ndarray, at: np.ndarray) -> None:
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank)
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(changes(rank))
            ranks, cuts = rank[cuts].tolist(), cuts.tolist()
            for r, start, end in zip(ranks, cuts, [*cuts[1:], len(at)]):
                if r in index:
                    index[r].append(at[start:end])
                else:
                    index[r] = [at[start:end]]
                    heapq.heappush(queue, r)

        inner = np.flatnonzero(following >= 0)
        current[inner] = self.joined(symbol[inner], symbol[inner + 1])
        enter(current, places)
        room = STEP_PAIRS
        while queue:
            some, met = [], 0
            while queue and met < room:
                r = heapq.heappop(queue)
                some += index[r]
                met += sum(map(len, index.pop(r)))
            p = np.concatenate(some)
            p = np.sort(p[(current[p] >= 0) & (current[p] <= r)])  # else a neighbour's merge took one of the two
            p = p[changes(p)]
            if not len(p):
                continue
            rank = current[p]
            heads = np.flatnonzero(changes(word[p]))
            later = p[:0]
            if len(heads) < len(p):  # of the pairs of one word those of its lowest rank; the others wait
                lowest = rank == np.repeat(np.minimum.reduceat(rank, heads), np.diff(heads, append=len(p)))
                p, rank, later = p[lowest], rank[lowest], p[~lowest]
            room = min(2 * room, STEP_PAIRS) if len(p) >= len(later) else max(1, room // 2)
            q = following[p]
            chained = np.concatenate(([False], q[:-1] == p[1:]))
            if chained.any():  # of a run like a a a a every other pair, from its left
                at = np.arange(len(p))
                odd_place = (at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 1
                p, q, rank = p[~odd_place], q[~odd_place], rank[~odd_place]
            after = following[q]
            # Where the next pair merges too: the left one, which comes first, may join with that one's left symbol before.
            beside = np.flatnonzero(after[:-1] == p[1:])
            early = self.joined(rank[beside], symbol[after[beside]])
            odd[word[p[beside[(early >= 0) & (early <= rank[beside])]]]] = True
            symbol[p], following[p], current[q], live[q] = rank, after, -1, False
            inside = np.flatnonzero(after >= 0)
            before[after[inside]] = p[inside]
            right = np.full(len(p), -1, np.int32)
            right[inside] = self.joined(rank[inside], symbol[after[inside]])
            current[p] = right
            prior = before[p]
            inside = np.flatnonzero(prior >= 0)
            prior, own = prior[inside], rank[inside]
            left = self.joined(symbol[prior], own)
            current[prior] = left
            odd[word[p[(right >= 0) & (right <= rank)]]] = True
            odd[word[prior[(left >= 0) & (left <= own)]]] = True
            enter(np.concatenate((right, left, current[later])), np.concatenate((p, prior, later)))
        return symbol[live], np.bincount(word[live], minlength=len(words)), odd

    def one(self, word: bytes) -> list[int]:
        """Ids of a word, by the lowest pair, leftmost first."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        following, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        get = self.merges.get
        current = [get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])] + [-1]
        heap = [(r, i) for i, r in enumerate(current) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, p = heapq.heappop(heap)
            if current[p] != r:
                continue
            q = following[p]
            after, prior = following[q], before[p]
            ids[p], following[p], current[q] = r, after, -1
            current[p] = get(r << 32 | ids[after], -1) if after >= 0 else -1
            if after >= 0:
                before[after] = p
            if prior >= 0:
                current[prior] = get(ids[prior] << 32 | r, -1)
            for at in (p, prior):
                if at >= 0 and current[at] >= 0:
                    heapq.heappush(heap, (current[at], at))
        out, p = [], 0
        while p >= 0:
            out.append(ids[p])
            p = following[p]
        return out


class Numbers(dict):
    """Numbers words from 0 as they come, and lists them."""

    def __init__(self):
        self.listed, self.chars = [], 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.listed)
        self.listed.append(word)
        self.chars += len(word)
        return n


@lru_cache(maxsize=1)
def replay_of(ranks_path: str) -> MergeReplay:
    """The merges of a rank file, worked out once in a Python process."""
    return MergeReplay(load_ranks(ranks_path))


#: Units, and the ids of each.
Known = tuple[pa.StringArray, pa.BinaryArray]


def known_of(ids: dict[str, bytes]) -> Known:
    return pa.array(ids.keys(), pa.string()), pa.array(ids.values(), pa.binary())


class BlockEncoder:
    """Encodes blocks of texts with a table of units whose ids are known; words that blocks add to it are dropped once they are many.

    The texts' bytes stay in Arrow buffers: units are stretches between offsets, their numbers come from a dictionary of the block, and
    ids are taken by number, so that Python sees only the distinct units beside the table.
    """

    def __init__(self, replay: MergeReplay | dict[bytes, int], pattern: str, known: Known | dict[str, bytes] = ()):
        self.replay = replay if isinstance(replay, MergeReplay) else MergeReplay(replay)
        self.findall = regex.compile(pattern).findall
        self.known, self.known_ids = known_of(known) if isinstance(known, dict) else known or known_of({})
        self.clear()

    def clear(self) -> None:
        self.numbers, self.ids = Numbers(), []

    def solve(self, fresh: list[str]) -> pa.BinaryArray:
        """Ids of units that are not in the table; words that have none yet get theirs in one replay."""
        # Units that begin with a space and another character are cut from one text as they are one by one.
        apart = [i for i, u in enumerate(fresh) if len(u) < 2 or u[0] != " " or u[1].isspace()]
        order = np.concatenate((np.array(apart, np.int64), np.delete(np.arange(len(fresh)), apart)))
        ordered = [fresh[i] for i in order.tolist()]
        flat = [w for u in ordered[: len(apart)] for w in self.findall(u)] + self.findall("".join(ordered[len(apart) :]))
        stops, lengths = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat))), np.cumsum(np.fromiter(map(len, ordered), np.int64, len(ordered)))
        if len(flat) and stops[-1] == lengths[-1]:
            ends = np.searchsorted(stops, lengths, side="right")  # words up to the end of each unit
        else:  # a pattern that leaves characters out
            words = list(map(self.findall, ordered))
            flat, ends = [w for ws in words for w in ws], np.cumsum([len(ws) for ws in words])
        numbers = np.fromiter(map(self.numbers.__getitem__, flat), np.int32, len(flat))
        self.ids += self.replay.encode([w.encode("utf-8") for w in self.numbers.listed[len(self.ids) :]])
        return regrouped(pa.array(self.ids, pa.binary()).take(pa.array(numbers)), ends).take(pa.array(np.argsort(order)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        return self.joined([stretches(pa.array(texts, pa.string()))]).to_pylist()

    def joined(self, cuts: list[tuple[pa.StringArray, np.ndarray]]) -> pa.BinaryArray:
        """Ids of each text of a block, cut by `stretches`."""
        distinct = pa.chunked_array([x for x, _ in cuts], pa.string()).combine_chunks().dictionary_encode()
        listed = distinct.dictionary
        at = pc.index_in(listed, value_set=self.known)
        new = pc.is_null(at)
        fresh = listed.filter(new).to_pylist()
        ids, places = self.known_ids, pc.fill_null(at, 0).to_numpy(zero_copy_only=False).copy()
        if fresh:
            ids = pa.concat_arrays([ids, self.solve(fresh)])
            places[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        counts = np.cumsum([0, *(len(x) for x, _ in cuts)])
        ends = np.concatenate([n + ends for n, (_, ends) in zip(counts, cuts)]) if cuts else np.zeros(0, np.int64)
        out = regrouped(ids.take(pa.array(places[distinct.indices.to_numpy()])), ends)
        if len(self.ids) > BLOCK_MEMO or self.numbers.chars > MEMO_CHARS:
            self.clear()
        return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a column of strings or binary values, from 0, and its bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def regrouped(values: pa.BinaryArray, ends: np.ndarray) -> pa.BinaryArray:
    """Values joined: each up to the given number of values, from where the one before ends."""
    offsets, data = buffers(values)
    offsets = np.concatenate(([0], offsets[ends])).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def stretches(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The units of all texts (those of tokens.units, null: none) over the texts' own bytes, and the number of units up to each text's end."""
    offsets, data = buffers(pc.fill_null(texts, ""))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(data == 32)
    at = at[~edge[at + 1]]  # a space that ends a text begins no unit
    follows = data[at + 1]
    at = at[~SPACE_BYTES[follows]]
    doubtful = np.flatnonzero(SPACE_LEADS[data[at + 1]])
    if len(doubtful):
        loose = [bytes(data[i + 1 : i + 4]).decode("utf-8", "ignore")[:1].isspace() for i in at[doubtful].tolist()]
        at = np.delete(at, doubtful[loose])
    edge[at] = True
    starts = np.flatnonzero(edge[:-1])
    cuts = np.append(starts, len(data)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(data))
    return found, np.searchsorted(starts, offsets[1:])


def counted(texts: DataFrame, step_bytes: int = COUNTED_BYTES, most_rows: int = COUNTED_ROWS) -> DataFrame:
    """unit, n: how often each unit of at most TABLE_CHARS characters occurs in the column text. (A text without spaces is one unit.)"""

    def summed(held):
        table = pa.Table.from_arrays([pa.concat_arrays(x) for x in zip(*held)], ["unit", "n"])
        return table.group_by("unit", use_threads=False).aggregate([("n", "sum")]).rename_columns(["unit", "n"]) if len(held) > 1 else table

    def run(batches):
        block, size, held, rows = [], 0, [], 0

        def folded():
            counts = pa.chunked_array(block, pa.string()).value_counts()
            counts = counts.filter(pc.less_equal(pc.utf8_length(counts.field("values")), TABLE_CHARS))
            held.append((counts.field("values"), counts.field("counts")))
            return len(counts)

        for part in slices(batches, "text", 2 << 20):
            block.append(stretches(part.column("text"))[0])
            size += part.column("text").nbytes
            if size > step_bytes:
                rows += folded()
                block, size = [], 0
            if rows > most_rows:
                yield from summed(held).to_batches(HANDED_ROWS)
                held, rows = [], 0
        if block:
            folded()
        if held:
            yield from summed(held).to_batches(HANDED_ROWS)

    return texts.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(texts: DataFrame, ranks_path: str, pattern: str, table_units: int) -> Known:
    """Ids of the most frequent units, at most table_units, none that occurs once or has more than TABLE_CHARS characters."""
    counts = stored(counted(texts).filter("n > 1").withColumn("step", F.floor(4 * F.log2("n"))), "units")
    steps = sorted(counts.groupBy("step").count().collect(), reverse=True)  # a few hundred rows
    least, room = float("inf"), table_units
    for step, n in steps:
        room -= n
        if room < 0:
            break
        least = step

    def run(batches):
        block = BlockEncoder(replay_of(ranks_path), pattern)
        names = [u for b in batches for u in b.column("unit").to_pylist()]
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(block.encode(names), pa.binary())], ["unit", "ids"])

    if least == float("inf"):
        return known_of({})
    chosen = counts.filter(F.col("step") >= least).select("unit").repartition("unit")
    rows = chosen.mapInArrow(run, "unit string, ids binary").toArrow()  # at most table_units rows
    return rows["unit"].cast(pa.string()).combine_chunks(), rows["ids"].cast(pa.binary()).combine_chunks()


def decoded_batches(batches, ranks_path: str):
    """The batches with a column `decoded`, the bytes that the column ids stands for."""
    by_id = dict(sorted((i, b) for b, i in replay_of(ranks_path).ranks.items()))
    blob = np.frombuffer(b"".join(by_id.values()), np.uint8)
    length = np.zeros(max(by_id) + 1, np.int32)
    length[list(by_id)] = [len(b) for b in by_id.values()]
    first = np.cumsum(length, dtype=np.int32) - length
    for part in slices(batches, "ids", 1 << 19):
        offsets, held = buffers(part.column("ids"))
        ids = np.frombuffer(held.tobytes(), "<u4")
        sizes = length[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        data = blob[np.repeat(first[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate(([0], ends))[offsets // 4].astype(np.int32)
        texts = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(stops), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), table_units: int = 200_000, decoded: bool = False) -> DataFrame:
    """The kept columns and `ids` (binary, little-endian unsigned 32-bit) of each row's whole text; decoded: also what `decode` adds, in the same Python process."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(frequent(rows.select("text"), ranks_path, pattern, table_units))
    schema = rows.drop("text").withColumn("ids", F.lit(b"")).schema

    def run(batches):
        block = BlockEncoder(replay_of(ranks_path), pattern, known.value)
        held, cuts, size = [], [], 0

        def solved():
            flat, at = block.joined(cuts), 0
            for columns, n in held:
                yield pa.RecordBatch.from_arrays([*columns, flat.slice(at, n)], schema.names)
                at += n

        for part in slices(batches, "text", 2 << 20):
            held.append((part.columns[:-1], part.num_rows))
            cuts.append(stretches(part.column("text")))
            size += part.column("text").nbytes
            if size > BLOCK_BYTES:
                yield from solved()
                held, cuts, size = [], [], 0
        yield from solved()

    if decoded:
        found = rows.mapInArrow(lambda batches: decoded_batches(run(batches), ranks_path), rows.drop("text").withColumns({"ids": F.lit(b""), "decoded": F.lit(b"")}).schema)
    else:
        found = rows.mapInArrow(run, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *found.columns[len(keep) :])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The same rows with `decoded`, the bytes that the ids stand for."""
    schema = encoded.withColumn("decoded", F.lit(b"")).schema

    return encoded.mapInArrow(lambda batches: decoded_batches(batches, ranks_path), schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

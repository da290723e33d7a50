"""Language-model scoring with a probabilistic suffix tree over words.

A text's symbols are its lower-cased (A-Z) words and one end. The counts of all words are a distributed table over the whole
training corpus. The tree's states are contexts of up to `depth` words. A context is a candidate if it is frequent, and it is retained if
its next-symbol distribution diverges from that of its suffix: count x KL divergence >= `least_gain`
nats. Suffixes of retained contexts are retained. A state's distribution is smoothed by absolute discounting: what it has
not seen explicitly gets the left-over mass, dealt by the next shorter state, down to the root, which adds one to every
word's count and keeps one class for unknown words. A text is scored by walking it with the longest suffix that is a state.

The tree lies in two places. Contexts and successors with a relative frequency of `least_share` at least (so at most 1/least_share a
depth, whatever the corpus) are broadcast as sorted arrays; deeper contexts are counted only where their parts were frequent, one
pass a depth. All other words that occur `least_count` times, a number that does not depend on the corpus, are contexts of one word: the
tree's distributed part, which grows with the corpus. Its states lie in a table by hash beside the words' counts, each with its
left-over mass and its explicit frequent successors, and each occurrence of such a word is joined with it, for its own
count and for what it says of the next symbol. Log probabilities add up, so both parts are scored apart and summed by text.

Edge cases: a null or empty text is the end symbol alone; null doc_ids count as training rows (the remainder of empty text);
repeated rows are scored and counted each; an empty table gives no rows; with no training rows every symbol is unknown
and its probability is one. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import byte_class, documents, numbered, remainder, slices, starts_of, stored, sum_by, utf8

#: The end symbol's hash.
END = 0
#: Distinct keys a task gathers before it hands on what it has counted.
TABLE_ROWS = 1_000_000
#: Bytes of text that are hashed at a time.
SLICE = 2 << 20
#: A random number for each byte at each place in a block of eight, and an odd step between blocks.
PLACES, STEP = np.random.default_rng(20).integers(1 << 64, size=8 * 256, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WHITE = byte_class(b" \t\n\x0b\x0c\r")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all symbols of all texts, and each text's number of symbols.

    Eight bytes of a word are summed by a table for each place, each such block is mixed with its number, and the mixed blocks are summed and mixed
    again: unlike a polynomial modulo a power of two, this gives no two words of a regular build the same hash.
    """
    flat, offsets = utf8(texts)
    inside = ~WHITE[flat]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(flat)]] = inside[offsets[:-1][offsets[:-1] < len(flat)]]
    begins, where = np.flatnonzero(first), np.flatnonzero(inside)
    at = np.flatnonzero(first[where])
    sizes = np.diff(np.append(at, len(where)))
    place = np.arange(len(where), dtype=np.int32) - np.repeat(at.astype(np.int32), sizes)
    within = (place & 7).astype(np.uint16)
    blocks = np.flatnonzero(within == 0)
    if len(at):
        sums = np.add.reduceat(PLACES.take((within << 8) | LOWER[flat[where]]), blocks)
        sums = mixed(sums + (place[blocks] >> 3).astype(np.uint64) * STEP)
        h = mixed(np.add.reduceat(sums, starts_of((sizes + 7) >> 3))).view(np.int64)
    else:
        h = np.zeros(0, np.int64)
    n_words = np.diff(np.searchsorted(begins, offsets))
    out = np.full(len(begins) + len(texts), END, np.int64)
    out[np.arange(len(begins)) + np.repeat(np.arange(len(texts)), n_words)] = h
    return out, n_words + 1


def tallied(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    merged, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return merged, np.bincount(inverse, np.concatenate(counts), len(merged)).astype(np.int64)


def tallies(batches, keys_of):
    """Record batches (key, next, n) of what keys_of(texts) gives: keys, which are summed within the task as far as TABLE_ROWS
    allows and have next -2, and pairs (key, next) that are handed on as they are."""
    keys, counts, held = [], [], 0

    def batch(k, following, n):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(following, pa.int32()), pa.array(n)], ["key", "next", "n"])

    for part in slices(batches, "text", SLICE):
        some, pairs = keys_of(part.column("text"))
        if len(pairs[0]):
            yield batch(pairs[0], pairs[1].astype(np.int32), np.ones(len(pairs[0]), np.int64))
        k, n = np.unique(some, return_counts=True)
        keys.append(k)
        counts.append(n)
        held += len(k)
        if held > 2 * TABLE_ROWS:
            keys, counts = map(lambda x: [x], tallied(keys, counts))
            held = len(keys[0])
            if held > TABLE_ROWS:
                yield batch(keys[0], np.full(held, -2, np.int32), counts[0])
                keys, counts, held = [], [], 0
    if held:
        k, n = tallied(keys, counts)
        yield batch(k, np.full(len(k), -2, np.int32), n)


NO_PAIRS = np.zeros(0, np.int64), np.zeros(0, np.int32)


def counted(texts: DataFrame, keys_of) -> DataFrame:
    """key, next, n: how often each occurs in all texts."""
    return texts.select("text").mapInArrow(lambda batches: tallies(batches, keys_of), "key long, next int, n long").groupBy("key", "next").agg(F.sum("n").alias("n"))


class Places:
    """Places of keys in a table, by buckets of a hash: a few reads near each other for each key, where a binary search takes twenty far apart."""

    def __init__(self, table: np.ndarray):
        self.table = table  # kept, so that no other array gets its id
        self.shift = np.uint64(64 - max(1, int(2 * len(table) - 1).bit_length()))
        bucket = self.bucket(table)
        self.order = np.argsort(bucket, kind="stable").astype(np.int32)
        self.keys = table[self.order]
        self.starts = np.searchsorted(bucket[self.order], np.arange((1 << int(64 - self.shift)) + 1)).astype(np.int32)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * STEP) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        bucket = self.bucket(keys)
        at, ends = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(keys), -1)
        left = np.flatnonzero(at < ends)
        at, ends = at[left], ends[left]
        while len(left):
            same = self.keys[at] == keys[left]
            out[left[same]] = self.order[at[same]]
            on = ~same & (at + 1 < ends)
            left, at, ends = left[on], at[on] + 1, ends[on]
        return out


#: Tables of this size and more get an index, as soon as that many keys are looked up in them; the last few are kept.
INDEXED, INDEXES = 4096, 16
_places: dict[int, Places] = {}


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place in the sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    if len(table) >= INDEXED and len(keys) >= INDEXED:
        known = _places.get(id(table))
        if known is None:
            while len(_places) >= INDEXES:
                _places.pop(next(iter(_places)))
            known = _places[id(table)] = Places(table)
        return known.of(np.ascontiguousarray(keys))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Level:
    """Contexts of one length: a context's key is (place of its first words, last word) in the arrays of the level before."""

    keys: np.ndarray  # sorted: parent context's number * width + word's number
    counts: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted: context's number * width + next word's number
    pair_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # retained
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of each pair's smoothed probability
    left: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of the mass for what is not explicit


@dataclass
class Tree:
    """words: sorted hashes of the frequent words. levels[0] has each of them as a context, levels[k] contexts of k+1 words."""

    words: np.ndarray
    word_counts: np.ndarray
    total: int
    distinct: int
    levels: list[Level] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.words) + 1

    def contexts(self, codes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """For each depth, the number of the context that ends just before each symbol (-1: none)."""
        out = []
        begins = np.zeros(len(codes), bool)
        begins[starts_of(lengths)[lengths > 0]] = True
        before = np.concatenate(([-1], codes[:-1]))
        before[begins] = -1
        here = find(self.levels[0].keys, before) if self.levels else before
        here[before < 0] = -1
        out.append(here)
        for level in self.levels[1:]:
            prior = np.concatenate(([-1], out[-1][:-1]))
            prior[begins] = -1
            key = prior * self.width + before
            found = find(level.keys, key)
            found[(prior < 0) | (before < 0)] = -1
            out.append(found)
        return out[: len(self.levels)]

    def root(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))


def grow(tree: Tree, texts: DataFrame, depth: int, least: int, least_gain: float, discount: float) -> DataFrame:
    """Add contexts and their successors depth by depth, smooth them and test them against their suffixes. Returns the
    stored successors (key, next, n) of words that are not in the tree: their hash, the next symbol's number."""
    spark = texts.sparkSession
    tree.levels.append(Level(np.arange(len(tree.words)), tree.word_counts))
    apart = None
    for at in range(depth):
        level = tree.levels[at]
        shared = spark.sparkContext.broadcast(tree)  # at most 1/least_share contexts and pairs a depth

        def keys_of(batch, shared=shared, at=at):
            own = shared.value
            hashes, lengths = symbols(batch)
            codes = find(own.words, hashes)
            context = own.contexts(codes, lengths)[-1]
            ok = (context >= 0) & (codes >= 0)
            return context[ok] * own.width + codes[ok], (pairs_after_rare(hashes, codes, lengths) if at == 0 else NO_PAIRS)

        found = counted(texts, keys_of).filter((F.col("next") == -2) & (F.col("n") >= least) | (F.col("next") >= 0) & (F.col("n") > 1))
        found = stored(found, "pairs")
        if at == 0:
            apart = found.filter("next >= 0")
        found = found.filter("next = -2").toPandas().sort_values("key")
        level.pairs, level.pair_counts = found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
        smooth(tree, at, discount)
        if at + 1 < depth:  # a pair is a context one word longer; never before the end symbol
            end = find(tree.words, np.array([END]))[0]
            inner = level.pairs % tree.width != end
            tree.levels.append(Level(level.pairs[inner], level.pair_counts[inner]))
    test(tree, least_gain)
    return apart


def pairs_after_rare(hashes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that are not in the tree before symbols that are: their hashes, and the symbols' numbers."""
    here = np.flatnonzero((codes[:-1] < 0) & (codes[1:] >= 0) & (hashes[:-1] != END))  # nothing comes after an end
    return hashes[here], codes[here + 1]


def rare_contexts(counts: DataFrame, apart: DataFrame, tree: Tree, least_count: int, least_gain: float, discount: float) -> DataFrame:
    """The distributed states: key, left (log10 of the left-over mass), next (numbers of explicit successors), gain (log10 of
    each one's probability over what it has from the left-over mass). A word outside the tree has few occurrences, so few successors."""
    shared = counts.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        own = shared.value
        for batch in batches:
            total = batch.column("total").to_numpy().astype(float)
            lists = batch.column("found")
            flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
            following, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("next", "n"))
            row = np.repeat(np.arange(len(size)), size)
            root = 10 ** own.root(own.word_counts[following])
            direct = (n - discount) / total[row]
            left = 1 - np.bincount(row, direct, len(size))
            rest = np.maximum(1 - np.bincount(row, n, len(size)) / total, 0)
            other = np.clip(1 - np.bincount(row, root, len(size)), 1e-12, 1)
            gain = np.bincount(row, n * np.log(n / total[row] / root), len(size)) + np.where(rest > 0, total * rest * np.log(np.maximum(rest, 1e-12) / other), 0)
            state = gain >= least_gain
            more = np.log10(direct / (left[row] * root) + 1)
            keep = state[row]
            ends = np.concatenate(([0], np.cumsum(size[state]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").filter(pa.array(state)), pa.array(np.log10(left[state])), pa.ListArray.from_arrays(pa.array(ends), pa.array(following[keep].astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(more[keep]))],
                ["key", "left", "next", "gain"],
            )

    known = counts.filter(F.col("n") >= least_count).withColumnRenamed("n", "total")
    grouped = apart.groupBy("key").agg(F.collect_list(F.struct("next", "n")).alias("found")).join(known, "key").select("key", "total", "found")
    return stored(grouped.mapInArrow(run, "key long, left double, next array<int>, gain array<double>"), "rare-contexts")


def smooth(tree: Tree, at: int, discount: float) -> None:
    level = tree.levels[at]
    context = level.pairs // tree.width
    counts = level.counts.astype(float)
    seen = np.bincount(context, level.pair_counts - discount, len(counts))
    level.left = np.log10(np.maximum(1 - seen / np.maximum(counts, 1), 1e-9))
    level.logs = (level.pair_counts - discount) / counts[context]  # direct part; made whole in test()


def suffix(tree: Tree, at: int) -> np.ndarray:
    """Number of each context's suffix (one word shorter) in the level before."""
    level, width = tree.levels[at], tree.width
    last = level.keys % width
    if at == 1:
        return last
    parent = level.keys // width
    key = suffix(tree, at - 1)[parent] * width + last
    return find(tree.levels[at - 1].keys, key)


def test(tree: Tree, least_gain: float) -> None:
    """Retain contexts that diverge from their suffixes; give pairs the log10 of their interpolated probability."""
    width = tree.width
    for at, level in enumerate(tree.levels):
        context, word = level.pairs // width, level.pairs % width
        counts = level.counts.astype(float)
        if at == 0:
            shorter = 10 ** tree.root(tree.word_counts[word])
        else:
            below, up = tree.levels[at - 1], suffix(tree, at)
            pair = find(below.pairs, up[context] * width + word)
            # Every suffix pair is at least as frequent, so it is explicit below.
            shorter = np.where(pair >= 0, 10 ** below.logs[np.maximum(pair, 0)], 0.0)
        whole = level.logs + 10 ** level.left[context] * shorter
        gain = np.bincount(context, level.pair_counts * np.log(np.maximum(level.pair_counts / counts[context], 1e-12) / np.maximum(shorter, 1e-300)), len(counts))
        rest = np.maximum(1 - np.bincount(context, level.pair_counts, len(counts)) / np.maximum(counts, 1), 0)
        rest_shorter = np.clip(1 - np.bincount(context, shorter, len(counts)), 1e-12, 1)
        gain = gain + np.where(rest > 0, counts * rest * np.log(np.maximum(rest, 1e-12) / rest_shorter), 0)
        level.logs, level.state = np.log10(whole), gain >= least_gain
    for at in range(len(tree.levels) - 1, 0, -1):
        tree.levels[at - 1].state[suffix(tree, at)[tree.levels[at].state]] = True


def walk(tree: Tree, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol: log10 probability without the root's part of rare words, its frequent word's number (-1: rare), and its depth."""
    codes = find(tree.words, hashes)
    known = codes >= 0
    score = np.where(known, tree.root(tree.word_counts[np.maximum(codes, 0)]) if len(tree.words) else 0.0, 0.0)
    used = np.zeros(len(codes), np.int8)
    for at, (level, context) in enumerate(zip(tree.levels, tree.contexts(codes, lengths)), 1):
        here = np.nonzero(context >= 0)[0]
        here = here[level.state[context[here]]]
        if not len(here):
            continue
        used[here] = at
        pair = find(level.pairs, context[here] * tree.width + np.maximum(codes[here], 0))
        pair[codes[here] < 0] = -1
        # Not explicit: the left-over mass times the shorter state's probability, which score holds so far.
        score[here] = np.where(pair >= 0, level.logs[np.maximum(pair, 0)] if len(level.pairs) else 0.0, score[here] + level.left[context[here]])
    return score, codes, used


@dataclass
class Model:
    """The broadcast tree, the stored counts (key, n) of all words, and the stored states outside the tree (see rare_contexts)."""

    tree: Tree
    counts: DataFrame
    rare: DataFrame


def learn(texts: DataFrame, least_share: float = 1e-6, least_count: int = 4, depth: int = 3, least_gain: float = 12.0, discount: float = 0.6) -> Model:
    """texts: text."""
    counts = stored(counted(texts, lambda batch: (symbols(batch)[0], NO_PAIRS)).select("key", "n"), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(least_count, math.ceil(least_share * total))
    frequent = counts.filter(F.col("n") >= least).toPandas().sort_values("key")  # at most 1/least_share rows
    tree = Tree(frequent["key"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), int(total), int(distinct))
    apart = grow(tree, texts, depth, least, least_gain, discount)
    return Model(tree, counts, rare_contexts(counts, apart, tree, least_count, least_gain, discount))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, n_tokens, n_known, base_score (unigram), score, mean_depth (words of context used a symbol)."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    more = "n_tokens long, n_known long, base double, score double, depths long, rare array<struct<key:bigint,next:int>>"
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), more])
    tree = model.tree
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        own = shared.value
        for part in slices(batches, "text", SLICE):
            hashes, lengths = symbols(part.column("text"))
            s, codes, used = walk(own, hashes, lengths)
            known = codes >= 0
            c = np.where(known, own.word_counts[np.maximum(codes, 0)] if len(own.words) else 0, 0)
            base = np.where(known, np.log10((c + 1) / (own.total + own.distinct + 1)), 0.0)
            following = np.append(codes[1:], -1)
            following = np.where(hashes == END, -1, following)[~known].astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(sum_by(~known, lengths)))).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(hashes[~known]), pa.array(following)], ["key", "next"]))
            columns = [pa.array(lengths), pa.array(sum_by(known, lengths)), pa.array(sum_by(base, lengths)), pa.array(sum_by(s, lengths)), pa.array(sum_by(used, lengths).astype(np.int64)), rare]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], [*names, "n_tokens", "n_known", "base", "score", "depths", "rare"])

    found = numbered(stored(rows.mapInArrow(run, schema), "scores"), "row")
    # Words outside the tree: their counts and what they say of the next symbol come by hash.
    one = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(tree.total + tree.distinct + 1))
    words = found.select("row", F.explode("rare").alias("x")).select("row", F.col("x.key").alias("key"), F.col("x.next").alias("following"))
    state = model.rare.select("key", "left", "next", "gain")
    place = F.array_position("next", F.col("following"))
    said = F.coalesce(F.col("left") + F.when(place > 0, F.get("gain", (place - 1).cast("int"))).otherwise(0.0), F.lit(0.0))
    apart = words.join(model.counts, "key", "left").join(state, "key", "left").groupBy("row").agg(F.sum(one).alias("add"), F.sum(said).alias("said"), F.count("n").alias("more"), F.count("left").alias("deeper"))
    whole = found.join(apart, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), (F.col("base") + zero("add")).alias("base_score"),
        (F.col("score") + zero("add") + zero("said")).alias("score"), ((F.col("depths") + zero("deeper")) / F.col("n_tokens")).alias("mean_depth"),
    )


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.filter(remainder("doc_id", 7) != 2))
    found = score(docs, model)
    return found.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tree.total).cast("long").alias("train_tokens"), "base_score", "score", "mean_depth")

"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints are majorities over the hashes of word shingles. Equal fingerprints collapse to one class first, so copies never
meet each other again. The bits are dealt into m partitions that keep correlated bits together, and partition i gets a
threshold t_i of its own: classes that differ in t_i or fewer bits of it are candidates. A dynamic programme chooses m and the
t_i for the least estimated number of probes and candidates. Probes meet the index by partition and value, and every
candidate is verified. Components come from alternating large-star and small-star steps on the links.

`near_duplicates` finds all classes of 64-bit fingerprints within `max_bits` bits. There the t_i add up to max_bits - m + 1 (-1: the
partition is not probed): fingerprints that differ more in every partition differ in more than max_bits bits. A bucket whose
pairs would be too many is not capped: its members instead emit the points within half the radius, and all that share a
point are tied to its smallest close member. That gives the same components with work linear in the bucket.

`similar_documents` finds texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. At that limit two 128-bit
fingerprints of the sets differ in about 15 % of their bits, for which no exact set of thresholds is affordable. The programme
therefore chooses thresholds so that a pair at the limit is met in some partition with a chance of `recall`, whatever the corpus size; closer
pairs are met more surely. Candidates within `max_bits` of all bits are confirmed on the sets themselves, nearest pairs
first; later ones only where the first left their ends in different components. In a crowded bucket the minimum spanning forest stands for all pairs at first. Then
its members are dealt out to blocks, every two blocks meet in one task with their sets, and each pair that is still apart is tested there; what a task gives are the links
that join its components, no more than it has rows. So no link within a bucket is lost, and no pairs are handed on. A value that very many classes have
in a partition gets pivots: classes close to a pivot are linked to it and leave that partition to the others.

Edge cases: a text of fewer words than a shingle is one shingle, a text without words (or null) has fingerprint zero and
is linked like any other (in `similar_documents` to equal sets alone); null doc_ids are never a component's id unless nothing else is
in it (then the id is null); rows with one doc_id but different texts are rows like any other; repeated rows share class and
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import acos, comb, log, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import ROW, documents, numbered, slices, small, stored, words_of

BITS = 64
#: Pairs that a bucket may form at most; larger ones are linked through shared points.
BUCKET_PAIRS = 1024
#: Masks of a partition at most; a threshold that needs more is not considered.
MASKS = 4096


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words, space-joined, as rows of 8 big-endian bytes."""
    if not words:
        return np.zeros((0, 8), np.uint8)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_digest
    out = [digest(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :])] or [digest(line, 42)]
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint as a signed integer."""
    hashes = shingle_hashes(words_of(text, lower=True), size)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """row_key, doc_id, fp per document, in the order of the table."""

    def run(batches):
        for part in slices(batches):
            fps = [fingerprint(t, size) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row_key"), part.column("doc_id"), pa.array(fps, pa.int64())], ["row_key", "doc_id", "fp"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "row_key long, doc_id long, fp long")


def bit_counts(classes: DataFrame, columns: tuple[str, ...] = ("fp",)) -> tuple[int, np.ndarray]:
    """Number of classes, and how many have bits i and j both set; the columns hold 64 bits each."""
    width = BITS * len(columns)

    def run(batches):
        total, n = np.zeros((width, width), np.int64), 0
        for batch in batches:
            sides = [np.unpackbits(batch.column(c).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1) for c in columns]
            bits = np.concatenate(sides, axis=1).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        cells = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    rows = classes.select(*columns).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # width * width + 1 rows
    cells = np.zeros(width * width + 1, np.int64)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(width, width)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits (0: highest) into m groups of near-equal width, each grown from its bits' strongest correlations."""
    p, bits = np.diag(both) / max(n, 1), len(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    left, groups = set(range(bits)), []
    for i in range(m):
        width = bits // m + (i < bits % m)
        rest = sorted(left)
        group = [rest[int(np.argmax(r[np.ix_(rest, rest)].sum(axis=1)))]]
        left.discard(group[0])
        while len(group) < width:
            rest = sorted(left)
            group.append(rest[int(np.argmax(r[np.ix_(rest, group)].sum(axis=1)))])
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def masks(width: int, radius: int) -> int:
    return sum(comb(width, d) for d in range(radius + 1))


def chances(group: list[int], differ: np.ndarray, most: int) -> np.ndarray:
    """Chance that two classes differ in 0 to `most` bits of the group."""
    at = np.zeros(most + 1)
    at[0] = 1.0
    for b in group:
        at = at * (1 - differ[b]) + np.concatenate(([0.0], at[:-1])) * differ[b]
    return at


def plan(n: int, both: np.ndarray, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition: none of the pairs within max_bits is missed, at the least estimated number of probes and candidates."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(1, max_bits + 2):
        groups = correlated_groups(n, both, m)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            at = chances(group, differ, max_bits)
            cost = {-1: 0.0} | {t: float(n * masks(len(group), t) + 0.5 * n * n * at[: t + 1].sum()) for t in range(max_bits + 1) if masks(len(group), t) <= MASKS}
            following: dict[int, tuple[float, list[int]]] = {}
            for spent, (so_far, chosen) in states.items():
                for t, x in cost.items():
                    if spent + t not in following or so_far + x < following[spent + t][0]:
                        following[spent + t] = (so_far + x, [*chosen, t])
            states = following
        if max_bits - m + 1 in states and states[max_bits - m + 1][0] < best[0]:
            total, chosen = states[max_bits - m + 1]
            best = total, [(g, t) for g, t in zip(groups, chosen) if t >= 0]
    return best[1]


def limit_share(jaccard: float) -> float:
    """The share of bits in which the SimHashes of two sets differ, expected where their Jaccard similarity is this (sets of one size)."""
    return acos(2 * jaccard / (1 + jaccard)) / pi


#: Thresholds of a partition in `covering`: both ends emit the values within half of it, so that any two within it share one.
EVEN = (0, 2, 4)


def covering(n: int, both: np.ndarray, share: float, recall: float, row_cost: float = 300.0, most_parts: int = 16) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed partition: a pair that differs in each bit with chance `share` is met in one of them with
    chance `recall`, at the least estimated cost of emitted rows (row_cost each) and compared pairs."""
    p = np.diag(both) / max(n, 1)
    differ, same = 2 * p * (1 - p), np.full(len(both), share)
    unit = 0.02
    need = int(np.ceil(-log(1 - recall) / unit))
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(4, most_parts + 1):
        groups = correlated_groups(n, both, m)
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            at, met = chances(group, differ, max(EVEN)), chances(group, same, max(EVEN))
            options = {-1: (0.0, 0)}
            for t in EVEN:
                rows = masks(len(group), t // 2)
                if rows <= MASKS:
                    meetings = at[0] * rows + 2 * at[1 : t + 1].sum()
                    options[t] = (row_cost * n * rows + 0.5 * n * n * meetings, int(-log(max(1 - met[: t + 1].sum(), 1e-9)) / unit))
            following: dict[int, tuple[float, list[int]]] = {}
            for sure, (so_far, chosen) in states.items():
                for t, (x, gain) in options.items():
                    now = min(sure + gain, need)
                    if now not in following or so_far + x < following[now][0]:
                        following[now] = (so_far + x, [*chosen, t])
            states = following
        if need in states and states[need][0] < best[0]:
            total, chosen = states[need]
            best = total, [(g, t) for g, t in zip(groups, chosen) if t >= 0]
    return best[1]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def flips(bits: list[int], radius: int) -> list[list[int]]:
    """Signed masks that change d of the bits, by d from 0 to radius."""
    return [[signed(sum(1 << (BITS - 1 - b) for b in c)) for c in combinations(bits, d)] for d in range(radius + 1)]


def bucket_rows(classes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """part, value, indexed (the class's own value) and the columns of classes, for each key of each class."""
    own = classes.columns
    rows = []
    for i, (group, t) in enumerate(parts):
        value = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << (BITS - 1 - b) for b in group))))
        rows.append(classes.select(F.lit(i).alias("part"), value.alias("value"), *own, F.lit(True).alias("indexed")))
        if t:
            near = F.array(*[F.lit(x) for some in flips(group, t)[1:] for x in some])
            rows.append(classes.select(F.lit(i).alias("part"), F.explode(F.transform(near, lambda x: value.bitwiseXOR(x))).alias("value"), *own, F.lit(False).alias("indexed")))
    keys = rows[0]
    for other in rows[1:]:
        keys = keys.unionByName(other)
    return keys


def links(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) between classes (fp, node) that join exactly the components of all pairs within max_bits."""
    n, both = bit_counts(classes)
    if n < 2:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    keys = bucket_rows(classes, plan(n, both, max_bits))
    shared = keys.groupBy("part", "value").agg(F.sum(F.col("indexed").cast("long")).alias("i"), F.count(F.lit(1)).alias("p")).filter("i > 0 AND p > 1")
    shared = stored(shared, "simhash-buckets")
    met = stored(keys.join(shared, ["part", "value"]), "simhash-keys")
    large = F.col("i") * F.col("p") > BUCKET_PAIRS
    # Small buckets: every pair of an index row and a probe, verified.
    member = F.struct("fp", "node")
    pairs = met.filter(~large).groupBy("part", "value").agg(F.collect_list(F.when(F.col("indexed"), member)).alias("xs"), F.collect_list(member).alias("ys"))
    pairs = pairs.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    close = pairs.filter((F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits) & (F.col("x.node") != F.col("y.node")))
    found = close.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
    # Large buckets: members within max_bits of each other share a point that one reaches in half the bits.
    inner, outer = max_bits // 2, (max_bits + 1) // 2
    points = F.array(*[F.struct(F.lit(x).alias("mask"), F.lit(d <= inner).alias("core")) for d, some in enumerate(flips(list(range(BITS)), outer)) for x in some])
    crowd = met.filter(large).select("fp", "node").distinct()
    spots = crowd.select("fp", "node", F.explode(points).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m.mask")).alias("spot"), "node", "m.core")
    ties = spots.groupBy("spot").agg(F.min(F.when(F.col("core"), F.col("node"))).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND hub IS NOT NULL")
    tied = spots.join(stored(ties.select("spot", "hub"), "simhash-spots"), "spot").filter("node != hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))
    return found.unionByName(tied).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of each node that has a link; root: the smallest node reachable. edges: (a, b) with a > b."""
    edges = stored(edges, "links")
    said = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "large-star")
        edges = both.join(least, "a").filter("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        edges = stored(edges, "links")
        least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        edges = edges.join(least, "a")
        edges = edges.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(edges, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == said:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        said = now
    raise RuntimeError("components did not settle")


def forest(wide: np.ndarray, max_bits: int) -> np.ndarray:
    """Rows x 2: the minimum spanning forest of the rows (of 64-bit words) with links of max_bits or fewer (Prim's algorithm).

    It joins the same groups as all pairs do, whatever smaller number of bits one asks for.
    """
    left, out = np.arange(1, len(wide)), []
    best, parent, x = np.full(len(left), 1 << 30), np.zeros(len(left), np.int64), 0
    for m in range(len(left), 0, -1):
        bits = np.bitwise_count(wide[left[:m]] ^ wide[x]).sum(axis=1)
        closer = bits < best[:m]
        best[:m][closer], parent[:m][closer] = bits[closer], x
        at = int(np.argmin(best[:m]))
        x = int(left[at])
        if best[at] <= max_bits:
            out.append((parent[at], x))
        for some in (left, best, parent):
            some[at] = some[m - 1]
    return np.array(out, np.int64).reshape(-1, 2)


#: Rows of a bucket that are compared in all pairs, and near pairs a row that it may have; beyond, its minimum spanning forest is taken.
RUN, PAIRS = 2048, 8
#: A value gets so many pivots if it has more classes in its partition than CROWD and than OVER times the even share.
CROWD, OVER, PIVOTS = 4096, 8, 4
#: Rows of a crowded bucket, and members of their sets, in a block, of which two meet in a task; bytes of the common members as bits there.
UNIT_ROWS, UNIT_MEMBERS, UNIT_BYTES = 1024, 1 << 19, 32 << 20


class Spots:
    """Which values a class has in each partition, with those within half the threshold, as hashes; who is absorbed by a pivot."""

    def __init__(self, parts: list[tuple[list[int], int]], radius: int):
        self.parts = []
        for i, (group, t) in enumerate(parts):
            side = lambda half, some: np.uint64(sum(1 << (BITS - 1 - b % BITS) for b in some if b // BITS == half))
            near = [c for d in range(t // 2 + 1) for c in combinations(group, d)]
            self.parts.append((np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << BITS)), side(0, group), side(1, group), np.array([side(0, c) for c in near]), np.array([side(1, c) for c in near])))
        self.radius, self.crowds = radius, {}
        self.even = np.array([0.5 ** len(group) for group, _ in parts])

    @staticmethod
    def mixed(salt: np.uint64, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = (x ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31)) ^ y) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).astype(np.int64)

    def own(self, wide: np.ndarray) -> np.ndarray:
        """Classes x partitions: the hash of the class's own value."""
        return np.stack([self.mixed(i, wide[:, 0] & m0, wide[:, 1] & m1) for i, m0, m1, _, _ in self.parts], axis=1)

    def absorbed(self, wide: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Classes x partitions: whether a pivot is near; and (nodes, pivots) of each such meeting."""
        out, found = np.zeros((len(wide), len(self.parts)), bool), []
        if self.crowds:
            own = self.own(wide)
            for at in zip(*np.nonzero(np.isin(own, np.fromiter(self.crowds, np.int64, len(self.crowds))))):
                for w0, w1, pivot in self.crowds[int(own[at])]:
                    if pivot != node[at[0]] and int(np.bitwise_count(wide[at[0]] ^ np.array([w0, w1], np.uint64)).sum()) <= self.radius:
                        out[at] = True
                        found.append((node[at[0]], pivot))
                        break
                if any(pivot == node[at[0]] for _, _, pivot in self.crowds[int(own[at])]):
                    out[at] = False  # pivots themselves stay
        return out, found

    def rows(self, wide: np.ndarray, node: np.ndarray):
        """(spots, places) of all partitions."""
        out, _ = self.absorbed(wide, node)
        for k, (i, m0, m1, f0, f1) in enumerate(self.parts):
            here = np.flatnonzero(~out[:, k])
            spots = self.mixed(i, (wide[here, 0] & m0)[:, None] ^ f0, (wide[here, 1] & m1)[:, None] ^ f1)
            yield spots.ravel(), np.repeat(here, len(f0))


def wide_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy().astype(np.uint64) for c in ("wide0", "wide1")], axis=1)


def pairs_in_runs(spot: np.ndarray, wide: np.ndarray, node: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """[a, b, bits] of different nodes of a run of equal spots that are within max_bits; of a crowded run those that span its groups, and [spot, size, -1]."""
    begins = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1], [True])))
    size = np.diff(begins)
    crowded, run = size > RUN, np.repeat(np.arange(len(size)), size)
    end = np.where(crowded, begins[:-1], begins[1:])[run]
    found = [np.zeros((0, 2), np.int64)]
    left, d = np.arange(len(spot)), 1
    while len(left := left[left + d < end[left]]):
        near = np.bitwise_count(wide[left] ^ wide[left + d]).sum(axis=1) <= max_bits
        found.append(np.stack([left[near], left[near] + d], axis=1))
        d += 1
    pairs = np.concatenate(found)
    crowded |= np.bincount(run[pairs[:, 0]], minlength=len(size)) > PAIRS * size
    pairs = np.concatenate([pairs[~crowded[run[pairs[:, 0]]]], *(begins[at] + forest(wide[begins[at] : begins[at + 1]], max_bits) for at in np.flatnonzero(crowded))])
    x, y = pairs.T
    bits = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1).astype(np.int64)
    rows = np.stack([np.maximum(node[x], node[y]), np.minimum(node[x], node[y]), bits], axis=1)
    at = np.flatnonzero(crowded)
    marks = np.stack([spot[begins[at]], size[at], np.full(len(at), -1)], axis=1).astype(np.int64)
    rows = np.concatenate([np.unique(rows[rows[:, 0] != rows[:, 1]], axis=0), marks])
    return [rows[:, k] for k in range(3)]


def links_in_unit(side: np.ndarray, comp: np.ndarray, node: np.ndarray, flat: np.ndarray, sizes: np.ndarray, jaccard: float) -> list[tuple[int, int]]:
    """Pairs (larger, smaller node) of the unit's two sides (or of its one) with such sets that join different components, whatever their fingerprints.

    flat: the members of the sets, one set after the other. What is held is a few numbers for each of them, however many different ones there are: a
    common member, of at least one set in 64, is a bit of each set; the sets that have another one are listed with it.
    """
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    one = not len(first) or not len(second)
    if one:
        first = second = np.arange(len(side))
    _, group = np.unique(comp, return_inverse=True)
    _, name, often = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    common = np.flatnonzero(often * 64 >= len(sizes))
    common = common[np.argsort(-often[common], kind="stable")[: UNIT_BYTES * 8 // len(sizes)]]
    column = np.full(len(often), -1, np.int32)
    column[common] = np.arange(len(common))
    at = column[name]
    n_common = np.bincount(owner[at >= 0], minlength=len(sizes))
    bits = np.zeros((len(sizes), -(-len(common) // 64)), np.uint64)
    np.bitwise_or.at(bits, (owner[at >= 0], at[at >= 0] >> 6), np.uint64(1) << (at[at >= 0] & 63).astype(np.uint64))
    # The others that two sets have at least, by set and by name.
    left = (at < 0) & (often[name] > 1)
    name, owner = name[left], owner[left]
    ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
    having = owner[np.argsort(name, kind="stable")]
    often[common] = 0
    often[often == 1] = 0
    starts = np.cumsum(often) - often

    def enough(shared, i, others):
        return (shared > 0) & (shared >= jaccard * (sizes[others] + sizes[i] - shared) - 1e-9)

    out = []
    for i in first:
        others = second[second > i] if one else second
        others = others[group[others] != group[i]]
        names = name[ends[i] : ends[i + 1]]
        n = often[names]
        places = np.repeat(starts[names] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(having[places], minlength=len(sizes))[others]
        able = enough(shared + np.minimum(n_common[others], n_common[i]), i, others)
        others, shared = others[able], shared[able]
        shared = shared + np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
        for j in others[enough(shared, i, others)]:
            if group[i] != group[j]:
                out.append((max(node[i], node[j]), min(node[i], node[j])))
                group[group == group[j]] = group[i]
    return out


def crowd_links(crowd: DataFrame, found: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """a, b: the links that crowded spots still give between components. crowd: spot, size, node; found: node, root; sets: those of all the crowd's nodes."""
    named = sets.select(F.col("row_key").alias("node"), "shingles").join(found, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    long = crowd.join(sets.select(F.col("row_key").alias("node"), F.size("shingles").alias("members")), "node").groupBy("spot").agg(F.sum("members").alias("members"))
    blocks = F.ceil(F.greatest(F.col("size") / UNIT_ROWS, F.col("members") / UNIT_MEMBERS, F.lit(1))).cast("int")
    own = F.pmod(F.xxhash64("spot", "node"), blocks).cast("int")
    rows = crowd.join(small(stored(long, "crowd-members")), "spot").select("spot", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("spot", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node")
    keys = ["spot", "p", "q"]
    dealt = rows.join(named, "node").repartition(*keys).sortWithinPartitions(*keys)

    def solve(parts):
        table = pa.Table.from_batches(parts)
        comp, node = table.column("comp").to_numpy(), table.column("node").to_numpy()
        if len(np.unique(comp)) < 2:
            return []
        lists = table.column("shingles")
        return links_in_unit(table.column("side").to_numpy(), comp, node, pc.list_flatten(lists).to_numpy(), pc.list_value_length(lists).to_numpy(), jaccard)

    def run(batches):
        held, now = [], None
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), len(values)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                key = tuple(values[begin])
                if held and key != now:
                    yield from given(solve(held))
                    held = []
                now = key
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from given(solve(held))

    def given(pairs):
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def candidates(classes: DataFrame, share: float, recall: float, max_bits: int) -> tuple[DataFrame, DataFrame | None]:
    """a, b, bits: pairs of classes (wide0, wide1, node) that meet in a partition and differ in max_bits or fewer; and the members of crowded
    spots (spot, size, node), of whose pairs only some are given, None if there are no such spots."""
    spark = classes.sparkSession
    n, both = bit_counts(classes, ("wide0", "wide1"))
    schema = "a long, b long, bits long"
    if n < 2:
        return spark.createDataFrame([], schema), None
    spots = Spots(covering(n, both, share, recall), max_bits // 2)

    def values(batches):
        for batch in batches:
            own = spots.own(wide_of(batch))
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.tile(spots.even, len(own)))], ["value", "even"])

    often = F.col("n") > F.greatest(F.lit(CROWD), OVER * n * F.col("even"))
    crowds = stored(classes.mapInArrow(values, "value long, even double").groupBy("value", "even").agg(F.count(F.lit(1)).alias("n")).filter(often).select("value"), "crowds")
    if not crowds.isEmpty():  # at most partitions * classes / CROWD values

        def members(batches):
            wanted = known.value
            for batch in batches:
                own = spots.own(wide_of(batch))
                at, k = np.nonzero(np.isin(own, wanted))
                yield pa.RecordBatch.from_arrays([pa.array(own[at, k]), *(batch.column(c).take(pa.array(at)) for c in ("wide0", "wide1", "node"))], ["value", "wide0", "wide1", "node"])

        known = spark.sparkContext.broadcast(np.array([r["value"] for r in crowds.collect()], np.int64))
        draw = [F.min(F.struct(F.xxhash64(F.lit(i), "node"), "wide0", "wide1", "node")).alias(f"p{i}") for i in range(PIVOTS)]
        for r in classes.mapInArrow(members, "value long, wide0 long, wide1 long, node long").groupBy("value").agg(*draw).collect():
            spots.crowds[r["value"]] = list({x["node"]: (x["wide0"] & (1 << BITS) - 1, x["wide1"] & (1 << BITS) - 1, x["node"]) for x in r[1:]}.values())

    shared = spark.sparkContext.broadcast(spots)

    def emitted(batches):
        own = shared.value
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                for spot, at in own.rows(wide_of(part), part.column("node").to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array(spot), *(part.column(c).take(pa.array(at)) for c in ("wide0", "wide1", "node"))], ["spot", "wide0", "wide1", "node"])

    def to_pivots(batches):
        own = shared.value
        for batch in batches:
            wide, node = wide_of(batch), batch.column("node").to_numpy()
            _, found = own.absorbed(wide, node)
            rows = np.array([(max(x), min(x), 0) for x in found], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["a", "b", "bits"])

    def met(batches):
        """Batches are sorted by spot; the last run of one may go on in the next."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(parts):
            found = pairs_in_runs(*(np.concatenate(x) for x in zip(*parts)), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "bits"])

        for batch in batches:
            if batch.num_rows:
                spot, node, wide = batch.column("spot").to_numpy(), batch.column("node").to_numpy(), wide_of(batch)
                cut = int(np.searchsorted(spot, spot[-1]))
                if cut or (held and held[-1][0][-1] != spot[0]):
                    yield solve([*held, (spot[:cut], wide[:cut], node[:cut])])
                    held = []
                held.append((spot[cut:], wide[cut:], node[cut:]))
        if held:
            yield solve(held)

    keys = classes.mapInArrow(emitted, "spot long, wide0 long, wide1 long, node long")
    met_rows = stored(keys.repartition("spot").sortWithinPartitions("spot").mapInArrow(met, schema), "met")
    found = met_rows.filter("bits >= 0")
    if spots.crowds:
        found = found.unionByName(classes.mapInArrow(to_pivots, schema))
    pairs = found.groupBy("a", "b").agg(F.min("bits").alias("bits"))
    crowded = met_rows.filter("bits < 0").select(F.col("a").alias("spot"), F.col("b").alias("size"))
    if crowded.isEmpty():
        return pairs, None
    return pairs, stored(keys.join(small(crowded), "spot").select("spot", "size", "node").distinct(), "crowd")


def spans(text: str | None, size: int) -> list[bytes]:
    """The text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = words_of(text, lower=True)
    if not words:
        return []
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [line[s:e] for s, e in zip(starts, ends[size - 1 :])] or [line]


def wide_sketch(text: str | None, size: int = 5) -> tuple[int, int, bytes]:
    """128-bit SimHash over the set of the text's shingles (XXH3-128), as two signed integers, and a digest that names the set."""
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join(map(digest, spans(text, size))), np.uint8).reshape(-1, 16)
    names, first = np.unique(np.ascontiguousarray(hashes[:, 8:]).view(np.int64).ravel(), return_index=True)
    hashes = hashes[first]
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(hashes)).tobytes()
    return int.from_bytes(packed[:8], "big", signed=True), int.from_bytes(packed[8:], "big", signed=True), digest(names.tobytes())


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The set of the text's shingles as 32-bit hashes (among a million shingles about a hundred coincide)."""
    digest = xxhash.xxh3_64_digest
    return np.unique(np.frombuffer(b"".join(map(digest, spans(text, size))), np.int32)[::2])


def alike(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Of the pairs (a, b) of rows, those whose sets (row_key, shingles) have this Jaccard similarity at least."""
    side = lambda x: sets.select(F.col("row_key").alias(x), F.col("shingles").alias(f"{x}_set"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.filter(shared >= F.lit(jaccard) * (F.size("a_set") + F.size("b_set") - shared) - 1e-9).select("a", "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, jaccard: float = 0.8, recall: float = 0.98, max_bits: int = 29, row_col: str | None = None) -> DataFrame:
    """row_key, doc_id, component, component_id of the components of pairs at this Jaccard similarity or more on sets of shingles.

    recall: the estimated share of pairs just at the limit that are met. row_col: a column that numbers the rows, the same in every scan.
    """
    if row_col is None:
        docs, row_col = numbered(docs), ROW
    rows = docs.select(F.col(row_col).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(batches):
        for part in slices(batches):
            w0, w1, name = zip(*[wide_sketch(t, size) for t in part.column("text").to_pylist()])
            columns = [pa.array(w0, pa.int64()), pa.array(w1, pa.int64()), pa.array(name, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("row_key"), part.column("doc_id"), *columns], ["row_key", "doc_id", "wide0", "wide1", "name"])

    def sets_of(batches):
        for part in slices(batches):
            sets = [shingle_set(t, size) for t in part.column("text").to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("row_key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["row_key", "shingles"])

    sketches = stored(rows.mapInArrow(sketch, "row_key long, doc_id long, wide0 long, wide1 long, name binary"), "sketches")
    # Rows with equal sets are a class, named by its smallest row.
    classes = stored(sketches.groupBy("name").agg(F.min(F.struct("row_key", "wide0", "wide1")).alias("x")).select("name", F.col("x.row_key").alias("node"), "x.wide0", "x.wide1"), "classes")
    pairs, crowd = candidates(classes.select("wide0", "wide1", "node"), limit_share(jaccard), recall, max_bits)
    pairs = stored(pairs, "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row_key"))
    if crowd is not None:  # all its members, also those that no fingerprint is near
        ends = ends.unionByName(crowd.select(F.col("node").alias("row_key")))
    ends = stored(ends.distinct(), "candidate-rows")
    sets = stored(rows.select("row_key", "text").join(small(ends), "row_key", "left_semi").mapInArrow(sets_of, "row_key long, shingles array<int>"), "shingle-sets")
    # Each row's nearest pair first; then those whose ends are still apart.
    both = pairs.select("a", "b", "bits", F.explode(F.array("a", "b")).alias("x"))
    nearest = both.groupBy("x").agg(F.min(F.struct("bits", "a", "b")).alias("y")).select("y.a", "y.b").distinct()
    first = stored(alike(nearest, sets, jaccard), "nearest-links")
    roots = stored(components(first), "nearest-roots")
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    apart = apart.select("a", "b").join(nearest, ["a", "b"], "left_anti")
    found = stored(components(first.unionByName(alike(apart, sets, jaccard))), "similar-roots")
    if crowd is not None:
        more = stored(crowd_links(crowd, found, sets, jaccard), "crowd-links")
        found = stored(components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "similar-roots")
    named = classes.join(found, "node", "left").select("name", F.coalesce("root", "node").alias("component"))
    grouped = stored(sketches.select("row_key", "doc_id", "name").join(named, "name").select("row_key", "doc_id", "component"), "similar-groups")
    # Stored, so that the join has no other use for its partitions and Spark may split that of a large component.
    least = stored(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return grouped.join(least, "component").select("row_key", "doc_id", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: row_key, doc_id, fp, component_id (smallest doc_id reachable)."""
    fps = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp", F.col("fp").alias("node")), max_bits))
    ends = stored(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = ends.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(ends.join(least, "root").select("fp", "component_id"), "component-ids")
    return fps.join(named, "fp").select("row_key", "doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is the unit vector of its word counts in 2^bits hash buckets, a dozen statistics of its structure (lengths, letter case,
symbols, repetition), and its metadata: the number of characters that the source states (n_chars), and how far that is from the text's. The machine has a bias, a weight and a low-rank vector a feature; pairwise interactions cost linear time by the
identity sum_{i<j} <v_i,v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). It is fitted with Adam on the
logistic loss over a hash sample of at most about `fit_rows` labelled documents, so the driver's share is bounded; scoring runs
over Arrow slices on the executors.

Edge cases: null and empty texts have statistics of zero and a score like any other text; null labels teach nothing; a document
labelled twice teaches with either label; with no labels, or labels of one kind, the score is their smoothed share;
repeated rows are scored each; an empty table gives no rows; labels, lang, source and doc_id never enter a score; n_chars that is null, negative, no number or no column of the
table counts as what the text has; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import WORD_BYTES, Hashes, added, byte_class, documents, marks_by_text, named, remainder, slices, utf8, words_of
from siftline.llm.quality_rules import duplicate_lines

STATISTICS = 16
METADATA = "n_chars"
UPPER, LOWER, DIGIT = byte_class(bytes(range(65, 91))), byte_class(bytes(range(97, 123))), byte_class(bytes(range(48, 58)))
SYMBOL, SHOUT, STOP, WHITE = byte_class(b"#*$%&|<>@^~{}[]\\"), byte_class(b"!?"), byte_class(b".,;:"), byte_class(b" \t\n\x0b\x0c\r")


def stated(docs: DataFrame) -> Column:
    """The number of characters that the table states of a text, null if it states none."""
    return F.col(METADATA).cast("string").try_cast("double") if METADATA in docs.columns else F.lit(None).cast("double")


class Features:
    """Turns arrays of texts and of their stated characters into (text, bucket, value) triples and statistics."""

    def __init__(self, bits: int):
        self.buckets, self.memo = 1 << bits, Hashes()

    def __call__(self, texts: pa.Array, stated_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = [words_of(t, lower=True) for t in texts.to_pylist()]
        lengths = np.array([len(w) for w in words], np.int64)
        get = self.memo.__getitem__
        codes = np.fromiter((get(x) for w in words for x in w), np.int64, int(lengths.sum()))
        self.memo.trim()
        text = np.repeat(np.arange(len(words)), lengths)
        same = np.flatnonzero((codes[1:] == codes[:-1]) & (text[1:] == text[:-1])) + 1
        key, n = np.unique(text * self.buckets + (codes & (self.buckets - 1)), return_counts=True)
        where, bucket, n = key // self.buckets, key % self.buckets, n.astype(float)
        norm = np.sqrt(np.bincount(where, n * n, len(words)))
        most = np.zeros(len(words))
        np.maximum.at(most, where, n)
        flat, offsets = utf8(texts)
        size = np.diff(offsets)
        share = lambda table: marks_by_text(table[flat], offsets) / np.maximum(size, 1)
        lines, doubled = duplicate_lines(texts)
        per_word = lambda x: x / np.maximum(lengths, 1)
        chars = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(float)
        told = pc.fill_null(stated_chars, -1.0).to_numpy(zero_copy_only=False)
        told = np.where(np.isfinite(told) & (told >= 0), told, chars)
        columns = [
            np.log1p(lengths), np.log1p(size), share(~WHITE) * size / np.maximum(lengths, 1), share(UPPER), share(LOWER), share(DIGIT), share(SYMBOL), share(SHOUT),
            share(STOP), per_word(np.bincount(where, minlength=len(words))), per_word(most), per_word(np.bincount(text[same], minlength=len(words))), doubled / np.maximum(lines, 1), per_word(lines),
            np.log1p(told), np.log1p(told) - np.log1p(chars),
        ]
        return where, bucket, n / norm[where], np.stack(columns, axis=1)


class Machine:
    """w0, w and V over buckets, then statistics; statistics are standardised and cut at 6."""

    def __init__(self, bits: int, rank: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.bits, size = bits, (1 << bits) + STATISTICS
        self.w0, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank))
        self.mean, self.scale, self.constant = np.zeros(STATISTICS), np.ones(STATISTICS), None

    def standard(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.scale, -6, 6) / 2

    def raw(self, where, bucket, value, z) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds, and the sums of v x by text and factor; where ascending."""
        words, n = 1 << self.bits, len(z)
        sums = z @ self.v[words:]
        squares = (z * z) @ (self.v[words:] ** 2).sum(axis=1)
        linear = self.w0 + z @ self.w[words:] + np.bincount(where, self.w[bucket] * value, n)
        if len(where):
            vx = self.v[bucket] * value[:, None]
            begins = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            sums[where[begins]] += np.add.reduceat(vx, begins, axis=0)
            squares += np.bincount(where, (vx * vx).sum(axis=1), n)
        return linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def probability(self, where, bucket, value, statistics) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(statistics), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.raw(where, bucket, value, self.standard(statistics))[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], statistics: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4) -> None:
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return
        self.mean, self.scale = statistics.mean(axis=0), statistics.std(axis=0) + 1e-6
        z_all, rng = self.standard(statistics), np.random.default_rng(1)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.w0 = float(np.log(share / (1 - share)))
        words, step = 1 << self.bits, 0
        moments = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.v), np.zeros_like(self.v)]
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                where = np.repeat(np.arange(len(ids)), [len(rows[i][0]) for i in ids])
                bucket, value = np.concatenate([rows[i][0] for i in ids]), np.concatenate([rows[i][1] for i in ids])
                z = z_all[ids]
                raw, sums = self.raw(where, bucket, value, z)
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[ids]) / len(ids)
                # Gradients on the features that the batch has; Adam's moments of the others wait.
                some, place = np.unique(bucket, return_inverse=True)
                gx = g[where] * value
                vx = gx[:, None] * (sums[where] - self.v[bucket] * value[:, None])
                gw = np.concatenate((np.bincount(place, gx, len(some)), z.T @ g))
                gv = np.concatenate((np.stack([np.bincount(place, vx[:, f], len(some)) for f in range(vx.shape[1])], axis=1), z.T @ (g[:, None] * sums) - ((z * z).T @ g)[:, None] * self.v[words:]))
                touched = np.concatenate((some, np.arange(words, words + STATISTICS)))
                step += 1
                self.w0 -= rate * float(g.sum())
                for x, grad, m, s in ((self.w, gw, *moments[:2]), (self.v, gv, *moments[2:])):
                    grad = grad + decay * x[touched]
                    m[touched] = 0.9 * m[touched] + 0.1 * grad
                    s[touched] = 0.99 * s[touched] + 0.01 * grad * grad
                    x[touched] -= rate * (m[touched] / (1 - 0.9**step)) / (np.sqrt(s[touched] / (1 - 0.99**step)) + 1e-6)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 6000, bits: int = 12, rank: int = 6) -> Machine:
    """Fit on about fit_rows labelled documents at most, a hash sample where there are more."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id IS NOT NULL AND __y IS NOT NULL").distinct()
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.lit("fit"), "__id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))
    texts = docs.select(F.col(id_col).alias("__id"), stated(docs).alias("stated"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id").select("__y", "stated", "text")  # about fit_rows rows

    def run(batches):
        features = Features(bits)
        for part in slices(batches, "text", WORD_BYTES):
            where, bucket, value, statistics = features(part.column("text"), part.column("stated"))
            offsets = np.searchsorted(where, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("__y"), *lists, pa.array(list(statistics), pa.list_(pa.float64()))], ["y", "bucket", "value", "statistics"])

    got = texts.mapInArrow(run, "y int, bucket array<int>, value array<float>, statistics array<double>").toPandas()
    order = sorted(range(len(got)), key=lambda i: (got["y"][i], tuple(got["statistics"][i])))  # the fit doesn't depend on the order of tasks
    machine = Machine(bits, rank)
    rows = [(np.asarray(got["bucket"][i], np.int64), np.asarray(got["value"][i], float)) for i in order]
    machine.fit(rows, np.array([got["statistics"][i] for i in order], float).reshape(-1, STATISTICS), got["y"].to_numpy(float)[order])
    return machine


def scored(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns and `score`, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        own = shared.value
        features = Features(own.bits)
        return lambda texts, told: [own.probability(*features(texts, told))]

    return named(added(docs, text_col, keep, "score double", make, (stated(docs),)), keep, "score")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    docs = docs.select("doc_id", "text", stated(docs).alias(METADATA))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = learn(docs, labels.filter(remainder("doc_id", 5) != 0))
    found = scored(docs, machine)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased and every run of characters other than letters becomes one space. One model of character n-grams is fitted per
language on a bounded hash sample of labelled rows (`fit_chars` characters a language, expected). All models
lie in sorted hash arrays: for every n-gram that any language has, a row of log probabilities. A text's language is that of the lowest
cross-entropy per character. Its score is the chance that this is right, fitted by logistic regression on labelled rows
kept out of the models; below the smallest score at which those rows reach `precision`, `accepted` is false. A model is fitted for each of the `most_langs` languages
with the most characters, a stated bound on what a dirty lang column can bring to the driver; every text is scored by all of them.

Edge cases: null texts and texts without letters are `und` with score 0 and not accepted; rows with a null language or text
teach nothing; a language with few rows is learnt from all of them; without any labelled row every text is `und`; ties take the first language in alphabetical order;
repeated rows and other columns make no difference; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import documents, remainder, slices, sum_by

OTHER = re.compile(r"[\W\d_]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """Lower-case letters, single spaces for all else; empty without letters."""
    out = OTHER.sub(" ", (text or "").lower())
    return out if any(map(str.isalpha, out)) else ""


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts (each after order-1 zeros), hashes of the n-gram ending at each character, lengths."""
    pad = "\0" * (order - 1)
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer(pad.join(["", *texts]).encode("utf-32-le"), "<u4")
    ends = np.arange(lengths.sum()) + np.repeat((order - 1) * (1 + np.arange(len(texts))), lengths)
    return points, ends, lengths


def hashed(columns) -> np.ndarray:
    """Hash of one n-gram a row; columns: arrays of its code points, first to last."""
    h = np.uint64(0)
    for c in columns:
        h = (h + c) * FACTOR
        h = h ^ (h >> np.uint64(29))
    return h


def window(points: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    return [points[ends - back] for back in range(order - 1, -1, -1)]


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each code's class, and a place where each class occurs."""
    found = pa.array(codes).dictionary_encode()
    inverse = found.indices.to_numpy()
    first = np.empty(len(found.dictionary), np.int64)
    first[inverse[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return inverse, first


def gram_counts(labelled: DataFrame, order: int) -> DataFrame:
    """lang, gram (code points), n over all rows of (lang, text)."""

    def run(batches):
        for part in slices(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by.setdefault(lang, []).append(letters(text))
            for lang, texts in by.items():
                points, ends, _ = grams(texts, order)
                inverse, first = distinct(hashed(window(points, ends, order)))
                flat = np.stack(window(points, ends[first], order), axis=1).astype(np.int32).ravel()
                names = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, order, dtype=np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), names, pa.array(np.bincount(inverse, minlength=len(first)).astype(np.int64))], ["lang", "gram", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, gram array<int>, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated Kneser-Ney model of one language; levels from the highest order to the lowest."""

    def __init__(self, points: np.ndarray, counts: np.ndarray, alphabet: int):
        """points: distinct n-grams as rows of code points; alphabet: number of different last characters over all languages."""
        self.uniform, self.levels = 1.0 / (alphabet + 1), []
        points, counts = points.astype(np.uint64), counts.astype(float)
        for n in range(points.shape[1], 0, -1):
            keys = hashed(points.T)
            order = np.argsort(keys)
            keys, points, counts = keys[order], points[order], counts[order]
            singles, doubles = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.05, singles / max(1, singles + 2 * doubles)))
            contexts, inverse = np.unique(hashed(points[:, :-1].T) if n > 1 else np.zeros(len(points), np.uint64), return_inverse=True)
            total = np.bincount(inverse, counts)
            self.levels.append((keys, (counts - discount) / total[inverse], contexts, discount * np.bincount(inverse) / total))
            # Continuation counts: by how many different characters each shorter n-gram is preceded.
            shorter = points[:, 1:]
            if n > 1:
                _, first, counts = np.unique(hashed(shorter.T), return_index=True, return_counts=True)
                points, counts = shorter[first], counts.astype(float)

    def logs(self, points: np.ndarray) -> np.ndarray:
        """log2 probability of the last character of each n-gram."""
        p, points = np.full(len(points), self.uniform), points.astype(np.uint64)
        top = len(self.levels)
        for n, (keys, direct, contexts, left) in enumerate(reversed(self.levels), 1):
            some = points[:, top - n :]
            at, hit = find(keys, hashed(some.T))
            up, seen = find(contexts, hashed(some[:, :-1].T) if n > 1 else np.zeros(len(points), np.uint64))
            p = np.where(hit, direct[at], 0.0) + np.where(seen, left[up], 1.0) * p
        return np.log2(p)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the sorted table and whether the key is there."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Identifier:
    """Models by language, scoring whole texts, and the calibration of their margins."""

    def __init__(self, models: dict[str, KneserNey], order: int):
        self.langs, self.models, self.order = sorted(models), models, order
        self.slope, self.shift, self.least = 20.0, 0.0, 0.0

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character, texts x languages."""
        points, ends, lengths = grams(texts, self.order)
        out = np.zeros((len(texts), len(self.langs)))
        if len(ends):
            inverse, first = distinct(hashed(window(points, ends, self.order)))
            seen = np.stack(window(points, ends[first], self.order), axis=1)
            for i, lang in enumerate(self.langs):
                out[:, i] = -sum_by(self.models[lang].logs(seen)[inverse], lengths) / np.maximum(lengths, 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and margin (bits a character to the second best)."""
        clean = [letters(t) for t in texts]
        known = np.array([bool(t) for t in clean], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        h = self.entropies(clean)
        best = np.argmin(h, axis=1)
        margin = np.partition(h, 1, axis=1)[:, 1] - h.min(axis=1) if len(self.langs) > 1 else np.full(len(texts), 1.0)
        score = np.where(known, 1 / (1 + np.exp(-(self.slope * margin + self.shift))), 0.0)
        return [self.langs[i] if k else "und" for i, k in zip(best, known)], score, margin

    def calibrate(self, margins: np.ndarray, right: np.ndarray, precision: float) -> None:
        """Logistic regression of being right on the margin (Newton's method, smoothed), then the rejection limit."""
        x = np.append(margins, np.zeros(2))
        y = np.append(right.astype(float), [0.0, 1.0])  # at no margin: even odds
        w = np.zeros(2)
        basis = np.stack([x, np.ones(len(x))], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(basis @ w, -30, 30)))
            step = np.linalg.solve((basis * (p * (1 - p))[:, None]).T @ basis + 1e-3 * np.eye(2), basis.T @ (y - p) - 1e-3 * w)
            w = w + np.clip(step, -20, 20)
        self.slope, self.shift = float(max(w[0], 0.0)), float(w[1])
        order = np.argsort(-margins)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        enough = np.nonzero(good >= precision)[0]
        limit = margins[order][enough[-1]] if len(enough) else np.inf
        self.least = float(1 / (1 + np.exp(-min(self.slope * limit + self.shift, 700.0)))) if np.isfinite(limit) else 1.0


def sampled(rows: DataFrame, salt: str, share: dict[str, float]) -> DataFrame:
    """A hash sample of rows (doc_id, lang, text), by language."""
    draw = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(1_000_003)) / 1_000_003
    limit = F.coalesce(F.element_at(F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("lang")), F.lit(0.0))
    return rows.filter(draw < limit)


def fit(labelled: DataFrame, order: int = 4, fit_chars: int = 4_000_000, check_rows: int = 1000, precision: float = 0.995, most_langs: int = 400) -> Identifier:
    """labelled: doc_id, lang, text. Models see about fit_chars characters a language, and so many in all as most_langs / 10 languages of that size; the calibration about check_rows rows."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND lang != 'und'")
    is_check = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)) == 0
    sizes = labelled.groupBy("lang").agg(F.sum(F.when(~is_check, F.length("text"))).alias("chars"), F.sum(F.length("text")).alias("all"), F.sum(is_check.cast("long")).alias("rows"))
    sizes = sizes.orderBy(F.desc("all"), "lang").limit(most_langs).collect()
    fit_chars = min(fit_chars, fit_chars * most_langs // (10 * max(len(sizes), 1)))
    # A language all of whose rows are to be kept out is learnt from them nevertheless.
    few = [r["lang"] for r in sizes if not r["chars"] and r["all"]]
    share = {r["lang"]: fit_chars / (r["chars"] or r["all"]) for r in sizes if r["all"]}
    if not share:
        return Identifier({}, order)
    counts = gram_counts(sampled(labelled.filter(~is_check | F.col("lang").isin(few)), "fit", share), order).filter("n > 0").toPandas()
    if counts.empty:
        return Identifier({}, order)
    alphabet = len({g[-1] for g in counts["gram"]})
    models = {lang: KneserNey(np.array(some["gram"].tolist()), some["n"].to_numpy(), alphabet) for lang, some in counts.groupby("lang")}
    fitted = Identifier(models, order)
    held = sampled(labelled.filter(is_check), "check", {r["lang"]: check_rows / max(r["rows"], 1) for r in sizes})
    checked = identify(held, fitted, keep=("lang",)).select("lang", "lang_pred", "margin").filter("lang_pred != 'und'").toPandas()
    if len(checked):
        fitted.calibrate(checked["margin"].to_numpy(), (checked["lang"] == checked["lang_pred"]).to_numpy(), precision)
    return fitted


def identify(docs: DataFrame, fitted: Identifier, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score, margin, accepted; only the text is looked at."""
    rows = docs.select(*[F.col(c).alias(f"__{c}") for c in keep], F.col(text_col).alias("__text_"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # bounded by fit_chars a language
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        model = shared.value
        for part in slices(batches, "__text_"):
            lang, score, margin = model.predict(part.column("__text_").to_pylist())
            accepted = (score >= model.least) & (np.array(lang) != "und")
            yield pa.RecordBatch.from_arrays([*(part.column(f"__{c}") for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(margin), pa.array(accepted)], [*(f"__{c}" for c in keep), "lang_pred", "score", "margin", "accepted"])

    found = rows.mapInArrow(run, f"{schema}, lang_pred string, score double, margin double, accepted boolean")
    return found.select(*[F.col(f"__{c}").alias(c) for c in keep], "lang_pred", "score", "margin", "accepted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fitted = fit(docs.filter(remainder("doc_id", 4) != 2).select("doc_id", "lang", "text"))
    found = identify(docs, fitted)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")

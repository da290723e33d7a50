"""Frequency and recency of opened paths, from an append-only log of opens."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.fixed_values import HALF_LIFE_MS


def path_key(raw: Column) -> Column:
    """The path that an opened location stands for: null for other schemes; no query, fragment or :selector; / between."""
    plain = F.regexp_replace(raw, r"[?#].*\z", "")
    plain = F.regexp_replace(plain, r"^file://", "")
    plain = F.when(~plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]+://"), plain)
    plain = F.replace(plain, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(plain, r"(?<=[^/:]{2})(:[^/:]+)+\z", ""), r"^\./", "")


def summed(opens: DataFrame) -> DataFrame:
    """path, opened (count), last, from rows (path, ts); combines before the shuffle."""
    return opens.filter("path IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("opened"), F.max("ts").alias("last"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two stores (path, opened, last): the larger count and the later time."""
    return a.unionByName(b).groupBy("path").agg(F.max("opened").alias("opened"), F.max("last").alias("last"))


def cleared(store: DataFrame, at: datetime | None, now: datetime) -> DataFrame:
    """Without what was last opened before the store was cleared; a time yet to come clears nothing."""
    return store if at is None or at > now else store.filter(F.col("last") >= F.lit(at))


def scores(store: DataFrame, now: Column) -> DataFrame:
    """path, frecency: the count, halved for each week since the last open."""
    age = F.greatest(F.lit(0), F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1000.0
    return store.select("path", (F.col("opened") * F.pow(F.lit(0.5), age / HALF_LIFE_MS)).alias("frecency"))

"""Content tags: four hexadecimal digits by which a reader notices that a text has changed."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """The text without its mark, with line feeds alone and without blanks at line ends."""
    feeds = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")
    return F.regexp_replace(feeds, r"(?<![ \t\r])[ \t\r]++(?=\n|\z)", "")


def content_tag(text: Column | str) -> Column:
    """Low 16 bits of XXH32 over the plain text; null of a null text."""

    @F.pandas_udf("int")
    def low_bits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xxhash.xxh32_intdigest(t.encode()) & 0xFFFF, na_action="ignore")

    return F.lpad(F.hex(low_bits(plain(F.col(text) if isinstance(text, str) else text))), 4, "0")


def header(path: Column, tag: Column) -> Column:
    return F.concat(F.lit("["), path, F.lit("#"), tag, F.lit("]"))

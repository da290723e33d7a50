"""Pages of results, and their text: for a person or a tool, on the driver, a page at a time."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siftline.functions.fixed_values import MAX_CHARS, PAGE_DEFAULT, PAGE_MAX, QUESTION_WORDS, REGEX_SYNTAX, SUMMARY_TOP


def page_size(limit: int | float | None) -> int:
    if limit is None or not limit == limit or limit <= 0 or limit == float("inf"):
        return PAGE_DEFAULT
    return min(PAGE_MAX, int(limit))


#: A column that pages are ordered by, and whether the largest comes first. Nulls are least.
Key = tuple[str, bool]
MATCHES: tuple[Key, ...] = (("path", False), ("line", False), ("col", False))


@dataclass(frozen=True)
class Cursor:
    """Where a search goes on: after the row with these keys, in the snapshot that the first page saw."""

    query: str
    snapshot: str
    last: list
    shown: int
    total: int

    def token(self) -> str:
        return base64.urlsafe_b64encode(json.dumps(asdict(self)).encode()).decode()

    @staticmethod
    def of(token: str, query: str, snapshot: str) -> Cursor:
        try:
            found = Cursor(**json.loads(base64.urlsafe_b64decode(token)))
        except (ValueError, TypeError) as e:
            raise ValueError("not a cursor") from e
        if found.query != query or found.snapshot != snapshot:
            raise ValueError("results changed since page 1; run it again without a cursor")
        return found


@dataclass
class Page:
    rows: list[Row]
    total: int
    next: str | None


def snapshot(rows: DataFrame) -> str:
    """What tells whether the files behind a relation changed: a digest of their names, sizes and times. Relations without files are one snapshot."""
    spark = rows.sparkSession
    digest = hashlib.sha256()
    for name in sorted(rows.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        digest.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()[:16]


def after(keys: Sequence[Key], last: Sequence) -> Column:
    """Whether a row comes after the one with these key values."""
    out, same = F.lit(False), F.lit(True)
    for (name, down), value in zip(keys, last):
        c, v = F.col(name), F.lit(value)
        if value is None:
            later = F.lit(False) if down else c.isNotNull()
        else:
            later = (c < v) | c.isNull() if down else c > v
        out, same = out | same & F.coalesce(later, F.lit(False)), same & c.eqNullSafe(v)
    return out


def page(rows: DataFrame, keys: Sequence[Key], query: str, limit: int | None = None, token: str | None = None, source: DataFrame | None = None) -> Page:
    """A page in the order of the keys, which name a row, and the token of the next one.

    A page is one top-k: a later one seeks the rows after the last one shown, and counts nothing. The rows are counted for the first page alone. source: the
    relation whose files the snapshot is of, if not rows.
    """
    size, now = page_size(limit), snapshot(rows if source is None else source)
    known = Cursor.of(token, query, now) if token else None
    total = known.total if known else rows.count()
    left = rows.filter(after(keys, known.last)) if known else rows
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in keys]
    got = left.orderBy(*order).limit(size + 1).collect()
    shown, more = got[:size], len(got) > size
    at = (known.shown if known else 0) + len(shown)
    return Page(shown, total, Cursor(query, now, [shown[-1][c] for c, _ in keys], at, total).token() if more else None)


def match_text(row: Row, concise: bool = False) -> str:
    """path:line:col: text, and below it its context, indented, those before it first."""
    if concise:
        return f"{row.path}:{row.line}"
    fields = row.asDict()
    before, after = fields.get("before") or [], fields.get("after") or []
    around = [*((row.line - len(before) + i, x) for i, x in enumerate(before)), *((row.line + 1 + i, x) for i, x in enumerate(after))]
    return "\n".join([f"{row.path}:{row.line}:{row.col}: {row.text}", *(f"  {row.path}:{n}: {x}" for n, x in around)])


def caller_text(row: Row) -> str:
    """A site, how sure it is, and in deeper rings how far it is and through what."""
    deeper = f" [depth {row.depth} via {row.via}]" if row.depth > 1 else ""
    return f"{row.path}:{row.line}:{row.col}: {row.text}{' (possible)' if row.certainty == 'possible' else ''}{deeper}"


def symbol_text(row: Row, concise: bool = False) -> str:
    return row.name if concise else f"{row.path}:{row.line}: {row.kind} {row.name}"


def grep_text(rows: list[Row], tags: dict[str, str], concise: bool = False) -> str:
    """A page of matches by file, in the order in which files come, each file under its tag if it has one (see tags.header).

    The enclosing symbol stands above the matches in it, once for matches that follow each other.
    """
    by_file: dict[str, list[str]] = {}
    above = None
    for row in rows:
        inside = None if concise else row.asDict().get("enclosing")
        head = f"in {inside['kind']} {inside['name']}" if inside else None
        shown = by_file.setdefault(row.path, [])
        shown += [head] if head and head != above else []
        shown.append(match_text(row, concise))
        above = head
    return "\n".join(line for path, shown in by_file.items() for line in ([f"[{path}#{tags[path]}]"] if path in tags else []) + shown)


def nothing_found(pattern: str, literal: bool = True) -> str:
    """What to say of a search without matches, and what else to try."""
    hints = []
    if literal and re.search(REGEX_SYNTAX, pattern):
        hints.append("it looks like an expression: try literal=False")
    if literal and len(pattern.split()) >= QUESTION_WORDS:
        hints.append("it looks like a question: try search")
    return "; ".join([f'0 matches for "{pattern}" ({"literal" if literal else "expression"})', *hints])


def nothing_found_by_path(query: str, scanned: int, relaxed: str | None = None) -> str:
    """What to say of a path search without matches: how many files there were, and what else was tried."""
    return f'0 matches{f" for {query!r}" if relaxed else ""} ({scanned} files scanned{f"; relaxed to {relaxed!r}" if relaxed else ""})'


def within_budget(text: str, max_chars: int | None, counts: dict[str, int]) -> str:
    """The text, or where it is too long the largest counts."""
    if max_chars is not None and not 1 <= max_chars:
        raise ValueError("max_chars must be >= 1")
    if max_chars is None or len(text) <= min(max_chars, MAX_CHARS):
        return text
    return ", ".join(f"{k}: {n}" for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:SUMMARY_TOP])


def human_size(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if size < 1024:
            return f"{size:.0f} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TB"

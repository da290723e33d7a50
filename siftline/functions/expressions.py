"""Which engine an expression goes to, and the one that keeps to a stack and a time.

Spark's own expressions run on Java's engine, which calls itself once for each turn of a repeated group: a few thousand turns on one line
end the executor. It has no time limit either. So an expression goes there only if neither can happen by its shape: repeats are of single
characters, of groups a stated number of times, or possessive, and at most one of them can hand characters on to what follows it. All others go to
Arrow batches. Those in which a long repeat of single characters may be walked anew from each of many starts are read by Arrow's own expressions (RE2), in time
linear in the line, if these find the same matches; the rest by a matcher whose stack is on the heap and which gives up after a stated time for each text, by name.
"""

from __future__ import annotations

import re
import time
from re import _constants as codes
from re import _parser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.fixed_values import GROUP_TURNS, MATCH_SECONDS

HIT = "array<struct<line:int,columns:array<int>>>"
EVERY = frozenset(range(129))  # ASCII, and one code for all beyond it
_WORD = frozenset(i for i in range(128) if chr(i).isalnum() or chr(i) == "_")
_CATEGORIES = {
    codes.CATEGORY_DIGIT: frozenset(range(48, 58)),
    codes.CATEGORY_SPACE: frozenset((9, 10, 11, 12, 13, 32)),
    codes.CATEGORY_WORD: _WORD,
}
_NEGATED = {codes.CATEGORY_NOT_DIGIT: codes.CATEGORY_DIGIT, codes.CATEGORY_NOT_SPACE: codes.CATEGORY_SPACE, codes.CATEGORY_NOT_WORD: codes.CATEGORY_WORD}
_REPEATS = (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT)


class MatchOverBudget(RuntimeError):
    """An expression did not come to an end on a text within its time."""


def _either_case(chars) -> frozenset[int]:
    return frozenset(x for c in chars for x in ({ord(chr(c).lower()), ord(chr(c).upper())} if c < 128 else {128}) if x < 129)


def _set_of(op, x) -> frozenset[int] | None:
    """Characters of an item of one character (either case of letters), or None."""
    if op is codes.LITERAL:
        return _either_case([x])
    if op is codes.NOT_LITERAL:
        return EVERY - _either_case([x])
    if op is codes.ANY:
        return EVERY
    if op is codes.CATEGORY:
        return _CATEGORIES[x] if x in _CATEGORIES else EVERY - _CATEGORIES[_NEGATED[x]]
    if op is codes.IN:
        found, negated = frozenset(), False
        for kind, y in x:
            if kind is codes.NEGATE:
                negated = True
            elif kind is codes.RANGE:
                found |= _either_case(range(y[0], min(y[1], 127) + 1)) | (frozenset([128]) if y[1] > 127 else frozenset())
            else:
                found |= _set_of(kind, y)
        return EVERY - (found - {128}) if negated else found
    return None


def _first(items) -> tuple[frozenset[int], bool]:
    """Characters with which a sequence may begin, and whether it may be empty; wide where unsure."""
    out = frozenset()
    for op, x in items:
        one = _set_of(op, x)
        if one is not None:
            return out | one, False
        if op in _REPEATS:
            some, empty = _first(x[2])
            empty |= x[0] == 0
        elif op is codes.SUBPATTERN:
            some, empty = _first(x[3])
        elif op is codes.ATOMIC_GROUP:
            some, empty = _first(x)
        elif op is codes.BRANCH:
            each = [_first(b) for b in x[1]]
            some, empty = frozenset().union(*(s for s, _ in each)), any(e for _, e in each)
        elif op in (codes.AT, codes.ASSERT, codes.ASSERT_NOT):
            some, empty = frozenset(), True
        else:
            return EVERY, True
        out |= some
        if not empty:
            return out, False
    return out, True


def _long_after(chars: frozenset[int], items) -> bool:
    """Whether a long repeat of some of the characters may follow at once: what is handed on is then walked again each time."""
    for op, x in items:
        if op in _REPEATS:
            one = _set_of(*list(x[2])[0]) if len(x[2]) == 1 else None
            if one is None or one & chars and x[1] > GROUP_TURNS:
                return bool(one is None or one & chars)
            if x[0] == 0:
                continue
        elif op in (codes.AT, codes.ASSERT, codes.ASSERT_NOT):
            continue
        elif op is codes.SUBPATTERN and len(x[3]) and list(x[3])[0][0] in _REPEATS:
            return _long_after(chars, list(x[3]))
        return False
    return False


def _safe(items, turns: int, after: list, open_: list[int]) -> bool:
    """Whether a sequence keeps to Java's stack; counts into open_ the repeats that can hand characters on."""
    items = list(items)
    for at, (op, x) in enumerate(items):
        rest = items[at + 1 :] + after
        if op in _REPEATS:
            least, most, body = x
            body = list(body)
            one = _set_of(*body[0]) if len(body) == 1 else None
            if one is None:
                if op is not codes.POSSESSIVE_REPEAT and most * turns > GROUP_TURNS:
                    return False
                if not _safe(body, turns * (1 if op is codes.POSSESSIVE_REPEAT else most), rest, open_):
                    return False
            elif op is not codes.POSSESSIVE_REPEAT and most > GROUP_TURNS:
                follows, _ = _first(rest)
                open_[0] += (bool(one & follows) + _long_after(one, rest)) * turns
        elif op is codes.SUBPATTERN:
            if not _safe(x[3], turns, rest, open_):
                return False
        elif op is codes.ATOMIC_GROUP:
            if not _safe(x, turns, [], open_):
                return False
        elif op in (codes.ASSERT, codes.ASSERT_NOT):
            if not _safe(x[1], turns, [], open_):
                return False
        elif op is codes.BRANCH:
            if not all([_safe(b, turns, rest, open_) for b in x[1]]):
                return False
    return open_[0] <= 1


#: An escape, a class, or the repeat of a group: its sign and whether it is possessive.
_PIECE = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\)([*+]|\{\d*,?(\d*)\})(\+?)", re.DOTALL)


def _repeats_group(pattern: str) -> bool:
    """Whether a group of any content is repeated without a small bound. (The tree below shows a group of single characters as a class.)"""
    return any(m[1] and not m[3] and (m[1] in "*+" or m[1].endswith(",}") or int(m[2] or 0) > GROUP_TURNS) for m in _PIECE.finditer(pattern))


#: A repeated group of single characters, escapes of kinds of them, or classes without a `-`, `^` or class inside.
_ONE = r"(?:[A-Za-z0-9_ ]|\\[wdsWDS.]|\[[A-Za-z0-9_]+\])"
_SINGLES = re.compile(rf"(?<!\\)\((?:\?:)?({_ONE}(?:\|{_ONE})*)\)(?=[*+{{])")


def flattened(pattern: str) -> str:
    """The expression with repeated groups of single characters, such as (a|b)*, as classes, which Java's engine repeats without its stack. It has the same matches, so long as
    no group is referred to."""
    if re.search(r"\\[1-9k]|\(\?P", pattern) or re.search(r"\[[^\]]*\(", pattern):
        return pattern
    return _SINGLES.sub(lambda m: "[" + re.sub(r"\||(?<!\\)[\[\]]", "", m[1]) + "]", pattern)


def in_columns(pattern: str) -> bool:
    """Whether the expression is safe on Java's engine, whatever the line. What cannot be read is not."""
    try:
        return not _repeats_group(pattern) and _safe(_parser.parse(pattern), 1, [], [0])
    except (re.error, KeyError, OverflowError, RecursionError):
        return False


def may_be_empty(pattern: str) -> bool:
    """Whether some match of the expression has no characters."""
    try:
        return _parser.parse(pattern).getwidth()[0] == 0
    except re.error:
        return False  # only the matcher knows it, and it sees for itself


_ENDS = {codes.AT_BEGINNING: r"\A", codes.AT_BEGINNING_STRING: r"\A", codes.AT_END: r"\z", codes.AT_END_STRING: r"\z", codes.AT_BOUNDARY: r"\b"}
_KINDS = {codes.CATEGORY_DIGIT: "0-9", codes.CATEGORY_SPACE: r"\x{9}-\x{d} ", codes.CATEGORY_WORD: "0-9A-Za-z_", codes.CATEGORY_NOT_DIGIT: r"\D", codes.CATEGORY_NOT_WORD: r"\W"}


def _written(items) -> str:
    """A sequence in RE2's words. An error where the two might differ."""
    out = []
    for op, x in items:
        if op is codes.LITERAL:
            out.append(rf"\x{{{x:x}}}")
        elif op is codes.NOT_LITERAL:
            out.append(rf"[^\x{{{x:x}}}]")
        elif op is codes.ANY:
            out.append("(?s:.)")
        elif op is codes.IN and x == [(codes.CATEGORY, codes.CATEGORY_NOT_SPACE)]:
            out.append(f"[^{_KINDS[codes.CATEGORY_SPACE]}]")
        elif op is codes.IN:
            parts = {codes.NEGATE: lambda _: "^", codes.LITERAL: lambda y: rf"\x{{{y:x}}}", codes.RANGE: lambda y: rf"\x{{{y[0]:x}}}-\x{{{y[1]:x}}}", codes.CATEGORY: _KINDS.__getitem__}
            out.append("[" + "".join(parts[kind](y) for kind, y in x) + "]")
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and x[2].getwidth()[0]:
            most = "" if x[1] is codes.MAXREPEAT else x[1]
            out.append(f"(?:{_written(x[2])}){{{x[0]},{most}}}{'?' if op is codes.MIN_REPEAT else ''}")
        elif op is codes.SUBPATTERN and not x[1] and not x[2]:
            out.append(f"(?:{_written(x[3])})")
        elif op is codes.BRANCH:
            out.append(f"(?:{'|'.join(map(_written, x[1]))})")
        elif op is codes.AT and x in _ENDS:
            out.append(_ENDS[x])
        else:
            raise ValueError(op)
    return "".join(out)


def linear(pattern: str) -> str | None:
    """The expression for RE2, which takes time linear in the line, if it finds the same matches there and none without characters; else None."""
    if re.search(r"\[\[|\[:|--|&&|\|\||~~|\{(?!\d*,?\d*\})", pattern):
        return None  # the matcher may read these in ways of its own
    try:
        tree = _parser.parse(pattern)
        if tree.state.flags & ~re.UNICODE or not tree.getwidth()[0]:
            return None
        out = f"({_written(tree)})"
        pc.match_substring_regex(pa.array([""]), out)
        return out
    except (re.error, pa.ArrowInvalid, ValueError, KeyError, OverflowError, RecursionError):
        return None


def _long_repeats(items):
    """Characters of each repeat of single ones that may be long."""
    for op, x in items:
        if op in (codes.MAX_REPEAT, codes.MIN_REPEAT):
            one = _set_of(*x[2][0]) if len(x[2]) == 1 else None
            if one is None:
                yield from _long_repeats(x[2])
            elif x[1] > GROUP_TURNS:
                yield one
        elif op is codes.SUBPATTERN:
            yield from _long_repeats(x[3])
        elif op is codes.BRANCH:
            for some in x[1]:
                yield from _long_repeats(some)


def restarts(pattern: str) -> bool:
    """Whether a match may begin again within what a long repeat has walked, which is quadratic on Java's engine and linear on RE2."""
    if linear(pattern) is None:
        return False
    tree = _parser.parse(pattern)
    first, _ = _first(tree)
    return any(first & some for some in _long_repeats(tree))


def compiled(pattern: str) -> regex.Pattern:
    """The matcher's expression; an expression that it does not know is refused by name, before any task runs."""
    flags, body = 0, pattern
    if m := re.match(r"\(\?iu?\)", pattern):
        flags, body = regex.IGNORECASE, pattern[m.end() :]
    try:
        return regex.compile(body, flags | (regex.UNICODE if flags and not body.isascii() else regex.ASCII))
    except regex.error as wrong:
        raise ValueError(f"invalid regex: {pattern if len(pattern) <= 200 else pattern[:200] + '…'} ({wrong})") from None


def text_lines(text: str | None) -> tuple[list[str], bool]:
    """Lines without their ends, and whether the text ends with a newline."""
    lines = (text or "").split("\n")
    ended = lines[-1] == ""
    if ended:
        lines.pop()
    return [x.removesuffix("\r") for x in lines], ended


def hits_of(text: str | None, rx: regex.Pattern, seconds: float, first: bool = False) -> list[dict]:
    """Matches line by line, empty ones too, but none after the last character of an unended text. first: one line with a match is enough."""
    lines, ended = text_lines(text)
    out, until = [], time.monotonic() + seconds
    for i, line in enumerate(lines):
        last = len(line) if not ended and i == len(lines) - 1 and line else -1
        try:
            left = max(until - time.monotonic(), 0.001)
            columns = [m.start() + 1 for m in rx.finditer(line, timeout=left) if not (m.start() == m.end() == last)]
        except TimeoutError:
            raise MatchOverBudget(f"{rx.pattern!r} did not come to an end on line {i + 1} ({len(line)} characters) within {seconds} s") from None
        if columns:
            out.append({"line": i + 1, "columns": columns})
            if first:
                break
    return out


#: Characters of texts whose lines are matched together.
STEP_CHARS = 4 << 20


def linear_hits(texts: pd.Series, expression: str) -> list[list[dict]]:
    """As hits_of, of many texts, by an expression of `linear`."""
    out: list[list[dict]] = []
    lines, owner, held = [], [], 0

    def solve() -> None:
        found = pc.indices_nonzero(pc.match_substring_regex(pa.array(lines, pa.string()), expression)).to_pylist()
        hit = [lines[i] for i in found]
        seen = set().union(*hit)
        mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in seen)
        marked = pc.replace_substring_regex(pa.array(hit, pa.string()), expression, mark + r"\1").to_pylist()
        for i, line in zip(found, marked):
            at, columns = 1, []
            for piece in line.split(mark)[:-1]:
                at += len(piece)
                columns.append(at)
            k, number = owner[i]
            out[k].append({"line": number, "columns": columns})
        lines.clear()
        owner.clear()

    for text in texts:
        some, _ = text_lines(text)
        owner += [(len(out), number) for number in range(1, len(some) + 1)]
        out.append([])
        lines += some
        held += len(text or "")
        if held > STEP_CHARS:
            solve()
            held = 0
    solve()
    return out


def bounded_hits(text: Column, pattern: str, seconds: float = MATCH_SECONDS) -> Column:
    """(line, columns) of each line with a match, in linear time or by the matcher with a time limit for each text."""
    rx, fast = compiled(pattern), linear(pattern) if restarts(pattern) else None

    @F.pandas_udf(HIT)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([hits_of(t, rx, seconds) for t in texts] if fast is None else linear_hits(texts, fast), dtype=object)

    return found(text)


def bounded_test(text: Column, pattern: str, seconds: float = MATCH_SECONDS) -> Column:
    """Whether a line of the text has a match, in linear time or by the matcher with a time limit for each text."""
    rx, fast = compiled(pattern), linear(pattern) if restarts(pattern) else None

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(hits_of(t, rx, seconds, first=True)) for t in texts] if fast is None else list(map(bool, linear_hits(texts, fast))), dtype=bool)

    return found(text)

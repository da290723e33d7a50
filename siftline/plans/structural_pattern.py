"""Structural patterns lowered to regular expressions over single lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from siftline.functions.fixed_values import ATOM, DEFINITION_HEAD, KINDS, LANGUAGES, METAVARIABLES, MULTI
from siftline.functions.text import edge, quoted

SLOT = re.compile(r"\$\$\$(\w*)|\$\$?([A-Za-z_]\w*)", re.ASCII)


@dataclass
class Structural:
    mode: str  # pattern, kind, symbol, references, inside, has
    pattern: str = ""
    slots: list[str] = field(default_factory=list)
    within: str | None = None  # files have to have a match of this as well
    symbol: str | None = None  # asks for callers of this instead
    kind: str | None = None
    language: str = "generic"


def language_of(name: str | None) -> str:
    return next((k for k, names in LANGUAGES.items() if (name or "").strip().lower() in names), "generic")


def definition_of(name: str) -> str:
    return DEFINITION_HEAD + quoted(name) + edge(quoted(name), False)


def slotted(body: str, slots: list[str]) -> str:
    """$NAME stands for a string or an identifier, $$$NAME for anything; a name met again for the same text."""
    out, at = [], 0
    for m in SLOT.finditer(body):
        out.append(quoted(body[at : m.start()]))
        at = m.end()
        name, part = (m[2], ATOM) if m[2] else (m[1] or "$$$", MULTI)
        if name in slots:
            out.append(rf"\{slots.index(name) + 1}")
            continue
        if len(slots) == METAVARIABLES:
            raise ValueError(f"more than {METAVARIABLES} metavariables")
        slots.append(name)
        out.append(part)
    return "".join(out) + quoted(body[at:])


def of_kind(name: str) -> str:
    if name not in KINDS:
        raise ValueError(f"unknown structural kind {name!r} (supported: {', '.join(KINDS)})")
    return KINDS[name]


def lower(pattern: str, language: str | None = None) -> Structural:
    """The plan of a pattern: text with slots, or kind:, symbol:, references:, `inside: OUTER >> INNER`, `has: TARGET << FILTER`."""
    text = pattern.strip()
    if not text:
        raise ValueError("structural pattern must not be empty")
    tag, found, rest = text.partition(":")
    out = Structural("pattern", language=language_of(language))
    if not found or tag not in ("kind", "symbol", "references", "inside", "has"):
        out.pattern = _checked(slotted(text, out.slots), text)
        return out
    out.mode, rest = tag, rest.strip()
    if tag in ("inside", "has"):
        mark = ">>" if tag == "inside" else "<<"
        left, found, right = (x.strip() for x in rest.partition(mark))
        if not (left and found and right) or re.match("(?:inside|has):", left) or re.match("(?:inside|has):", right):
            raise ValueError(f"{tag}: needs two plain patterns around {mark}")
        filtering, wanted = (left, right) if tag == "inside" else (right, left)
        side = _side(filtering, [])
        if side.symbol:
            raise ValueError(f"{tag}: references: cannot filter files")
        out.within = side.pattern
        inner = _side(wanted, out.slots)
        out.pattern, out.symbol = inner.pattern, inner.symbol
        return out
    if not rest:
        raise ValueError(f"{tag}: needs a name")
    side = _side(text, out.slots)
    out.pattern, out.symbol, out.kind = side.pattern, side.symbol, side.kind
    return out


def _side(text: str, slots: list[str]) -> Structural:
    tag, found, rest = text.partition(":")
    rest = rest.strip()
    if not found or tag not in ("kind", "symbol", "references"):
        return Structural("pattern", _checked(slotted(text, slots), text), slots)
    if not rest:
        raise ValueError(f"{tag}: needs a name")
    if tag == "references":
        return Structural("references", symbol=rest)
    return Structural(tag, of_kind(rest), kind=rest) if tag == "kind" else Structural(tag, definition_of(rest))


def _checked(pattern: str, text: str) -> str:
    if re.search(pattern.replace(r"\z", r"\Z"), ""):
        raise ValueError(f"structural {text!r} matches everything: it needs something literal")
    return pattern

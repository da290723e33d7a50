"""What byte-level BPE encoders share: rank files, and units that can be encoded apart."""

from __future__ import annotations

import base64
import re

#: A space that another white-space character follows: there units may not be cut.
LOOSE = re.compile(r" \s")


def units(text: str) -> list[str]:
    """Cut before each space that a non-white-space character follows. Joined they are the text again.

    The vocabularies' pattern lets a single space begin a token and never lets a token run from non-space into space, so
    the tokens of a text are those of its units, one after the other.
    """
    if not text:
        return []
    head, *rest = text.split(" ")
    if not LOOSE.search(text) and not text.endswith(" "):
        out = [" " + x for x in rest]
        return [head, *out] if head else out
    out = [head]
    for x in rest:
        if not x or x[0].isspace():
            out[-1] += " " + x
        else:
            out.append(" " + x)
    return out if out[0] else out[1:]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

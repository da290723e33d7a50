"""Checks of the values that a caller passes in a mapping: what is wrong is refused by name, what is absent is None."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from typing import Any

from siftline.functions.fixed_values import CONTEXT_MAX, MAX_CHARS


def text(params: Mapping[str, Any], key: str) -> str | None:
    """A text that is not empty; anything else counts as absent."""
    value = params.get(key)
    return value if isinstance(value, str) and value else None


def strict_text(params: Mapping[str, Any], key: str) -> str | None:
    """As text, but another kind of value is refused."""
    value = params.get(key)
    if value is not None and not isinstance(value, str):
        raise ValueError(f"{key}: expected string")
    return value or None


def _number(params: Mapping[str, Any], key: str) -> int | float | None:
    value = params.get(key)
    return None if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) else value


def context(params: Mapping[str, Any], key: str) -> int:
    """Lines of context, 0 if absent, CONTEXT_MAX at most."""
    value = _number(params, key)
    if value is None:
        return 0
    if value != int(value):
        raise ValueError(f"{key} must be an integer")
    return max(0, min(CONTEXT_MAX, int(value)))


def chars(params: Mapping[str, Any], key: str) -> int | None:
    """A budget of characters, MAX_CHARS at most."""
    value = _number(params, key)
    if value is None:
        return None
    if value != int(value):
        raise ValueError(f"{key} must be an integer >= 1")
    if value < 1:
        raise ValueError(f"{key} must be >= 1")
    return min(int(value), MAX_CHARS)


def root(params: Mapping[str, Any], key: str = "cwd") -> str | None:
    value = text(params, key)
    if value is not None and not os.path.isabs(value):
        raise ValueError(f'{key} must be an absolute directory path (got "{value}")')
    return value


def enclosing(params: Mapping[str, Any], key: str = "expand") -> bool:
    return text(params, key) == "function"


def extra_keywords(params: Mapping[str, Any], key: str = "grep_keywords") -> tuple[str, ...]:
    value = params.get(key)
    if value is None:
        return ()
    if not isinstance(value, list | tuple) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{key} must be an array of strings")
    return tuple(value)

"""Splitting text into the pieces that a byte-level tokenizer encodes one by one."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import regex

_ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}


@lru_cache(maxsize=8)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern in a text. ASCII texts take a pattern of ASCII classes, which the plain engine runs faster."""
    every = regex.compile(pattern).findall
    parts, inside, i = [], False, 0
    while i < len(pattern):
        step = next((c for c in _ASCII if pattern.startswith(c, i)), None)
        if step:
            parts.append(_ASCII[step] if inside else f"[{_ASCII[step]}]")
            i += len(step)
            continue
        if pattern[i] == "\\":
            parts.append(pattern[i : i + 2])
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        parts.append(pattern[i])
        i += 1
    plain = "".join(parts)
    if r"\p" in plain or r"\P" in plain or "(" in plain.replace("(?!", ""):
        return every
    ascii_only = re.compile(plain, re.ASCII).findall
    return lambda text: ascii_only(text) if text.isascii() else every(text)


class Memo(dict):
    """Values by key, computed when first asked for.

    It holds `fixed` and up to twice `limit` others: when `limit` new ones have come, those not asked for since the last time
    are forgotten.
    """

    def __init__(self, compute: Callable, fixed: dict, limit: int):
        super().__init__(fixed)
        self._compute, self._fixed, self._limit, self._former = compute, fixed, limit + len(fixed), {}

    def __missing__(self, key):
        value = self._former.get(key)
        if value is None:
            value = self._compute(key)
        if len(self) >= self._limit:
            self._former = dict(self)
            self.clear()
            self.update(self._fixed)
        self[key] = value
        return value

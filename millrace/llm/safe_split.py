"""Cutting long texts where no token of a byte-level BPE can reach across.

A match of the splitting pattern that holds a non-space character ends with
one and starts with at most one space, and a run of spaces starts a match.
So between a non-space character and a following space there is always a
boundary, and neither side's matches depend on the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex

_CUT = regex.compile(r"(?<=\S)(?=\s)")
_LONG_RUN = regex.compile(r"\s{2,}")


def pieces(text: str, limit: int = 100_000) -> Iterator[str]:
    """Consecutive parts of ``text``, cut at the first safe boundary past every ``limit`` characters."""
    start = 0
    while len(text) - start > limit:
        found = _CUT.search(text, start + limit)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < len(text) or not text:
        yield text[start:]


def space_runs(text: str, longest: int = 1_000) -> Iterator[tuple[bool, str]]:
    """Parts of ``text`` as (is one token-run of spaces, part).

    A run of over ``longest`` spaces is one match of the pattern, but for its
    last character when text follows; it is split off so that no regular
    expression has to walk through it.
    """
    start = 0
    for found in _LONG_RUN.finditer(text):
        a, b = found.span()
        if b - a <= longest:
            continue
        if a > start:
            yield False, text[start:a]
        end = b if b == len(text) else b - 1
        yield True, text[a:end]
        start = end
    if start < len(text):
        yield False, text[start:]

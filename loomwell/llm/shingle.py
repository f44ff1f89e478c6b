"""Runs of words."""

from __future__ import annotations

import itertools


def shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= size:
        return [flat]
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    return [flat[s : e - 1] for s, e in zip(starts, ends[size - 1 :])]

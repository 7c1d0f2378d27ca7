"""Spans found by fixed expressions, and how they are written down."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from re import Pattern

Span = tuple[str, int, int]


def matches(text: str, kinds: dict[str, tuple[str, Pattern | Callable, Callable | None]]) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test; (needed substring, expression or scan, test of the match)."""
    out = []
    for kind, (needs, pattern, test) in kinds.items():
        if needs not in text:
            continue
        if callable(pattern):
            out += [(kind, s, e) for s, e in pattern(text)]
        else:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if test(m)]
    return out


def written(spans: Iterable[Span], order: list[str]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = {k: i for i, k in enumerate(order)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def digest(spans: Iterable[Span], order: list[str]) -> str:
    return hashlib.sha256(written(spans, order).encode()).hexdigest()


def overlapped(start: int, end: int, spans: Iterable[Span]) -> bool:
    return any(s < end and start < e for _, s, e in spans)

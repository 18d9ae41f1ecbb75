"""Spans in texts: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def by_start(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def by_kind(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (kinds.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()

"""Plain models of the operators, for small fixtures."""

from __future__ import annotations

import collections
import hashlib
import re


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_components(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def kept_bytes(texts: list[str | None], length: int = 400) -> list[tuple[int, int, bytes]]:
    """(removed, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(x for x, g in zip(d, gone) if not g)))
    return out


def hits(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, list[str]]:
    """(words, words hit, items found) of one document."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    words, hit, found = cut(text), set(), set()
    for item, other in items:
        theirs = cut(other)
        n = min(len(theirs), 10)
        windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

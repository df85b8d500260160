"""Splitting a text as the byte-level vocabularies expect, before any merge."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex

_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: Where every character of a text is in this set, the classes below mean what
#: \p{L}, \p{N} and \s mean, and the faster standard module can split it.
_OTHER = re.compile(r"[^\x00-\x1b\x20-\x7e¡«»¿À-ÖØ-öø-ſ‐-‧€]")
_PLAIN = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[^\s{_LETTERS}0-9]+| ?[0-9]+|\s+(?!\S)|\s+"
)
_FULL = regex.compile(public_tokenizers.PATTERN)


def pieces(text: str) -> list[str]:
    """The matches of ``public_tokenizers.PATTERN`` in ``text``, in order."""
    return (_FULL if _OTHER.search(text) else _PLAIN).findall(text)


_SPACE, _LETTER, _DIGIT, _MARK, _REST = range(5)  # classes of bytes; _REST: not the first of a character


def _classes() -> np.ndarray:
    out = np.full(256, _MARK, np.uint8)
    out[[*b"\t\n\v\f\r "]] = _SPACE
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, 0xC4, 0xC5]] = _LETTER
    out[0x30:0x3A] = _DIGIT
    out[0x80:0xC0] = _REST
    return out


_CLASS = _classes()
#: Bytes that begin no character of ``_OTHER``'s set, and those that may.
_NEVER, _PERHAPS = np.zeros(256, bool), np.zeros(256, bool)
_NEVER[[*range(0x1C, 0x20), 0x7F, 0xC0, 0xC1, *range(0xC6, 0xE2), *range(0xE3, 0x100)]] = True
_PERHAPS[[0xC2, 0xC3, 0xE2]] = True


def plain_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold no character of ``_OTHER``; text ``i`` is UTF-8 from ``offsets[i]`` to ``offsets[i + 1]``."""
    places = np.flatnonzero(_NEVER[data])
    lead = np.flatnonzero(_PERHAPS[data])
    lead = lead[lead < len(data) - 1]
    first, second, third = data[lead], data[lead + 1], data[np.minimum(lead + 2, len(data) - 1)]
    good = np.where(first == 0xC2, np.isin(second, [0xA1, 0xAB, 0xBB, 0xBF]), (second != 0x97) & (second != 0xB7))
    dashes, euro = (second == 0x80) & (third >= 0x90) & (third <= 0xA7), (second == 0x82) & (third == 0xAC)
    good = np.where(first == 0xE2, dashes | euro, good)
    out = np.ones(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.concatenate([places, lead[~good]]), "right") - 1] = False
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the ``pieces`` of all texts begin in ``data``, for texts that are all plain."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    rest = np.flatnonzero(kind == _REST)
    for _ in range(2):  # a plain character has three bytes at most
        kind[rest] = kind[rest - 1]
    edge = np.zeros(n + 1, bool)  # texts begin and end here
    edge[offsets] = True
    start = np.append(True, kind[1:] != kind[:-1]) | edge[:n]
    space = kind == _SPACE
    # of white space before anything else the last character stands alone, or goes with it if it is a space
    last = space[:-1] & ~space[1:] & ~edge[1:n]
    start[1:] &= ~(last & (data[:-1] == 0x20))
    start[:-1] |= last
    quote = np.flatnonzero((data == 0x27) & start)
    quote = quote[(quote < n - 1) & ~edge[np.minimum(quote + 1, n)]]
    one, two = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
    taken = np.isin(one, [*b"stmd"]).astype(np.int64)
    pair = ((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C))
    taken[pair & (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]] = 2
    quote, taken = quote[taken > 0], taken[taken > 0]
    start[quote + 1] = False
    after = quote + 1 + taken
    start[after[after < n]] = True
    return np.flatnonzero(start)


class Memo(dict):
    """Results by key, computed when first asked for.

    Of ``most`` results at most half are those asked for lately; when there are as many,
    they become the older half and the older half is forgotten, so what is asked
    for often stays.
    """

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.compute(key)
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def many(self, keys: list, compute_all: Callable[[list], list]) -> list:
        """Results of different keys at once; ``compute_all`` gives those of the keys that are new."""
        found = list(map(self.get, keys))
        asked = [i for i, value in enumerate(found) if value is None]
        for i in asked:
            found[i] = self.older.get(keys[i])
        new = [i for i in asked if found[i] is None]
        for i, value in zip(new, compute_all([keys[i] for i in new]) if new else ()):
            found[i] = value
        if 2 * (len(self) + len(asked)) >= self.most:
            self.older = dict(self)
            self.clear()
        self.update((keys[i], found[i]) for i in asked)
        return found

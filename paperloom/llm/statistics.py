"""Rule statistics of a text, shared by the quality operators.

Words are runs of characters other than space and \\t..\\r.  All counts cover the
whole text.  A null text has no words; every count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_MARKS = b"!?.,;:"
_SPACES = " \t\n\v\f\r"

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
ARROW = pa.struct([(name, pa.int64()) for name in NAMES])
DDL = ", ".join(f"{name} bigint" for name in NAMES)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, n)
    m = len(numbers)
    pairs = ids[:-1] * m + ids[1:]
    if m > 2_000_000:  # three of them would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, which, counts = np.unique(pairs[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    hit = np.zeros(n, bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def count_of(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of ``NAMES`` for one text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes: splits at space and \t..\r alone
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        count_of(data, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        count_of(data, _UPPER),
        count_of(data, _DIGITS),
        count_of(data, _MARKS),
    )


def of_batch(texts) -> pa.StructArray:
    columns = zip(*(statistics(value.as_py()) for value in texts)) if len(texts) else [[] for _ in NAMES]
    return pa.StructArray.from_arrays([pa.array(column, pa.int64()) for column in columns], list(NAMES))

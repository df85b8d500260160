"""Linear classifiers of hashed character n-grams, scaled by naive Bayes log-count ratios.

Features are binary: the distinct n-grams of a text, each hashed to one of
``PLACES`` places.  A fit takes the places whose spread over the two kinds of rows
is farthest from chance (by the log-likelihood ratio statistic), scales each by
the log ratio of its smoothed frequencies, and finds weights by logistic
regression with an L2 penalty.

Every fit is done once for each fold of the training rows, on the other folds, and
once on all.  The out-of-fold scores choose how many places are taken, and give
the two numbers of the calibration that turns scores into probabilities.  Callers
may score a row with the model that has not seen its fold.

Texts are hashed in segments, so memory does not grow with their length; a row
holds ``PLACES`` features at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BITS = 20
PLACES = 1 << BITS
SEGMENT = 1 << 16
LEAST_ROWS, SMOOTHING, PENALTY, STEPS = 3, 1.0, 1e-5, 200
#: How many places may be taken; the out-of-fold loss chooses.
SIZES_TRIED = (1_000, 2_000)
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def gram_places(text: str, sizes: tuple[int, ...], lower: bool) -> Iterator[np.ndarray]:
    """Places of all n-grams of a text between two spaces, with repeats, in segments."""
    text = f" {text.lower() if lower else text} "
    most = max(sizes)
    for at in range(0, len(text), SEGMENT):
        data = np.frombuffer(text[at : at + SEGMENT + most - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        key = data
        for size in range(1, most + 1):
            if len(data) < size:
                break
            if size > 1:
                key = key[:-1] * _STEP + data[size - 1 :] + np.uint64(1)
            if size in sizes:
                yield ((key * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def place_of(name: str) -> int:
    """The place of a feature that is not an n-gram."""
    key = 0
    for character in name:
        key = (key * int(_STEP) + ord(character) + 1) & 0xFFFFFFFFFFFFFFFF
    return ((key * int(_MIX)) & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS)


def distinct(parts: Iterator[np.ndarray], seen: np.ndarray) -> np.ndarray:
    """Sorted distinct places; ``seen`` is scratch of ``PLACES`` False and left so."""
    for part in parts:
        seen[part] = True
    found = np.flatnonzero(seen).astype(np.int32)
    seen[found] = False
    return found


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Model(NamedTuple):
    """Weights of the places taken, a row for each fold and the last for all; and the calibration."""

    places: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    slope: float
    shift: float
    share: float

    def pack(self) -> tuple[bytes, bytes, bytes, float, float, float]:
        return self.places.astype(np.int32).tobytes(), self.weights.astype(np.float32).tobytes(), self.intercepts.astype(np.float64).tobytes(), self.slope, self.shift, self.share

    @classmethod
    def unpack(cls, places: bytes, weights: bytes, intercepts: bytes, slope: float, shift: float, share: float) -> Model:
        intercepts = np.frombuffer(intercepts, np.float64)
        places = np.frombuffer(places, np.int32)
        return cls(places, np.frombuffer(weights, np.float32).reshape(len(intercepts), len(places)), intercepts, slope, shift, share)


PACKED = "places binary, weights binary, intercepts binary, slope double, shift double, share double"


def constant(share: float, folds: int) -> Model:
    """A model that gives ``share`` to every row."""
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model(np.zeros(0, np.int32), np.zeros((folds + 1, 0)), np.full(folds + 1, np.log(share / (1 - share))), 1.0, 0.0, share)


class Scorer:
    """Probabilities by one model; made once for each task."""

    def __init__(self, model: Model):
        self.model = model
        self.column = np.full(PLACES, -1, np.int32)
        self.column[model.places] = np.arange(len(model.places), dtype=np.int32)

    def odds(self, parts: Iterator[np.ndarray], fold: int = -1) -> float:
        """Calibrated log odds of a row of these places by the model without ``fold`` (-1: of all rows)."""
        m = self.model
        taken = [column[column >= 0] for column in (self.column[part] for part in parts)]
        found = np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int32)
        return m.slope * (float(m.weights[fold][found].sum(dtype=np.float64)) + float(m.intercepts[fold])) + m.shift

    def probability(self, parts: Iterator[np.ndarray], fold: int = -1) -> float:
        return float(sigmoid(self.odds(parts, fold)))


def likelihood_ratio(a: np.ndarray, b: np.ndarray, of_a: int, of_b: int) -> np.ndarray:
    """How far ``a`` of ``of_a`` and ``b`` of ``of_b`` rows are from one common frequency."""

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    n, total = a + b, of_a + of_b
    return 2 * (part(a, n * of_a / total) + part(b, n * of_b / total) + part(of_a - a, (total - n) * of_a / total) + part(of_b - b, (total - n) * of_b / total))


def log_count_ratios(a: np.ndarray, b: np.ndarray, of_a: int, of_b: int) -> np.ndarray:
    return np.log((a + SMOOTHING) / (of_a + 2 * SMOOTHING)) - np.log((b + SMOOTHING) / (of_b + 2 * SMOOTHING))


def regress(column: np.ndarray, owner: np.ndarray, ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the columns (times their ratios) and intercept; Adam on all rows at once."""
    n, k = len(y), len(ratio)
    b = float(np.log(y.mean() / (1 - y.mean())))
    if not len(column):
        return np.zeros(k), b
    x = ratio[column]
    scale = 1.0 / max(float(np.sqrt(np.bincount(owner, x * x, n).mean())), 1e-9)
    x = x * scale
    w, moment, spread, mb, sb = np.zeros(k), np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, STEPS + 1):
        off = (sigmoid(np.bincount(owner, x * w[column], n) + b) - y) / n
        grad, gb = np.bincount(column, x * off[owner], k) + PENALTY * w, float(off.sum())
        moment, spread = 0.9 * moment + 0.1 * grad, 0.999 * spread + 0.001 * grad**2
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (moment / c1) / (np.sqrt(spread / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    return w * ratio * scale, b


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over scores, with targets drawn in from 0 and 1."""
    ones = int(y.sum())
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    slope, shift = 1.0, 0.0

    def loss(s, h):
        p = np.clip(sigmoid(s * z + h), 1e-12, 1 - 1e-12)
        return -float((target * np.log(p) + (1 - target) * np.log(1 - p)).sum())

    now = loss(slope, shift)
    for _ in range(100):
        p = sigmoid(slope * z + shift)
        weight, off = p * (1 - p) + 1e-9, p - target
        grad = np.array([(off * z).sum(), off.sum()])
        bend = np.array([[(weight * z * z).sum() + 1e-6, (weight * z).sum()], [(weight * z).sum(), weight.sum() + 1e-6]])
        step, size = np.linalg.solve(bend, grad), 1.0
        while size > 1e-4 and loss(slope - size * step[0], shift - size * step[1]) > now:
            size /= 2
        slope, shift = slope - size * step[0], shift - size * step[1]
        then, now = now, loss(slope, shift)
        if then - now < 1e-9:
            break
    return max(float(slope), 0.0), float(shift)


def fit(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray, folds: int, tried: tuple[int, ...] = SIZES_TRIED) -> Model:
    """A model from rows of distinct places, whether each is of the kind sought, and its fold;
    ``tried`` are the numbers of places to choose from."""
    n, y = len(rows), np.asarray(y, float)
    if n == 0 or y.all() or not y.any():
        return constant(float(y.mean()) if n else 0.0, folds)
    counts = np.zeros((folds, 2, PLACES), np.int32)
    of = np.zeros((folds, 2), int)
    for places, kind, f in zip(rows, y.astype(int), fold):
        counts[f, kind, places] += 1
        of[f, kind] += 1
    splits = []
    for without in [*range(folds), None]:
        b, a = (counts[:, kind].sum(0) - (0 if without is None else counts[without, kind]) for kind in (0, 1))
        of_b, of_a = (int(of[:, kind].sum() - (0 if without is None else of[without, kind])) for kind in (0, 1))
        if not of_a or not of_b:
            splits.append(None)
            continue
        known = np.flatnonzero(a + b >= LEAST_ROWS)
        told = likelihood_ratio(a[known].astype(float), b[known].astype(float), of_a, of_b)
        best = known[np.lexsort((known, -told))[: max(tried)]]
        splits.append((best, log_count_ratios(a[best].astype(float), b[best].astype(float), of_a, of_b)))
    del counts
    union = np.unique(np.concatenate([s[0] for s in splits if s is not None]))
    lookup = np.full(PLACES, -1, np.int32)
    lookup[union] = np.arange(len(union), dtype=np.int32)
    columns = [c[c >= 0] for c in (lookup[places] for places in rows)]
    flat, owner = np.concatenate(columns), np.repeat(np.arange(n), [len(c) for c in columns])
    share = float(y.mean())

    def train(split, use: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        weights = np.zeros(len(union))
        if split is None:
            return weights, float(np.log(share / (1 - share)))
        best, ratio = split[0][:size], split[1][:size]
        local = np.full(len(union), -1)
        local[lookup[best]] = np.arange(len(best))
        row = np.full(n, -1)
        row[use] = np.arange(len(use))
        mine = (local[flat] >= 0) & (row[owner] >= 0)
        w, b = regress(local[flat[mine]], row[owner[mine]], ratio, y[use])
        weights[lookup[best]] = w
        return weights, b

    fold, found = np.asarray(fold), []
    for size in tried:
        fitted = [train(splits[f], np.flatnonzero(fold != f), size) for f in range(folds)]
        w, b = np.array([x for x, _ in fitted]), np.array([x for _, x in fitted])
        z = np.bincount(owner, w[fold[owner], flat], n) + b[fold]
        slope, shift = calibration(z, y)
        p = np.clip(sigmoid(slope * z + shift), 1e-12, 1 - 1e-12)
        loss = -float(np.where(y > 0, np.log(p), np.log(1 - p)).mean())
        found.append((loss, size, fitted, slope, shift))
    _, size, fitted, slope, shift = min(found, key=lambda x: x[:2])
    fitted.append(train(splits[-1], np.arange(n), size))
    return Model(union.astype(np.int32), np.array([w for w, _ in fitted]), np.array([b for _, b in fitted]), slope, shift, share)

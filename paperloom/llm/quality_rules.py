"""Operator 10: base rules, and isolation forests on rule statistics.

The base rules reject texts of under 50 words, and texts in which over half of
the words lie in repeated 3-word windows.  What they keep is judged by isolation
forests, one for each family of statistics in ``FAMILIES``: random splits of raw
rates of the statistics; rows that few splits isolate are odd.  Each rate is a family
of its own.  A forest over all rates at once calls a clean text with one rare trait
as odd as a bad one, and cannot tell bad texts that are many and alike from others.

The forests are grown from a bounded sample: the first ``FOREST_ROWS`` documents by
a hash of the id, as numbers.  Texts are measured once and the statistics written down.  Thresholds are calibrated on all labelled rows, which the
executors score and count by ``BINS`` steps of the score.  A family's threshold is the
one that best tells the quality labels apart, a lost good row counting
``GOOD_COUNTS`` times, among those that keep ``KEEP_GOOD`` of the labelled good rows.
The family that gains most is set first, the next one on the rows that it leaves, until
one would find under ``LEAST_GAIN`` of the bad rows; families that are left judge
nothing.  Without labels of both kinds each threshold is the score that ``KEEP_GOOD`` of
the forest's rows stay below.

``anomaly`` is the largest ratio of a score to its family's threshold; rows above 1
are rejected.  Null texts have no words and fail the base rules.  Several labels of
one document count as one, the lowest.  Rows without an id are judged, but neither
sampled nor calibrated on.  An empty table gives no rows.  Columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import statistics as st
from .common import frugal, materialise, sample_by_hash, small_batches

FOREST_ROWS, BINS = 20_000, 4_096
TREES, SUBSAMPLE, SEED = 64, 256, 7
KEEP_GOOD, LEAST_GAIN, GOOD_COUNTS = 0.99, 0.1, 3
MIN_WORDS, MOST_REPEATED = 50, 50
#: Columns of ``rates`` by family.
FAMILIES = {"symbols": (0,), "marks": (1,), "word length": (2,), "capitals": (3,), "digits": (4,), "line length": (5,), "repeated words": (6,), "repeated lines": (7,)}
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, anomaly double"
)


def rates(counts: np.ndarray) -> np.ndarray:
    """Features of rows of ``statistics.NAMES`` that do not grow with the length of a text: symbols and
    marks a word, characters a word, capitals and digits a character, words a line, shares of repeated
    words and lines."""
    words, chars, symbols, again, repeat, lines, upper, digits, marks = counts.astype(float).T
    w, c, n = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.column_stack([symbols / w, marks / w, chars / w, upper / c, digits / c, words / n, repeat / w, again / n])


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def _usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as flat arrays: split feature (-1 at a leaf), threshold, children, leaf depth."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees if len(rows) else 0)]

    def _grow(self, rows: np.ndarray, rng):
        limit = int(np.ceil(np.log2(max(len(rows), 2))))
        feature, at, left, right, depth = [], [], [], [], []

        def node(part, d):
            i = len(feature)
            for column, value in ((feature, -1), (at, 0.0), (left, i), (right, i), (depth, d + _usual_path(len(part)))):
                column.append(value)
            low, high = part.min(0), part.max(0)
            free = np.flatnonzero(high > low)
            if d < limit and len(part) > 1 and len(free):
                k = int(rng.choice(free))
                cut = rng.uniform(low[k], high[k])
                below = part[:, k] < cut
                feature[i], at[i] = k, cut
                left[i], right[i] = node(part[below], d + 1), node(part[~below], d + 1)
            return i

        node(rows, 0)
        return np.array(feature), np.array(at), np.array(left), np.array(right), np.array(depth), limit

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; high for rows that few splits isolate."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, at, left, right, depth, limit in self.trees:
            here = np.zeros(len(rows), int)
            for _ in range(limit):
                split = feature[here]
                here = np.where(rows[each, np.maximum(split, 0)] < at[here], left[here], right[here])
            total += depth[here]
        return 2.0 ** (-total / len(self.trees) / max(_usual_path(self.size), 1e-9))


def grow(counts: np.ndarray) -> dict[str, IsolationForest]:
    """A forest for each family from rows of ``statistics.NAMES`` that pass the base rules."""
    found = rates(counts[~base_failed(counts)]) if len(counts) else np.zeros((0, 8))
    found = found[np.lexsort(found.T)]  # one order, whatever order tasks end in
    return {name: IsolationForest(found[:, columns], seed=SEED + k) for k, (name, columns) in enumerate(FAMILIES.items())}


def scores(forests: dict[str, IsolationForest], counts: np.ndarray) -> np.ndarray:
    """A column of anomaly scores for each family."""
    found = rates(counts)
    return np.column_stack([forests[name].score(found[:, columns]) for name, columns in FAMILIES.items()])


def best_cut(good: np.ndarray, bad: np.ndarray, all_good: int, all_bad: int) -> tuple[float, float]:
    """(gain, score above which rows are rejected) from counts of the rows left in each step of the score."""
    edges = (np.arange(BINS) + 1) / BINS
    lost = (good.sum() - np.cumsum(good)) / max(all_good, 1)
    gain = np.where(lost <= 1 - KEEP_GOOD, (bad.sum() - np.cumsum(bad)) / max(all_bad, 1) - GOOD_COUNTS * lost, -np.inf)
    best = int(np.argmax(gain))
    higher = np.flatnonzero((good + bad)[best + 1 :])
    return float(gain[best]), float((edges[best] + edges[best + 1 + higher[0]]) / 2) if len(higher) else float(edges[best])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every row: texts are read once, and only numbers go further."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *st.of_batch(batch.column(1)).flatten()], ["doc_id", *st.NAMES])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(frugal(run), f"doc_id bigint, {st.DDL}")


def _counts(batch: pa.RecordBatch) -> np.ndarray:
    """The statistics of a batch that begins with the id."""
    return np.column_stack([batch.column(k + 1).to_numpy() for k in range(len(st.NAMES))])


def fit(stats: DataFrame, labels: DataFrame) -> tuple[dict[str, IsolationForest], np.ndarray]:
    """Forests from a bounded sample of ``measured`` rows, and thresholds from counts over all labelled ones."""
    spark = stats.sparkSession
    known = stats.where("doc_id is not null")
    got = sample_by_hash(known, "doc_id", FOREST_ROWS).toPandas()
    sample = got[list(st.NAMES)].to_numpy()
    forests = grow(sample)
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    grown = spark.sparkContext.broadcast(forests)

    def steps(batches):
        for batch in batches:
            counts = _counts(batch)
            passed = ~base_failed(counts)
            found = np.minimum((scores(grown.value, counts[passed]) * BINS).astype(np.int32), BINS - 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FAMILIES)), pa.array(found.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(len(st.NAMES) + 1).filter(pa.array(passed))], ["steps", "quality"])

    scored = materialise(known.join(marked, "doc_id").select("doc_id", *st.NAMES, "quality").mapInArrow(frugal(steps), "steps array<int>, quality int"), "rule-scores")
    return forests, _thresholds(scored, forests, sample)


def _thresholds(scored: DataFrame, forests: dict[str, IsolationForest], sample: np.ndarray) -> np.ndarray:
    """The family that gains most is set first, the next on the rows that it leaves."""
    cuts = np.ones(len(FAMILIES))
    kinds = dict(scored.groupBy("quality").count().collect())
    if len(kinds) < 2:
        passed = sample[~base_failed(sample)] if len(sample) else sample
        return np.quantile(scores(forests, passed), KEEP_GOOD, axis=0) if len(passed) else cuts
    left, free = scored, set(range(len(FAMILIES)))
    while free:
        tally = np.zeros((len(FAMILIES), 2, BINS))
        for family, step, quality, n in left.select("quality", F.posexplode("steps").alias("family", "step")).groupBy("family", "step", "quality").count().collect():
            tally[family, quality, step] = n  # 2 * BINS rows a family at most
        (gain, cut), k = max((best_cut(tally[k, 1], tally[k, 0], kinds[1], kinds[0]), -k) for k in free)
        if gain < LEAST_GAIN:
            break
        cuts[-k] = cut
        free.remove(-k)
        left = left.where((F.get(F.col("steps"), -k) + 0.5) / BINS <= cut)
    return cuts


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base rules and verdict of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    stats = materialise(measured(docs), "rule-statistics")
    model = spark.sparkContext.broadcast(fit(stats, labels))

    def run(batches):
        forests, cuts = model.value
        for batch in batches:
            counts = _counts(batch)
            failed, odd = base_failed(counts), (scores(forests, counts) / cuts).max(1)
            columns = [*batch.columns[:6], pa.array(failed), pa.array(~failed & (odd <= 1)), pa.array(odd)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *st.NAMES[:5], "base_failed", "kept", "anomaly"])

    return stats.mapInArrow(frugal(run), SCHEMA)

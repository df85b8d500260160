"""Operator 9: quality by hierarchical empirical Bayes.

Three levels of evidence are added as log odds that a document is good:

* the document: a linear classifier of character n-grams (case kept) and of binned
  rates of the rule statistics, scaled by log-count ratios and calibrated on rows
  that its weights have not seen (``linear``); its log odds above the share of
  good rows in its sample are the evidence;
* its host and its path: the posterior share of good labels.  Host shares follow a
  beta prior around the global share, path shares one around their host's; the
  strength of each prior is fitted to the spread between groups by the method of
  moments, so that sites with few labels shrink to the level above.

Nothing that a row's own label says reaches its score: every row, labelled or not,
is in one of ``FOLDS`` folds by its id, and classifier, host and path are those of
the other folds.

The host is ``source`` up to the first slash behind any ``scheme://``; the path is the
whole ``source`` together with ``lang``.  The classifier is fitted on a bounded sample,
the first ``TRAIN_ROWS`` labelled rows by a hash of the id with their whole texts; host
and path posteriors count all labelled rows.  Several labels of one document count
as one, the lowest.  A null host or path is a group of its own; a null text has no
words, which is evidence like any other; a null id is in the first fold.  Without
labels of both kinds every score is the prior of 0.5 and everything is kept.

All columns of the input are carried through but those of the names that are
added: ``evidence``, ``host_posterior``, ``path_posterior``, ``score`` and ``kept``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from . import statistics as st
from .common import fold, free_names, frugal, join_checked, materialise, sample_by_hash, small_batches

KEEP_AT = 0.5
FOLDS, TRAIN_ROWS, SIZES, PLACES_TRIED = 5, 6_000, (2, 3, 4), (250, 500)
#: Added to the counts of the global share, and the prior strengths allowed.
SMOOTHING, LEAST_STRENGTH, MOST_STRENGTH = 1.0, 2.0, 10_000.0
#: Log odds of the document are held to this: no text decides against all sites.
MOST_EVIDENCE = 6.0
#: Upper edges of the bins of each rate.
EDGES = {
    "symbols": (0.02, 0.1, 0.3, 1.0),
    "capitals": (0.1, 0.3, 0.6),
    "marks": (0.3, 0.5, 1.0),
    "repeats": (0.25, 0.5, 0.75),
    "words": (10.0, 50.0),
}
_BINS = {(name, k): linear.place_of(f"{name}>{k}") for name, edges in EDGES.items() for k in range(len(edges))}
ADDED = ("evidence", "host_posterior", "path_posterior", "score", "kept")


def rates(text: str | None) -> dict[str, float]:
    count = dict(zip(st.NAMES, st.statistics(text)))
    words, chars = max(count["n_words"], 1), max(count["word_chars"], 1)
    return {
        "symbols": count["n_symbols"] / words,
        "capitals": count["n_upper"] / chars,
        "marks": count["n_marks"] / words,
        "repeats": count["n_repeat_words"] / words,
        "words": float(count["n_words"]),
    }


def features(text: str | None) -> Iterator[np.ndarray]:
    """Places of the n-grams and of every edge that a rate exceeds."""
    found = rates(text)
    yield np.array([place for (name, k), place in _BINS.items() if found[name] > EDGES[name][k]], np.int32)
    if text:
        yield from linear.gram_places(text, SIZES, lower=False)


def _fold() -> Column:
    return F.coalesce(fold("doc_id", FOLDS), F.lit(0)).cast("int")


def _host() -> Column:
    source = F.col("source").cast("string")
    host = F.regexp_extract(source, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/]*)", 1)
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), host))


def _path() -> Column:
    group = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    return F.concat_ws("\t", group("source"), group("lang"))


def _strength(groups: DataFrame, prior: Column) -> float:
    """Method of moments over groups with ``n`` labels, ``good`` of them good: how
    many labels the prior is worth."""
    n, p = F.col("n"), F.col("good") / F.col("n")
    row = groups.agg(
        F.sum(n * (p - prior) ** 2).alias("spread"),
        F.sum(prior * (1 - prior)).alias("chance"),
        F.sum((n - 1) * prior * (1 - prior)).alias("room"),
    ).first()
    if not row["room"]:
        return MOST_STRENGTH
    rho = (row["spread"] - row["chance"]) / row["room"]
    return MOST_STRENGTH if rho <= 0 else min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / rho - 1))


def _classifier(docs: DataFrame, marks: DataFrame) -> linear.Model:
    """Fitted on the bounded sample: features from the executors, weights from one task."""
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = sample.join(F.broadcast(sample_by_hash(marks, "doc_id", TRAIN_ROWS)), "doc_id").select("doc_id", _fold().alias("fold"), "good", "text")

    def extract(batches):
        seen = np.zeros(linear.PLACES, bool)
        for batch in batches:
            found = [linear.distinct(features(text.as_py()), seen).tobytes() for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["doc_id", "fold", "good", "places"])

    def train(batches):
        rows = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))]
        model = linear.fit([np.frombuffer(r[3], np.int32) for r in rows], np.array([bool(r[2]) for r in rows], bool), np.array([r[1] for r in rows], int), FOLDS, PLACES_TRIED)
        yield pa.RecordBatch.from_arrays([pa.array([value]) for value in model.pack()], [part.split()[0] for part in linear.PACKED.split(", ")])

    places = sample.mapInArrow(frugal(extract), "doc_id bigint, fold int, good int, places binary")
    row = places.repartition(1).sortWithinPartitions("doc_id", "places").mapInArrow(frugal(train), linear.PACKED).first()
    return linear.Model.unpack(*(bytes(x) if isinstance(x, bytearray) else x for x in row)) if row else linear.constant(0.5, FOLDS)


class Fitted:
    """The classifier, and DataFrames of host and path posteriors: one number for each fold left out."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        small_batches(docs.sparkSession)
        marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
        placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _host().alias("host"), _path().alias("path"))
        counts = placed.join(marks, "doc_id").groupBy("host", "path", _fold().alias("fold")).agg(F.count("*").alias("n"), F.sum("good").alias("good"))
        counts = materialise(counts, "quality-counts", ids_only=True)
        of_fold = {r["fold"]: (r["n"], r["good"]) for r in counts.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()}
        n, good = (sum(x[k] for x in of_fold.values()) for k in (0, 1))
        self.usable = 0 < good < n
        without = [(n - of_fold.get(f, (0, 0))[0], good - of_fold.get(f, (0, 0))[1]) for f in range(FOLDS)]
        #: The global share of each fold left out.
        self.shares = [(g + SMOOTHING) / (m + 2 * SMOOTHING) for m, g in without]
        self.model = _classifier(docs, marks) if self.usable else linear.constant(0.5, FOLDS)
        share = F.lit((good + SMOOTHING) / (n + 2 * SMOOTHING))
        hosts = self._grouped(counts, "host")
        self.host_strength = _strength(hosts, share)
        self.hosts = hosts.select("host", self._shrunk([F.lit(x) for x in self.shares], self.host_strength).alias("of_host"))
        paths = self._grouped(counts, "host", "path").join(self.hosts, "host")
        self.path_strength = _strength(paths, F.aggregate("of_host", F.lit(0.0), lambda a, x: a + x) / FOLDS)
        self.paths = paths.select("path", self._shrunk([F.get(F.col("of_host"), f) for f in range(FOLDS)], self.path_strength).alias("of_path"))

    @staticmethod
    def _grouped(counts: DataFrame, *keys: str) -> DataFrame:
        """Counts of each group, and those of each of its folds."""
        each = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(FOLDS) for c in ("n", "good")]
        return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), *each)

    @staticmethod
    def _shrunk(priors: list[Column], strength: float) -> Column:
        """Posterior shares without each fold."""
        worth = F.lit(strength)
        return F.array(*((F.col("good") - F.col(f"good_{f}") + worth * prior) / (F.col("n") - F.col(f"n_{f}") + worth) for f, prior in enumerate(priors)))

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``evidence``, ``host_posterior``, ``path_posterior``, ``score`` and ``kept``."""
        model = docs.sparkSession.sparkContext.broadcast(self.model)

        @F.arrow_udf("double")
        def evidence(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            scorer = linear.Scorer(model.value)
            base = float(np.log(scorer.model.share / (1 - scorer.model.share)))
            for texts, folds in parts:
                odds = [scorer.odds(features(text.as_py()), f) - base for text, f in zip(texts, folds.to_pylist())]
                yield pa.array(np.clip(np.array(odds, float), -MOST_EVIDENCE, MOST_EVIDENCE))

        host, path, of_host, of_path, of_fold, own = free_names(docs.columns, "host", "path", "of_host", "of_path", "fold", "own")
        out = docs.withColumns({host: _host(), path: _path(), of_fold: _fold()})
        out = out.withColumn(own, evidence(F.col("text").cast("string"), F.col(of_fold)) if self.usable else F.lit(0.0))
        hosts = self.hosts.select(F.col("host").alias(host), F.col("of_host").alias(of_host))
        paths = self.paths.select(F.col("path").alias(path), F.col("of_path").alias(of_path))
        out = join_checked(join_checked(out, hosts, host, "left"), paths, path, "left")
        at_host = F.coalesce(F.get(F.col(of_host), F.col(of_fold)), F.get(F.array(*map(F.lit, self.shares)), F.col(of_fold)))
        at_path = F.coalesce(F.get(F.col(of_path), F.col(of_fold)), at_host)
        odds = F.col(own) + F.log(at_path / (1 - at_path))
        score = 1 / (1 + F.exp(-odds)) if self.usable else F.lit(0.5)
        columns = [F.col(own).alias("evidence"), at_host.alias("host_posterior"), at_path.alias("path_posterior"), score.alias("score"), (score >= F.lit(KEEP_AT)).alias("kept")]
        return out.select(*(F.col(c) for c in docs.columns), *columns)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every column of ``docs`` but those of the names added, and the scores of each row."""
    docs = docs.drop(*ADDED)
    return Fitted(docs, labels).score(docs)

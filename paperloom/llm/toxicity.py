"""Operator 2: toxicity by a linear classifier of character n-grams scaled by
naive Bayes log-count ratios.

The features of a text are the distinct n-grams of its lower-cased characters, of
the lengths ``SIZES``, hashed to places; ``linear`` scales them by the log ratio of
their smoothed frequencies among toxic and other training texts and fits the
weights.  How many places are taken and the calibration of the score come from
``INNER`` folds inside the training rows, so a score of 0.7 means odds of 7 to 3
on rows that the weights have not seen.

Training reads a bounded sample: of the labelled rows that are not held out, the
first ``TRAIN_ROWS`` by a hash of the id, with their whole texts.  Scores use the
text alone.  Null and empty texts have no features and get the score of the
intercept.  Without labels of both kinds every score is the share of toxic labels
(0 without any).  Several labels of one document count as one, the highest; rows
that share an id are trained on with the same label.  A row without an id is
scored, but neither held out nor trained on.  Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .common import fold, frugal, sample_by_hash, small_batches

FOLDS, HELD_OUT, INNER = 3, 1, 5
TRAIN_ROWS = 6_000
SIZES = (3, 4, 5, 6)
TOXIC_AT = 0.7


def features(text: str | None):
    return linear.gram_places(text, SIZES, lower=True) if text else iter(())


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> linear.Model:
    """The model: features of the bounded sample from the executors, weights from one task."""
    marks = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(fold("doc_id", FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = sample.join(F.broadcast(sample_by_hash(marks, "doc_id", rows)), "doc_id").select("doc_id", "toxic", "text")

    def extract(batches):
        seen = np.zeros(linear.PLACES, bool)
        for batch in batches:
            found = [linear.distinct(features(text.as_py()), seen).tobytes() for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "toxic", "places"])

    def train(batches):
        got, toxic, inner = [], [], []
        for batch in batches:
            for key, kind, places in zip(*(column.to_pylist() for column in batch.columns)):
                got.append(np.frombuffer(places, np.int32))
                toxic.append(bool(kind))
                inner.append(inner_fold(key))
        model = linear.fit(got, np.array(toxic, bool), np.array(inner, int), INNER)
        yield pa.RecordBatch.from_arrays([pa.array([value]) for value in model.pack()], [part.split()[0] for part in linear.PACKED.split(", ")])

    places = sample.mapInArrow(frugal(extract), "doc_id bigint, toxic int, places binary")
    row = places.repartition(1).sortWithinPartitions("doc_id", "places").mapInArrow(frugal(train), linear.PACKED).first()
    return linear.Model.unpack(*map(_plain, row)) if row else linear.constant(0.0, INNER)


def inner_fold(doc_id: int) -> int:
    """The fold of a training row among the training rows."""
    return (doc_id * 2654435761 >> 7) % INNER


def _plain(value):
    return bytes(value) if isinstance(value, bytearray) else value


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Score and prediction of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, rows))

    def run(batches):
        scorer = linear.Scorer(model.value)
        for batch in batches:
            found = [scorer.probability(features(value.as_py())) for value in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(x >= TOXIC_AT) for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return keyed.mapInArrow(frugal(run), "doc_id bigint, held_out boolean, score double, predicted int")

"""A corpus from documents: classify, deduplicate twice, decontaminate, encode.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it
kept.  All but the last return the columns of documents.

Rows are told apart by id and text, and a null id is an id like others.  Of equal
rows near_dedup keeps one; where two texts share an id, each is judged on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe_transducer, decontaminate, near_dedup, quality_classifier, suffix_dedup
from paperloom.llm.common import join_checked, materialise, new_folder, room_for_python, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The similarity of near-duplicates here; the 85 of the op4 query is its own.
NEAR_PERCENT = 80
#: A passage of so many words that repeats goes, and so does one of the 400 bytes of op6.
REPEATED_WORDS = 51


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without ``rows`` (doc_id, text_hash)."""
    return join_checked(docs, *_match(rows), "left_anti")


def _match(rows: DataFrame) -> tuple[DataFrame, Column]:
    named = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash"))
    return named, same


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of least id, a null id last."""
    room_for_python(spark)
    docs = docs.select(*COLUMNS)
    gone, again = near_dedup.redundant(docs, NEAR_PERCENT)
    gone, again = materialise(gone, "near-duplicates", ids_only=True), materialise(again, "equal-rows", ids_only=True)
    left = _without(docs, gone)
    if again.isEmpty():
        return left
    once = join_checked(left, *_match(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(left, again).unionByName(once)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; a document of which nothing is left goes.

    A character of which bytes were cut goes as a whole.
    """
    room_for_python(spark)
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True, words=REPEATED_WORDS)
    left = cut.where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    return left.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), with_hash=True)
    gone = materialise(found.where("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
    return _without(docs.select(*COLUMNS), gone)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document left, checked by decoding them; executors still hold what the stages before took."""
    room_for_python(spark)
    return bpe_transducer.encode(docs, ids=True, bounds=bpe_transducer.LEAN)


STAGES = [
    ("quality_classifier", classify_quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontaminate", remove_benchmark),
    ("byte_bpe", encode),
]

#: Connected components and byte-pair merges are beyond SQL here.  The tests hold each
#: operator, and the stages together, against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The flagship query: documents to chunks to a ranked, cited answer list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, pagerank, retrieval
from ..sources.tables import read
from . import catalogue

QUESTION = catalogue.QUERY


def hybrid_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top chunks for a question by embedding, graph rank and seed papers.

    The graph links sources by shared languages; it has one node for each source.
    """
    found = chunking.chunks(catalogue.markdown(spark, sf_dir))
    c = F.col
    rows = found.select(
        F.format_string("chk-%d-%d-%d", "doc_id", "section_no", "paragraph_idx").alias("chunk_id"), "text", "section", "section_category",
        c("source").alias("workspace_id"), c("source").alias("doi"), F.concat("source", F.lit(".md")).alias("filename"), F.lit(None).cast("string").alias("paper_id"),
    ).withColumn("embedding", text.mock_embedding(c("text")))
    docs = read(spark, sf_dir, "documents")
    edges = docs.select(c("source").alias("src"), F.concat(F.lit("lang-"), "lang").alias("dst")).distinct()
    ranks = pagerank.normalised(pagerank.pagerank(edges, rounds=10, tolerance=None))
    best = retrieval.search(rows, text.mock_vector(QUESTION), 5, ranks=ranks, seeds=["src1"])
    token = text.citation_token(c("workspace_id"), c("paper_id"), c("doi"), c("filename"), c("section"), c("chunk_id"))
    return best.select("chunk_id", "text", "cosine_sim", "pagerank_score", "seed_boost", "hybrid_score", "raw_distance", token.alias("citation_token"))

"""Questions in words: filters, vectors, graph and seeds, and what was asked in the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import pagerank, retrieval
from ..sources import files
from ..sources.store import Store
from . import events
from .embedders import Embedder

RESULT = ("chunk_id", "text", "cosine_sim", "pagerank_score", "seed_boost", "hybrid_score", "raw_distance", "citation_token")
_NAMED = ("workspace_id", "paper_id", "doi", "filename", "section")


def ranks_of(store: Store, source) -> DataFrame | None:
    """Ranks from a mapping, a DataFrame of edges (src, dst), or a graph file; none where there is nothing."""
    spark = store.spark
    if source is None:
        return None
    if isinstance(source, dict):
        return spark.createDataFrame([(str(k).lower().strip(), float(x)) for k, x in source.items()], "node string, rank double") if source else None
    if isinstance(source, DataFrame):
        return pagerank.normalised(pagerank.pagerank(source))
    edges, ranks, nodes = files.citation_graph(spark, source)
    if ranks is not None:
        return ranks.select(F.lower(text.strip(F.col("node"))).alias("node"), "rank")
    return None if nodes.isEmpty() else pagerank.normalised(pagerank.pagerank(edges, nodes=nodes))


def query(
    store: Store, embedder: Embedder, question: str, k: int = 5, *, custom: dict | None = None, seeds: list[str] | None = None, graph=None,
    alpha: float = retrieval.ALPHA, beta: float = retrieval.BETA, journal: str | None = None, **equal,
) -> DataFrame:
    """The k best chunks for a question, each with its scores and citation token; none from an empty store."""
    live = store.live()
    if live is None:
        return store.spark.createDataFrame([], "chunk_id string, text string, cosine_sim double, pagerank_score double, seed_boost double, hybrid_score double, raw_distance double, citation_token string, " + ", ".join(f"{name} string" for name in _NAMED))
    for name in _NAMED:
        if name not in live.columns:
            live = live.withColumn(name, F.lit(None).cast("string"))
    best = retrieval.search(live, embedder.one(question), k, custom=custom, ranks=ranks_of(store, graph), seeds=seeds, alpha=alpha, beta=beta, **equal)
    c = F.col
    out = best.withColumn("citation_token", text.citation_token(c("workspace_id"), c("paper_id"), c("doi"), c("filename"), c("section"), c("chunk_id"))).select(*RESULT, *_NAMED)
    if journal is not None:
        top = out.collect()  # k rows
        if top:
            events.audit(journal, "RAG_QUERY_RETRIEVED", {"query": question, "boost_dois": seeds or []}, {"results_count": len(top), "top_distance": top[0]["raw_distance"]})
        return store.spark.createDataFrame(top, out.schema)
    return out


def ranked_table(found: DataFrame) -> DataFrame:
    """Results with their rank in front, for people to read."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("hybrid_score"), "raw_distance", "chunk_id"))  # k rows
    return found.select(place.alias("rank"), "hybrid_score", "cosine_sim", "citation_token", text.snippet(F.col("text")).alias("snippet"))

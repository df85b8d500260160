"""Filtered, graph-boosted top-k retrieval over chunks with embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

ALPHA, BETA, OVERFETCH = 0.25, 0.15, 4
FILTERS = ("section", "section_category", "paradigm", "study_design", "workspace_id", "doi")
_COMPARE = {
    "$eq": lambda c, x: c == x, "$ne": lambda c, x: c != x, "$gt": lambda c, x: c > x, "$gte": lambda c, x: c >= x,
    "$lt": lambda c, x: c < x, "$lte": lambda c, x: c <= x, "$in": lambda c, x: c.isin(*x), "$nin": lambda c, x: ~c.isin(*x),
}


def condition(where: dict) -> Column:
    """A nested filter of column names, ``$and``, ``$or`` and comparisons as a predicate."""

    def of(key: str, value) -> Column:
        if key in ("$and", "$or"):
            return reduce(Column.__and__ if key == "$and" else Column.__or__, map(condition, value))
        if isinstance(value, dict):
            if unknown := set(value) - set(_COMPARE):
                raise ValueError(f"unknown comparison: {sorted(unknown)}")
            return reduce(Column.__and__, (_COMPARE[k](F.col(key), x) for k, x in value.items()))
        return F.col(key) == F.lit(value)

    return reduce(Column.__and__, (of(k, x) for k, x in where.items()))


def where(chunks: DataFrame, custom: dict | None = None, **equal: str | None) -> DataFrame:
    """Rows that meet all given equalities and the custom filter; empty values do not count."""
    if unknown := set(equal) - set(FILTERS):
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    tests = [F.col(name) == equal[name] for name in FILTERS if equal.get(name)] + ([condition(custom)] if custom else [])
    return chunks.where(reduce(Column.__and__, tests)) if tests else chunks


def with_distance(chunks: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """Adds the cosine distance to a query vector."""
    return chunks.withColumn("distance", 1 - text.cosine(F.col(column), F.array(*(F.lit(float(x)) for x in query))))


def nearest(chunks: DataFrame, query: list[float], k: int, tie: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """The k rows of least distance: a top-k in each task and one merge, no shuffle."""
    return with_distance(chunks, query, column).orderBy("distance", tie).limit(k)


def boosted(chunks: DataFrame, ranks: DataFrame | None, seeds: list[str] | None, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """Adds cosine, rank, seed and hybrid scores to rows that carry ``distance``.

    The rank of a row is that of its DOI, else of its paper, else of its file name;
    a rank of 0 counts as none.
    """
    keys = {k: F.lower(text.strip(F.col(k))) for k in ("doi", "paper_id", "filename") if k in chunks.columns}
    rank = F.lit(0.0)
    out = chunks
    if ranks is not None:
        tried = []
        for name, key in keys.items():
            side = ranks.select(F.col("node").alias("_node"), F.col("rank").alias(f"_rank_{name}"))
            out = out.join(side, key == F.col("_node"), "left").drop("_node")
            tried.append(F.nullif(F.col(f"_rank_{name}"), F.lit(0.0)))
        rank = F.coalesce(*tried, F.lit(0.0))
    wanted = sorted({s.strip().lower() for s in seeds or ()})
    is_seed = reduce(Column.__or__, (F.coalesce(key.isin(*wanted), F.lit(False)) for key in keys.values())) if wanted and keys else F.lit(False)
    cos = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / 2))
    seed = F.when(is_seed, 1.0).otherwise(0.0)
    scored = out.withColumns({"_cos": cos, "_pr": rank, "_seed": seed})
    return scored.select(
        *chunks.columns,
        F.round("_cos", 4).alias("cosine_sim"),
        F.round("_pr", 4).alias("pagerank_score"),
        F.round("_seed", 4).alias("seed_boost"),
        F.round(F.col("_cos") + alpha * F.col("_pr") + beta * F.col("_seed"), 4).alias("hybrid_score"),
        F.round("distance", 4).alias("raw_distance"),
    )


def search(
    chunks: DataFrame, query: list[float], k: int = 5, *, custom: dict | None = None, ranks: DataFrame | None = None, seeds: list[str] | None = None,
    alpha: float = ALPHA, beta: float = BETA, tie: str = "chunk_id", **equal,
) -> DataFrame:
    """Hybrid retrieval in two steps: the nearest rows by vector, four times as many
    if there is anything to boost by, and of those the best k by hybrid score."""
    boost = ranks is not None or bool(seeds)
    near = nearest(where(chunks, custom, **equal), query, OVERFETCH * k if boost else k, tie)
    scored = boosted(near, ranks, seeds, alpha, beta)
    return scored.orderBy(F.desc("hybrid_score"), "distance", tie).limit(k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding", block: int = 4096) -> DataFrame:
    """The k nearest vectors of each query by cosine distance, itself included.

    Queries go out in blocks of fixed size.  A task keeps the best k of each query
    over its rows; those few are merged by query.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v"))
    parts, held = [], []

    def over(rows) -> DataFrame:
        ids = np.array([r["id"] for r in rows], np.int64)
        matrix = _unit(np.array([r["v"] for r in rows], float))
        sent = spark.sparkContext.broadcast((ids, matrix))

        def run(batches):
            ids, matrix = sent.value
            best_d = np.full((len(ids), 0), np.inf)
            best_i = np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                own = batch.column(0).to_numpy()
                flat = _unit(np.array(batch.column(1).to_pylist(), float).reshape(len(own), -1)) if len(own) else None
                if flat is None:
                    continue
                d = np.concatenate([best_d, 1 - matrix @ flat.T], 1)
                i = np.concatenate([best_i, np.broadcast_to(own, (len(ids), len(own)))], 1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            n = best_d.shape[1]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], ["query_id", "neighbour_id", "distance"])

        return vectors.select(F.col(id_col).cast("bigint"), column).mapInArrow(run, "query_id bigint, neighbour_id bigint, distance double")

    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == block:
            parts.append(over(held))
            held = []
    if held or not parts:
        parts.append(over(held)) if held else parts.append(spark.createDataFrame([], "query_id bigint, neighbour_id bigint, distance double"))
    found = reduce(DataFrame.unionByName, parts)
    from pyspark.sql import Window

    best = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _unit(matrix):
    import numpy as np

    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)

"""Cited claims from generated text, and how well their sources carry them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

NOTHING_FOUND = "No relevant evidence found in indexed corpus."
VERIFIED, AMBIGUOUS = 0.85, 0.50
LEXICAL_VERIFIED, LEXICAL_AMBIGUOUS = 0.6, 0.3


def status(score: Column, verified: float = VERIFIED, ambiguous: float = AMBIGUOUS) -> Column:
    return F.when(score >= verified, "VERIFIED").when(score >= ambiguous, "AMBIGUOUS").otherwise("UNSUPPORTED")


def generated_bullets(retrieved: DataFrame, query: str, place: str = "place") -> DataFrame:
    """One row of Markdown with a cited bullet for each retrieved chunk, in order."""
    bullet = F.struct(F.col(place).alias("at"), F.concat(F.lit("- "), text.snippet(F.col("text")), F.lit(" "), F.col("citation_token")).alias("line"))
    kept = retrieved.where(text.snippet(F.col("text")) != "")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(bullet)), lambda x: x["line"]), "\n")
    return kept.agg(F.concat(F.lit(f"### Synthesis for: {query}\n\n"), lines).alias("markdown"))


def prompt(retrieved: DataFrame, query: str, place: str = "place") -> DataFrame:
    """One row with the grounding prompt of the retrieved chunks."""
    head = f"SYSTEM INSTRUCTION: You are an expert scientific synthesis agent.\nResearch Question / Query: {query}\n\nSOURCE EVIDENCE CHUNKS:"
    rules = "\n".join((
        "SYNTHESIS RULES:",
        "1. Synthesize a concise, rigorous response answering the research question.",
        "2. Every single empirical assertion, quantitative figure, or factual claim MUST end with its exact citation token.",
        "3. If evidence is conflicting, explicitly contrast the findings and state the differing methodology.",
        "4. Do NOT hallucinate claims not present in the provided chunks.",
    ))
    part = F.format_string(
        "--- [CHUNK %s] (Token: %s) ---\nSection: %s (%s)\nText: %s\n", F.col(place).cast("string"), "citation_token",
        F.coalesce("section", F.lit("N/A")), F.coalesce("section_category", F.lit("general")), "text",
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), part.alias("line")))), lambda x: x["line"])
    return retrieved.agg(F.concat_ws("\n", F.lit(head), parts, F.lit(rules)).alias("prompt"))


def cited_units(markdown: DataFrame, column: str = "markdown") -> DataFrame:
    """A row for each unit that has a citation: ``claim_seq``, ``unit``, ``citation_tokens``."""
    kept = [c for c in markdown.columns if c != column]
    units = markdown.select(*kept, F.posexplode(text.claim_units(F.col(column))).alias("claim_seq", "unit"))
    return units.withColumn("citation_tokens", text.citation_tokens(F.col("unit"))).where(F.size("citation_tokens") > 0)


def support(units: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(claim_seq, unit, support_seq, chunk columns) of each source of each unit: the
    chunk of a token exactly, or else all chunks whose id lies within the token.

    The second join only sees tokens that the first did not match, and joins on the
    token's last part where ids stand; only ids placed elsewhere need the scan of the
    retrieved chunks, which are few.
    """
    tokens = units.select("claim_seq", "unit", F.posexplode("citation_tokens").alias("token_no", "token"))
    chunks = retrieved.select("chunk_id", "citation_token", F.col("text").alias("chunk_text"), *(c for c in ("workspace_id", "paper_id", "filename") if c in retrieved.columns))
    exact = tokens.join(chunks, tokens["token"] == chunks["citation_token"])
    rest = tokens.join(chunks, tokens["token"] == chunks["citation_token"], "left_anti")
    within = rest.join(chunks, F.contains("token", "chunk_id"))
    return exact.unionByName(within).withColumn("support_seq", F.row_number().over(Window.partitionBy("claim_seq").orderBy("token_no", "chunk_id")))


def lexical_overlap(claim: Column, chunk: Column) -> Column:
    """Share of a claim's distinct words that the chunk has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(claim), words(chunk))), F.size(words(claim))), F.lit(0.0))


def claims(units: DataFrame, supported: DataFrame, embed: Callable[[Column], Column] | None = text.mock_embedding) -> DataFrame:
    """One row for each cited unit: score, status, sources, study, stance.

    Without ``embed`` the score is the lexical overlap, with its own thresholds.
    """
    if embed is None:
        score, levels = lexical_overlap(F.col("unit"), F.col("chunk_text")), (LEXICAL_VERIFIED, LEXICAL_AMBIGUOUS)
    else:
        score, levels = (text.cosine(embed(F.col("unit")), embed(F.col("chunk_text"))) + 1) / 2, (VERIFIED, AMBIGUOUS)
    study = text.first_given(*(F.col(c) for c in ("workspace_id", "paper_id", "filename") if c in supported.columns))
    found = (
        supported.withColumns({"score": score, "study": study}).groupBy("claim_seq")
        .agg(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("score"))).alias("score"),
            F.transform(F.array_sort(F.collect_list(F.struct("support_seq", "chunk_id"))), lambda x: x["chunk_id"]).alias("supporting_chunk_ids"),
            F.min_by("study", F.when(F.col("study").isNotNull(), F.col("support_seq"))).alias("study_id"),
        )
    )
    cleaned = text.claim_text(F.col("unit"))
    return units.join(found, "claim_seq", "left").select(
        "claim_seq", cleaned.alias("claim_text"), "citation_tokens", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("entailment_score"),
        F.when(F.col("score").isNull(), "UNSUPPORTED").otherwise(status(F.col("score"), *levels)).alias("entailment_status"),
        F.coalesce("supporting_chunk_ids", F.array().cast("array<string>")).alias("supporting_chunk_ids"),
        F.coalesce("study_id", F.lit("UNKNOWN")).alias("study_id"), text.stance(cleaned).alias("stance"),
    )


def summary(found: DataFrame) -> DataFrame:
    """Claims, verified claims and their rate; 1 where there are no claims."""
    verified = F.count_if(F.col("entailment_status") == "VERIFIED")
    rate = F.round(F.coalesce(F.try_divide(verified, F.count("*")), F.lit(1.0)), 4)
    return found.agg(F.count("*").alias("claims_count"), verified.alias("verified_claims_count"), rate.alias("entailment_rate"))


def synthesize(retrieved: DataFrame, query: str, llm: Callable[[str], str] | None = None, embed=text.mock_embedding) -> tuple[str, DataFrame]:
    """Markdown and claims of ranked chunks; ``llm`` gets one prompt."""
    if retrieved.isEmpty():
        return NOTHING_FOUND, None
    spark = retrieved.sparkSession
    markdown = llm(prompt(retrieved, query).first()[0]) if llm else generated_bullets(retrieved, query).first()[0]
    units = cited_units(spark.createDataFrame([(markdown,)], "markdown string"))
    return markdown, claims(units, support(units, retrieved), embed)

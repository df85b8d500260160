"""Comparison matrices across studies."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

STUDY_KEYS = ("workspace_id", "paper_id", "doi", "filename")
ATTRIBUTES = {  # what stands where the first row of a study has none
    "title": "", "authors": "Unknown", "year": "", "paradigm": "Design Science / Empirical", "study_design": "Evaluation Benchmark",
    "dataset": "Standard Corpus", "sample_size": "N/A", "evaluation_metrics": "Accuracy / F1", "primary_results": "", "declared_limitations": "",
}
FALLBACK = "N/A"


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def study_key(df: DataFrame, *names: str) -> Column:
    return F.coalesce(text.first_given(*(_column(df, n) for n in names)), F.lit("DOC"))


def methodology_matrix(chunks: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Seven dimensions of each study: attributes of its first row, and results and
    limitations from the first chunk of the matching section where it has none."""
    first = F.struct(*(F.coalesce(_column(chunks, k), F.lit(d)).alias(k) for k, d in ATTRIBUTES.items()))
    teaser = F.concat(F.replace(F.substring("text", 1, 120), F.lit("\n"), F.lit(" ")), F.lit("..."))
    of = lambda category: F.min_by(F.when(F.col("section_category") == category, teaser), F.when(F.col("section_category") == category, F.col(seq)))
    per = chunks.groupBy(study_key(chunks, *STUDY_KEYS).alias("study_id")).agg(
        F.min_by(first, F.col(seq)).alias("a"), of("results_empirical").alias("results"), of("discussion_limitations").alias("limits"), F.min(seq).alias("first_seq")
    )
    a = lambda k: F.col(f"a.{k}")
    has = lambda c: text.given(c).isNotNull()
    joined = lambda x, y: F.concat(x, F.lit(" ("), y, F.lit(")"))
    return per.select(
        "study_id",
        F.when(has(a("year")), joined(a("authors"), a("year"))).otherwise(a("authors")).alias("authors_year"),
        F.when(has(a("paradigm")), joined(a("study_design"), a("paradigm"))).otherwise(a("study_design")).alias("epistemological_design"),
        F.when(a("sample_size") != "N/A", joined(a("dataset"), a("sample_size"))).otherwise(a("dataset")).alias("population_dataset_sample"),
        F.coalesce(text.given(a("title")), F.lit("Proposed System")).alias("key_intervention_model"),
        F.coalesce(text.given(a("primary_results")), text.given(F.col("results")), F.concat(F.lit("Evaluated via "), a("evaluation_metrics"))).alias("primary_metrics_results"),
        F.coalesce(text.given(a("declared_limitations")), text.given(F.col("limits")), F.lit("Domain bounded")).alias("declared_limitations"),
        "first_seq",
    )


def methodology_json(matrix: DataFrame) -> DataFrame:
    """One JSON text for each study, in the order of the matrix."""
    fields = [c for c in matrix.columns if c != "first_seq"]
    return matrix.select("first_seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json")).orderBy("first_seq")


def methodology_markdown(rows: list) -> str:
    head = ("Study ID", "Authors & Year", "Epistemological Design", "Population / Dataset / Sample", "Key Intervention / Model", "Primary Metrics & Results", "Declared Limitations")
    fields = ("authors_year", "epistemological_design", "population_dataset_sample", "key_intervention_model", "primary_metrics_results", "declared_limitations")
    lines = ["# Cross-Study Methodology Comparison Matrix", "", f"| {' | '.join(head)} |", f"| {' | '.join([':---'] * len(head))} |"]
    return "\n".join(lines + [f"| **{r['study_id']}** | " + " | ".join(r[f] for f in fields) + " |" for r in rows]) if rows else "No documents indexed."


def distinct_studies(chunks: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The first row of each study, labelled by the first identity given."""
    label = study_key(chunks, "study_id", *STUDY_KEYS)
    fields = F.struct(*(_column(chunks, k).alias(k) for k in ("title", "authors", "year", "study_id", "document_id", "workspace_id", "doi")))
    per = chunks.groupBy(label.alias("label")).agg(F.min_by(fields, F.col(seq)).alias("a"), F.min(seq).alias("first_seq"))
    blank = lambda k: F.coalesce(F.col(f"a.{k}"), F.lit(""))
    return per.select("label", *(blank(k).alias(k) for k in ("title", "authors", "year")), *(blank(k).alias(f"scope_{k}") for k in ("study_id", "document_id", "workspace_id", "doi")), "first_seq")


def scope(label: Column, study: Column, document: Column, workspace: Column, doi: Column) -> Column:
    """(field, value) that a study's chunks are found by: the stored study, else its
    document, DOI or workspace, else what its label looks like."""
    pair = lambda name, x: F.struct(F.lit(name).alias("field"), x.alias("value"))
    looks_like_doi = F.contains(label, F.lit("/")) | F.contains(label, F.lit("."))
    tried = F.coalesce(*(F.when(text.given(x).isNotNull(), pair(name, x)) for name, x in (("study_id", study), ("document_id", document), ("doi", doi), ("workspace_id", workspace))))
    return F.coalesce(tried, F.when(looks_like_doi, pair("doi", label)).otherwise(pair("workspace_id", label)))


def top_per_dimension(studies: DataFrame, chunks: DataFrame, dimensions: list[dict], embed=text.mock_vector, k: int = 3, tie: str = "chunk_id") -> DataFrame:
    """(label, dim_id, place, chunk columns): the k nearest chunks of each study for each dimension.

    One join of studies with their chunks replaces a search for each pair; the
    dimensions, a short list of the protocol, become rows of the chunk.
    """
    scoped = studies.withColumn("_scope", scope(F.col("label"), *(F.col(f"scope_{n}") for n in ("study_id", "document_id", "workspace_id", "doi"))))
    keys = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), _column(chunks, n).alias("value")) for n in ("study_id", "document_id", "doi", "workspace_id"))))
    own = chunks.withColumn("_key", keys).where("_key.value is not null")
    pairs = own.join(scoped.select("label", "_scope"), (F.col("_key.field") == F.col("_scope.field")) & (F.col("_key.value") == F.col("_scope.value")))
    asked = F.array(*(
        F.struct(
            F.lit(d["id"]).alias("dim_id"),
            F.lit(d.get("target_section_category") or None).cast("string").alias("category"),
            F.array(*map(F.lit, embed(f"{d['name']} {d.get('description', '')}"))).alias("vector"),
        )
        for d in dimensions
    ))
    fitting = F.filter(asked, lambda d: d["category"].isNull() | (d["category"] == F.col("section_category")))
    each = pairs.withColumn("_q", F.explode(fitting)).withColumn("_d", F.struct("_q.dim_id", (1 - text.cosine(F.col("embedding"), F.col("_q.vector"))).alias("distance"))).drop("_q", "embedding")
    near = Window.partitionBy("label", "_d.dim_id").orderBy("_d.distance", tie)
    ranked = each.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k)
    return ranked.select("label", F.col("_d.dim_id").alias("dim_id"), "place", tie, "text", *(["citation_token"] if "citation_token" in chunks.columns else []))


def with_citations(chunks: DataFrame) -> DataFrame:
    """Chunks with their ``citation_token`` where they have none."""
    if "citation_token" in chunks.columns:
        return chunks
    named = (_column(chunks, name) for name in ("workspace_id", "paper_id", "doi", "filename", "section", "chunk_id"))
    return chunks.withColumn("citation_token", text.citation_token(*named))


def first_sentence(column: Column) -> Column:
    return text.strip(F.substring_index(column, ".", 1))


def protocol_matrix(studies: DataFrame, ranked: DataFrame, dimensions: list[dict]) -> DataFrame:
    """One row for each study: for each dimension the first sentence of its best chunk
    and that chunk's citation token."""
    best = ranked.where("place = 1").withColumn("value", text.given(first_sentence(F.col("text"))))
    cells = []
    for d in dimensions:
        mine = F.col("dim_id") == d["id"]
        cells += [
            F.coalesce(F.max(F.when(mine, F.col("value"))), F.lit(d.get("fallback_value", FALLBACK))).alias(d["id"]),
            F.coalesce(F.max(F.when(mine, F.col("citation_token"))), F.lit("")).alias(f"{d['id']}_citation"),
        ]
    wide = studies.select("label", "title", "authors", "year").join(best, "label", "left").groupBy("label", "title", "authors", "year").agg(*cells)
    return wide.withColumnRenamed("label", "study_id")


def export(rows: list[dict], dimensions: list[dict], protocol_id: str, project: str) -> dict[str, str]:
    """The matrix as JSON, CSV and Markdown texts."""
    out = io.StringIO()
    if rows:
        writer = csv.DictWriter(out, list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
    head = ["Study ID", "Title", "Authors & Year", *(d["name"] for d in dimensions)]
    table = [head, [":---"] * len(head)]
    for r in rows:
        who = f"{r['authors']} ({r['year']})" if r["year"] else r["authors"]
        table.append([f"**{r['study_id']}**", str(r["title"])[:40], who, *(str(r[d["id"]])[:50] for d in dimensions)])
    body = "".join(f"| {' | '.join(cells)} |\n" for cells in table)
    return {"json": json.dumps(rows, indent=2, default=str), "csv": out.getvalue(), "md": f"# Synthesis Matrix: {project}\n**Protocol ID**: `{protocol_id}`\n\n{body}"}

"""The protocol's matrix over a store: cells from retrieval or a model, and its files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrices
from ..sources.store import Store
from . import events

#: A cell's question to a model; fixed wording.
QUESTION = "Extract the dimension '{name}' ({description}) from the text:\n{context}\nRespond with JSON: {{\"{id}\": <value>}}"
NAMES = {"json": "synthesis_matrix.json", "csv": "synthesis_matrix.csv", "md": "synthesis_matrix.md"}


def with_answers(ranked: DataFrame, dimensions: list[dict], llm: Callable[[str], dict]) -> DataFrame:
    """(label, dim_id, answer) of a model over the nearest chunks of each cell; null where it fails or says nothing."""
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n")
    cells = ranked.groupBy("label", "dim_id").agg(context.alias("context"))
    known = {d["id"]: d for d in dimensions}

    @F.arrow_udf("string")
    def ask(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, contexts in parts:
            out = []
            for key, body in zip(ids.to_pylist(), contexts.to_pylist()):
                try:
                    d = known[key]
                    value = llm(QUESTION.format(name=d["name"], description=d.get("description", ""), context=body, id=key)).get(key)
                    out.append(str(value) if value else None)
                except Exception:  # a model may fail in any way; the cell stays as it is
                    out.append(None)
            yield pa.array(out, pa.string())

    return cells.select("label", "dim_id", ask("dim_id", "context").alias("answer"))


def valid(value: str | None, dimension: dict, fallback: str = matrices.FALLBACK):
    """A cell by the kind of its dimension; a text that does not fit stays a text."""
    kind = dimension.get("type", "string")
    if value is None:
        return dimension.get("fallback_value", fallback)
    try:
        return {"integer": int, "int": int, "float": float, "number": float, "boolean": lambda x: {"true": True, "false": False}[x.lower()]}.get(kind, str)(value)
    except (KeyError, ValueError):
        return value


def extract_all(store: Store, protocol: dict, output: str | None = None, llm: Callable[[str], dict] | None = None, embed=None, journal: str | None = None) -> tuple[list[dict], dict[str, str]]:
    """(rows, paths) of the matrix over the live chunks, one row a study; files where ``output`` names a folder."""
    chunks, dimensions = store.live(), protocol["matrix_dimensions"]
    rows: list[dict] = []
    if chunks is not None:
        studies = matrices.distinct_studies(chunks)
        ranked = matrices.top_per_dimension(studies, matrices.with_citations(chunks), dimensions, **({"embed": embed} if embed else {}))
        table = matrices.protocol_matrix(studies, ranked, dimensions)
        if llm is not None:
            told = with_answers(ranked, dimensions, llm).groupBy("label").pivot("dim_id", [d["id"] for d in dimensions]).agg(F.first("answer"))
            told = told.select(F.col("label").alias("study_id"), *(F.col(d["id"]).alias(f"_told_{d['id']}") for d in dimensions))
            table = table.join(told, "study_id", "left").withColumns({d["id"]: F.coalesce(F.col(f"_told_{d['id']}"), F.col(d["id"])) for d in dimensions})
            table = table.drop(*(f"_told_{d['id']}" for d in dimensions))
        order = studies.select(F.col("label").alias("study_id"), "first_seq")
        for row in table.join(order, "study_id").orderBy("first_seq", "study_id").drop("first_seq").toLocalIterator():  # the files are for people: one row a study
            found = row.asDict()
            rows.append(found | {d["id"]: valid(found[d["id"]], d) for d in dimensions})
    paths = {}
    if output is not None:
        os.makedirs(output, exist_ok=True)
        for kind, body in matrices.export(rows, dimensions, protocol["protocol_id"], protocol["project_slug"]).items():
            paths[kind] = os.path.join(output, NAMES[kind])
            with open(paths[kind], "w", encoding="utf-8", newline="") as file:
                file.write(body)
    events.audit(journal, "MATRIX_EXTRACTED", {"study_count": len(rows)}, paths)
    return rows, paths

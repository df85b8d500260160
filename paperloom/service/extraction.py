"""Metadata of papers: by a language model where one is given, by patterns where it fails."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions import vocabulary as v

# What is asked of a model, the length of text it is shown, and the fields of an answer.
PROMPT = """Extract structured metadata from the following academic text.
Return a JSON object with these fields:
- title: Paper title
- authors: List of author objects with family_name, given_name, orcid, affiliation
- abstract: Paper abstract
- year: Publication year (integer)
- doi: DOI identifier
- venue: Publication venue
- keywords: List of keywords
- contributions: Key contributions
- limitations: Stated limitations
- future_work: Future work directions

Text:
{text}

Return ONLY valid JSON, no markdown fences."""
SHOWN = 8_000
_AUTHOR = T.StructType([T.StructField(name, T.StringType()) for name in ("family_name", "given_name", "orcid", "affiliation", "email")])
_LIST = T.ArrayType(T.StringType())
FIELDS = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(_AUTHOR)), T.StructField("abstract", T.StringType()), T.StructField("year", T.IntegerType()),
     T.StructField("doi", T.StringType()), T.StructField("venue", T.StringType())]
    + [T.StructField(name, _LIST) for name in ("keywords", "contributions", "limitations", "future_work")]
)


def without_fences(answer: Column) -> Column:
    """A model's answer without the fences around it."""
    return text.strip(F.regexp_replace(F.regexp_replace(answer, r"```json?\s*", ""), r"```\s*\z", ""))


def redacted(column: Column, kind: T.DataType) -> Column:
    """A nested value with every string in it redacted; field names and other values stay."""
    if isinstance(kind, T.StringType):
        return text.redacted(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, x: redacted(x, kind.valueType))
    if isinstance(kind, T.StructType):
        whole = F.struct(*(redacted(column[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.when(column.isNotNull(), whole)
    return column


def has_personal_data(column: Column, kind: T.DataType) -> Column:
    """Whether any string in a nested value is redacted."""
    if isinstance(kind, T.StringType):
        found = text.has_personal_data(column)
    elif isinstance(kind, T.ArrayType):
        found = F.exists(column, lambda x: has_personal_data(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        found = F.exists(F.map_values(column), lambda x: has_personal_data(x, kind.valueType))
    elif isinstance(kind, T.StructType):
        found = F.lit(False)
        for f in kind.fields:
            found = found | has_personal_data(column[f.name], f.dataType)
    else:
        found = F.lit(False)
    return F.coalesce(found, F.lit(False))


def redact_value(value):
    """(value, whether anything was redacted) of nested dicts and lists on the driver."""
    if isinstance(value, str):
        out = value
        for pattern, replacement in v.REDACTIONS:
            out = re.sub(pattern, replacement, out, flags=re.ASCII)
        return out, out != value
    if isinstance(value, dict):
        pairs = {k: redact_value(x) for k, x in value.items()}
        return {k: x for k, (x, _) in pairs.items()}, any(hit for _, hit in pairs.values())
    if isinstance(value, list):
        items = [redact_value(x) for x in value]
        return [x for x, _ in items], any(hit for _, hit in items)
    return value, False


def heuristic(body: Column) -> Column:
    """The fields by patterns; lists are empty."""
    found = text.heuristic_fields(body)
    empty = lambda kind: F.array().cast(kind)
    values = {name: found[name] for name in ("title", "abstract", "year", "doi")}
    columns = [values.get(f.name, empty(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None)).cast(f.dataType).alias(f.name) for f in FIELDS.fields]
    return F.struct(*columns)


def confidence(found: Column) -> Column:
    """The sum of the weights of all ten fields that have a value."""
    given = lambda f: F.when(F.size(found[f.name]) > 0, F.lit(1)) if isinstance(f.dataType, T.ArrayType) else F.nullif(found[f.name].cast("string"), F.lit(""))
    return text.confidence({f.name: given(f) for f in FIELDS.fields})


def _asked(llm: Callable[[str], str]):
    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            answers = []
            for body in part.to_pylist():
                try:
                    answers.append(None if body is None else str(llm(PROMPT.format(text=body[:SHOWN]))))
                except Exception:  # a model may fail in any way; patterns take over
                    answers.append(None)
            yield pa.array(answers, pa.string())

    return run


def extract(docs: DataFrame, llm: Callable[[str], str] | None = None, body: str = "text", source_file: str | None = None) -> DataFrame:
    """``docs`` with ``extraction``, ``confidence`` and ``pii_redacted``.

    An answer that is not a JSON object, or none, leaves the row to the patterns.
    """
    by_rule = heuristic(F.col(body))
    if llm is None:
        raw = by_rule
    else:
        answer = F.from_json(without_fences(_asked(llm)(F.col(body))), FIELDS)
        told = F.filter(F.array(*(answer[f.name].isNotNull() for f in FIELDS.fields)), lambda x: x)
        raw = F.when(F.size(told) > 0, answer).otherwise(by_rule)
    out = docs.withColumn("_raw", raw)
    out = out.withColumn("extraction", redacted(F.col("_raw"), FIELDS)).withColumn("pii_redacted", has_personal_data(F.col("_raw"), FIELDS))
    out = out.withColumn("confidence", confidence(F.col("extraction"))).drop("_raw")
    return out if source_file is None else out.withColumn("source_file", F.lit(source_file))


def as_json(found: DataFrame) -> DataFrame:
    """One JSON text for each row of ``extract``."""
    named = [c for c in ("extraction", "confidence", "source_file", "chunk_index", "pii_redacted") if c in found.columns]
    return found.select(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}).alias("json"))


def parse_answer(answer: str) -> dict:
    """The JSON of one answer on the driver."""
    return json.loads(re.sub(r"```\s*\Z", "", re.sub(r"```json?\s*", "", answer)).strip())

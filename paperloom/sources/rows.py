"""Nested chunk rows as flat store rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

_NESTED = {"section_hierarchy": " > ", "evaluation_metrics": ", "}


def to_store_row(chunks: DataFrame) -> DataFrame:
    """Arrays joined, structs spread out, and empty values null."""
    out = []
    for field in chunks.schema.fields:
        name = field.name
        if name == "methodology" and isinstance(field.dataType, T.StructType):
            out += [_flat(F.col(f"{name}.{f.name}"), f).alias(f.name) for f in field.dataType.fields]
        else:
            out.append(_flat(F.col(name), field).alias(name))
    return chunks.select(*out)


def _flat(column, field: T.StructField):
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
        return text.given(F.array_join(column, _NESTED.get(field.name, ", ")))
    return text.given(column) if isinstance(field.dataType, T.StringType) and field.name != "text" else column

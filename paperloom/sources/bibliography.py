"""BibTeX files, and joining documents to their entries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "citation_key string, doi string, title string, authors string, year string, paradigm string, study_design string, entry_no int"
_ENTRY = re.compile(r"@(\w+)\s*[{(]\s*([^,\s]*)\s*,")


def _value(source: str, at: int) -> tuple[str, int]:
    """A field value from ``at`` on, in braces, quotes or bare, and where it ends."""
    while at < len(source) and source[at].isspace():
        at += 1
    if at < len(source) and source[at] in '{"':
        close, depth, start = ("}" if source[at] == "{" else '"'), 0, at + 1
        for i in range(start, len(source)):
            if source[i] == close and depth == 0:
                return source[start:i], i + 1
            depth += (source[i] == "{") - (source[i] == "}")
        raise ValueError("a field value is not closed")
    end = at
    while end < len(source) and source[end] not in ",})\n":
        end += 1
    return source[at:end].strip(), end


def parse(source: str) -> list[dict[str, str]]:
    """Entries in order; stops at the first that cannot be read."""
    out = []
    for head in _ENTRY.finditer(source):
        if head[1].lower() in ("comment", "string", "preamble"):
            continue
        fields, at = {}, head.end()
        try:
            while (name := re.compile(r"[\s,]*([\w-]+)\s*=").match(source, at)) is not None:
                fields[name[1].lower()], at = _value(source, name.end())
        except ValueError:
            break
        doi = re.sub(r"https?://doi\.org/", "", fields.get("doi", "")).strip()
        out.append(
            {"citation_key": head[2], "doi": doi, "title": fields.get("title", "").strip("{}"), "authors": fields.get("author", ""), "year": fields.get("year", "")}
            | {"paradigm": fields.get("paradigm"), "study_design": fields.get("study_design"), "entry_no": len(out)}
        )
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a BibTeX file; one file is one author's list, read on the driver."""
    rows = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(parse(rows[0]) if rows else [], SCHEMA)


def keys(entries: DataFrame) -> DataFrame:
    """Three keys for each entry: citation key, DOI, and 25 letters of the title; of
    one key the last entry holds, at the place where the key first came."""
    slug = F.substring(F.regexp_replace(F.lower("title"), "[^a-z0-9]", ""), 1, 25)
    tried = F.array(F.lower("citation_key"), F.lower("doi"), F.when(F.col("title") != "", slug))
    each = entries.select("*", F.posexplode(tried).alias("_k", "key")).where(F.col("key").isNotNull() & ((F.col("key") != "") | (F.col("_k") == 2)))
    place = F.col("entry_no") * 3 + F.col("_k")
    per = Window.partitionBy("key")
    return each.withColumns({"_p": place, "key_order": F.min(place).over(per), "_last": F.max(place).over(per)}).where("_p = _last").drop("_k", "_p", "_last")


def join_documents(docs: DataFrame, keyed: DataFrame, stem: str = "stem") -> DataFrame:
    """Documents with the entry of their file name, or else of the first key that the
    name contains; ``matched`` says which.

    What an entry tells depends on the name alone, so the distinct names are matched and
    joined back: no other column of a document moves, equal rows stay as many as they are,
    and a null name matches nothing.  Only names without an exact entry reach the second
    join.  It compares each key of some length with the pieces of that length of a
    name, so it stays an equality join.
    """
    names = docs.select(F.lower(stem).alias("_name")).where("_name is not null").distinct()
    told = _matched(names, keyed)
    return docs.withColumn("_name", F.lower(stem)).join(told, "_name", "left").drop("_name")


def _matched(names: DataFrame, keyed: DataFrame) -> DataFrame:
    """Of distinct names (``_name``) those with an entry."""
    name = F.col("_name")
    exact = names.join(keyed, name == F.col("key"), "left")
    hit = exact.where("key is not null").withColumn("matched", F.lit("exact"))
    rest = exact.where("key is null").select("_name")
    lengths = [r[0] for r in keyed.select(F.length("key").alias("n")).distinct().collect()]  # of keys: a few dozen at most
    none_of = F.array().cast("array<string>")

    def pieces_of(n: int):
        starts = F.sequence(F.lit(1), F.length(name) - n + 1)
        return F.when(F.length(name) >= n, F.transform(starts, lambda i: F.substring(name, i, F.lit(n)))).otherwise(none_of)

    pieces = F.array_distinct(F.flatten(F.array(*map(pieces_of, lengths)))) if lengths else none_of
    found = rest.withColumn("_piece", F.explode(pieces)).join(keyed, F.col("_piece") == F.col("key")).drop("_piece")
    first = Window.partitionBy("_name").orderBy("key_order")
    within = found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("matched", F.lit("contains"))
    return hit.unionByName(within)

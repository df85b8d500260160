"""Checks over tables: sets, duplicates, parents, leaks, and the live rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a leak.
SECRET_KEYS = ("api_key", "apikey", "token", "secret", "password", "credential", "bearer", "private_key")
SECRET_VALUES = (
    r"\b(?:sk-[A-Za-z0-9]{8,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{12,})\b",
    r"(?i)\bbearer\s+\S+",
    r"(?i)os\.environ|getenv\s*\(|process\.env|\benv\(|\$ENV\{|\$\{ENV|ENV\[",
    r"^(?:[A-Za-z]:[\\/]|[\\/]{1,2})",
    r"(?<![A-Za-z0-9_])[A-Za-z]:[\\/]|(?<![\\\w])\\\\[A-Za-z0-9._-]+|(?:^|(?<=[\s'\"(\[]))/(?:[\w.-]{2,}/)+",
    r"(?:^|[\\/])\.\.(?:$|[\\/])",
)


def leaks(key: Column, value: Column) -> Column:
    """Whether a key looks like a secret's, or a value like a secret or a path of the machine."""
    found = F.lit(False)
    for stem in SECRET_KEYS:
        found = found | F.contains(F.lower(key), F.lit(stem))
    for pattern in SECRET_VALUES:
        found = found | value.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def secrets(value: Column) -> Column:
    """Whether a text holds a key, a bearer token or a look into the environment."""
    found = F.lit(False)
    for pattern in SECRET_VALUES[:3]:
        found = found | value.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def pairs(value, path: str = "", key: str = "") -> list[tuple[str, str, str]]:
    """(path, key, value) of every key of a nested document; values that are no strings count as blank."""
    if isinstance(value, dict):
        return [found for k, x in value.items() for found in ([(f"{path}.{k}" if path else k, k, "")] + pairs(x, f"{path}.{k}" if path else k, k))]
    if isinstance(value, (list, tuple)):
        return [found for i, x in enumerate(value) for found in pairs(x, f"{path}[{i}]", key)]
    return [(path, key, value)] if isinstance(value, str) else []


def leaves(value, path: str = "") -> list[tuple[str, str]]:
    """(path, value) of every string of a nested document."""
    return [(at, found) for at, _, found in pairs(value, path) if found]


def leaks_plainly(key: str, value: str) -> bool:
    """``leaks`` for one key and value on the driver."""
    return any(stem in key.lower() for stem in SECRET_KEYS) or any(re.search(pattern, value) for pattern in SECRET_VALUES)


def compare_sets(declared: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """(key, state) with state missing, unexpected or both."""
    d, l = declared.select(key, F.lit(True).alias("_d")), live.select(key, F.lit(True).alias("_l"))  # noqa: E741
    state = F.when(F.col("_l").isNull(), "missing").when(F.col("_d").isNull(), "unexpected").otherwise("both")
    return d.join(l, key, "full_outer").select(key, state.alias("state"))


def duplicates(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *more).where("n > 1")


def code_list(codes: Column) -> Column:
    """Aggregate: the codes that occur, once each, in order."""
    return F.array_sort(F.collect_set(codes))


def dimensions(vectors: Column) -> Column:
    """Aggregate: the lengths of vectors that occur, in order."""
    return F.array_sort(F.collect_set(F.size(vectors)))


def merged_ids(*groups: Column) -> Column:
    """All ids of some arrays, once each, in order."""
    return F.array_sort(F.array_distinct(F.concat(*groups)))


def is_subset(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def scope(accepted: DataFrame, candidate: DataFrame, key: str = "document_id") -> DataFrame:
    """The documents that a replacement may remove rows of: those of either side."""
    return accepted.select(key).union(candidate.select(key)).distinct()


def lost(declared: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Declared rows that a stored generation lacks; none if it is complete."""
    return declared.join(stored.select(key), key, "left_anti")


def owners(chunks: DataFrame, documents: DataFrame, key: str = "document_id", study: str = "study_id") -> DataFrame:
    """``chunks`` with ``state``: owned, of another study than its document, or without one."""
    theirs = documents.select(key, F.col(study).alias("_study"), F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "no owner").when(~F.col(study).eqNullSafe(F.col("_study")), "other study").otherwise("owned")
    return chunks.join(theirs, key, "left").withColumn("state", state).drop("_study", "_known")


def counts_agree(counts: Column, arrays: Column) -> Column:
    """Whether a stated count is the length of what it counts."""
    return counts.eqNullSafe(F.size(arrays).cast("bigint"))


def against_parent(mine: DataFrame, parent: DataFrame, compared: list[str], key: str = "document_id") -> DataFrame:
    """``mine`` with ``outcome``: refused without a parent record, differs, or eligible."""
    theirs = parent.select(key, *(F.col(c).alias(f"_p_{c}") for c in compared), F.lit(True).alias("_known"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    outcome = F.when(F.col("_known").isNull(), "refused").when(~same, "differs").otherwise("eligible")
    return mine.join(theirs, key, "left").withColumn("outcome", outcome).select(*mine.columns, "outcome")


@dataclass(frozen=True)
class Verification:
    """What the live rows show against what was declared; no codes if all is well."""

    missing: int
    unexpected: int
    differing: int
    wrong_dimension: int
    space: str
    codes: tuple[str, ...] = field(default=())

    @property
    def matches(self) -> bool:
        return not self.codes


def verify(declared: DataFrame, live: DataFrame, dimension: int, declared_space: str = "cosine", observed_space: str | None = None) -> Verification:
    """Five axes: identities, count, attributes, vector dimension, distance space.

    One full join by chunk id serves all row axes; duplicated ids are refused.
    """
    from .codes import Refusal

    for name, rows in (("declared", declared), ("live", live)):
        if not duplicates(rows, ["chunk_id"]).isEmpty():
            raise Refusal("CHUNK_IDENTITY_COLLISION", f"{name} chunk ids are not unique", "chunk_id")
    attributes = [c for c in ("document_id", "study_id", "chunk_text_sha256") if c in declared.columns and c in live.columns]
    size = F.size("embedding") if "embedding" in live.columns else F.lit(dimension)
    mine = declared.select("chunk_id", *(F.col(c).alias(f"_d_{c}") for c in attributes), F.lit(True).alias("_d"))
    theirs = live.select("chunk_id", *attributes, F.coalesce(size, F.lit(-1)).alias("_size"), F.lit(True).alias("_l"))
    differs = F.lit(False)
    for c in attributes:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    both = F.col("_d").isNotNull() & F.col("_l").isNotNull()
    row = mine.join(theirs, "chunk_id", "full_outer").agg(
        F.count_if(F.col("_l").isNull()).alias("missing"),
        F.count_if(F.col("_d").isNull()).alias("unexpected"),
        F.count_if(both & differs).alias("differing"),
        F.count_if(F.col("_l").isNotNull() & (F.col("_size") != dimension)).alias("wrong_dimension"),
    ).first()
    space = "NOT_OBSERVED" if observed_space is None else "NOT_RECORDED" if observed_space == "" else "MATCH" if observed_space == declared_space else "MISMATCH"
    codes = set()
    if row["missing"] or row["unexpected"] or row["differing"]:
        codes.add("BACKEND_STATE_INCONSISTENT")
    if row["wrong_dimension"] or space == "MISMATCH":
        codes.add("EMBEDDING_IDENTITY_CHANGED")
    if space == "NOT_RECORDED":
        codes.add("CONFIGURATION_INEFFECTIVE")
    return Verification(row["missing"], row["unexpected"], row["differing"], row["wrong_dimension"], space, tuple(sorted(codes)))

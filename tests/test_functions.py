"""Scalar functions and canonical identities against known values."""

from __future__ import annotations

import pytest
from paperloom.functions import canonical, text
from pyspark.sql import functions as F

BASE = {
    "parent_artifact_id": "ART-11111111111111111111111111111111", "parent_artifact_sha256": "sha256:" + "1a" * 32,
    "study_id": "STU-44444444444444444444444444444444", "document_id": "DOC-33333333333333333333333333333333", "extracted_content_sha256": "sha256:" + "5b" * 32,
}


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_canonical_bytes():
    assert canonical.canonical_bytes({"b": 1.0, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'.encode()
    assert canonical.canonical_bytes(-0.0) == b"0"
    assert canonical.canonical_bytes({"x": [3, 1, 2]}, ("/x",)) == b'{"x":[1,2,3]}'
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            canonical.canonical_bytes({"x": bad})
    with pytest.raises(TypeError):
        canonical.canonical_bytes({1: 2})


def test_default_chunker_fingerprint():
    from paperloom.operators.chunking import Chunker

    assert Chunker().fingerprint == "sha256:df987253699f5dd93e8821d81eaf48f873323a1f7efee4baf6f37cb3ddc40846"


def test_identifiers():
    assert canonical.validate_identifier("study", "SCI-1") == "SCI-1"
    assert canonical.deterministic_id("study", "w", {"a": 1}).startswith("STU-")
    for bad in ("STU-", "stu-1", "DOC-1", "STU- x"):
        with pytest.raises(ValueError):
            canonical.validate_identifier("study", bad)


@pytest.mark.parametrize(
    "heading,category",
    [("1. Introduction", "abstract_intro"), ("II. Methodology", "methodology"), ("3.2 Dataset", "methodology"), ("4 - Results", "results_empirical"), ("Discussion of results", "results_empirical"), ("Threats to Validity", "discussion_limitations"), ("Appendix", "other")],
)
def test_section_category(spark, heading, category):
    assert one(spark, text.section_category(F.col("h")), h=heading) == category


def test_citation_token(spark):
    token = text.citation_token(F.lit(""), F.lit(None).cast("string"), F.lit("10.1/x"), F.lit("f.md"), F.lit("Results & More!"), F.lit("CHK-1"))
    assert one(spark, token) == "[10.1/x#resultsmor#CHK-1]"


def test_redaction(spark):
    said = "Mail a.b@c.org, https://orcid.org/0000-0001-2345-678X or call 555-123-4567; NSF ABC-D."
    out = one(spark, text.redacted(F.col("t")), t=said)
    assert "[EMAIL REDACTED]" in out and "[ORCID REDACTED]" in out and "[PHONE REDACTED]" in out and "[GRANT REDACTED]" in out
    assert one(spark, text.has_personal_data(F.col("t")), t=said) and not one(spark, text.has_personal_data(F.col("t")), t="plain words")


@pytest.mark.parametrize("said,stance", [("it improves the gain", "POSITIVE"), ("it fails without data", "NEGATIVE"), ("nothing said", "NEUTRAL"), ("better but worse", "NEGATIVE")])
def test_stance(spark, said, stance):
    assert one(spark, text.stance(F.col("t")), t=said) == stance


def test_mock_embedding_matches_the_driver_formula(spark):
    for said in ("", "abc", "été 😀"):
        assert one(spark, text.mock_embedding(F.col("t")), t=said) == pytest.approx(text.mock_vector(said), abs=1e-12)


def test_snippet(spark):
    assert one(spark, text.snippet(F.col("t")), t="**Bold** claim [a#b#c]\nmore") == "Bold claim"
    long = "word " * 60
    assert one(spark, text.snippet(F.col("t")), t=long).endswith("…")


def test_confidence(spark):
    fields = {"title": F.lit("t"), "doi": F.lit(None), "year": F.lit(2020), "abstract": F.lit("x")}
    assert one(spark, text.confidence(fields)) == pytest.approx(0.40)

"""Chunking, retrieval, graphs, consensus, stores and integrity on small fixtures."""

from __future__ import annotations

import random

import pytest
from paperloom.integrity import recovery, verify
from paperloom.operators import chunking, consensus, pagerank, retrieval
from paperloom.sources import bibliography
from paperloom.sources.store import Store
from pyspark.sql import functions as F


def merged_by_restarts(chunker, chunks):
    """Small chunks merged by starting over after each merge."""
    chunks, moved = list(chunks), True
    while moved and len(chunks) > 1:
        moved = False
        for i in range(1, len(chunks)):
            if len(chunks[i]) >= chunker.min_chunk_chars:
                continue
            for a in (i - 1, i):
                if a + 1 < len(chunks) and len(chunks[a]) + len(chunks[a + 1]) + 2 <= chunker.max_chunk_chars:
                    chunks[a : a + 2] = [chunks[a] + "\n\n" + chunks[a + 1]]
                    moved = True
                    break
            if moved:
                break
    return chunks


def test_merge_pass_equals_restarts():
    rng, chunker = random.Random(5), chunking.Chunker(max_chunk_chars=30, min_chunk_chars=10)
    for _ in range(2000):
        chunks = ["x" * rng.randint(1, 30) for _ in range(rng.randint(0, 8))]
        assert chunker._merge_small(list(chunks)) == merged_by_restarts(chunker, chunks)


def test_sections_and_breadcrumbs(spark):
    md = "lead\n# A\ntext a\n## B\n\n# C\n### D\ntext d\n#### no\n"
    rows = chunking.sections(spark.createDataFrame([(1, md)], "id int, text string")).orderBy("section_no").collect()
    assert [(r["section"], r["section_hierarchy"]) for r in rows] == [("Abstract/Intro", ["Abstract/Intro"]), ("A", ["A"]), ("D", ["C", "D"])]
    assert rows[-1]["section_body"] == "text d\n#### no"


def test_chunks_respect_the_limit(spark):
    body = "# A\n" + "\n\n".join(f"Sentence number {i} of it. Another one here." for i in range(80))
    found = chunking.chunks(spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, text string"), chunking.Chunker(max_chunk_chars=300))
    assert found.count() > 5 and found.agg(F.max("character_count")).first()[0] <= 302


def test_missing_identity_is_refused(spark):
    found = chunking.chunks(spark.createDataFrame([(1, "# A\nx")], "id int, text string"))
    with pytest.raises(chunking.ChunkerError) as refused:
        chunking.with_identity(found)
    assert refused.value.code == "IDENTITY_MISSING"


def test_frontmatter():
    assert chunking.frontmatter("---\nDOI: 10.1/x\nauthors: [a, b]\n---\nbody") == ({"doi": "10.1/x", "authors": ["a", "b"]}, "\nbody")
    assert chunking.frontmatter("no block") == ({}, "no block")


def test_pagerank_of_a_cycle_and_a_sink(spark):
    ranks = {r["node"]: r["rank"] for r in pagerank.pagerank(spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "src string, dst string")).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-6) and ranks["a"] > ranks["c"]


def test_search_reranks_within_the_overfetch(spark):
    rows = spark.createDataFrame([(f"c{i}", [1.0, i / 10.0], f"d{i}") for i in range(40)], "chunk_id string, embedding array<double>, doi string")
    found = [r["chunk_id"] for r in retrieval.search(rows, [1.0, 0.0], 2, seeds=["D7", "d30"]).collect()]
    assert found[0] == "c7" and "c30" not in found


def test_where_compiles_nested_filters(spark):
    rows = spark.range(10).withColumn("section", F.when(F.col("id") < 5, "a").otherwise("b"))
    assert retrieval.where(rows, {"$or": [{"id": {"$lt": 2}}, {"id": 7}]}, section="a").count() == 2
    with pytest.raises(ValueError):
        retrieval.where(rows, {"id": {"$near": 1}})


@pytest.mark.parametrize(
    "stances,verdict,score",
    [("PPPP", "HIGH_CONSENSUS", 1.0), ("PPN", "ACTIVE_DEBATE", 0.667), ("P", "PROVISIONAL", 1.0), ("PUU", "UNRESOLVED", 0.333)],
)
def test_verdicts(spark, stances, verdict, score):
    names = {"P": "POSITIVE", "N": "NEGATIVE", "U": "NEUTRAL"}
    rows = [("q", i, f"claim {i}", f"s{i}", names[s], 0.5) for i, s in enumerate(stances)]
    got = consensus.verdicts(spark.createDataFrame(rows, "rq_id string, claim_seq long, claim_text string, study_id string, stance string, entailment_score double"), "rq_id").first()
    assert (got["verdict"], got["consensus_score"]) == (verdict, score)


def test_clusters_follow_the_first_leader(spark):
    said = ["alpha beta gamma", "alpha beta delta", "omega psi", "alpha beta gamma delta"]
    rows = spark.createDataFrame([("q", i, t, "s") for i, t in enumerate(said)], "rq_id string, claim_seq long, claim_text string, study_id string")
    found = {r["claim_seq"]: r["cluster_no"] for r in consensus.clusters(consensus.prepared(rows)).collect()}
    assert found == {0: 1, 1: 1, 2: 2, 3: 1}


def test_store_upsert_switch_and_delete(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c")
    row = lambda *x: spark.createDataFrame([*x], "chunk_id string, text string, ingest_seq long")
    assert store.count() == 0
    store.upsert(row(("a", "1", 1), ("b", "1", 2), ("a", "2", 3)))
    store.upsert(row(("b", "3", 4)))
    assert {(r["chunk_id"], r["text"]) for r in store.live().collect()} == {("a", "2"), ("b", "3")}
    store.stage(row(("z", "0", 9)), "RUN-x")
    assert store.count() == 2  # not visible before the switch
    store.delete(row(("a", "", 0)))
    assert [r["chunk_id"] for r in store.live().collect()] == ["b"]
    assert store.remove_obsolete() == 3 and store.count() == 1


def test_bibliography(spark):
    source = "@article{Chen20, author = {A and B}, title={{Great {Work}}}, doi = {https://doi.org/10.1/X}, year = 2020}\n@book{k2, title=\"Other\"}"
    entries = bibliography.parse(source)
    assert entries[0]["doi"] == "10.1/X" and entries[1]["title"] == "Other"
    keyed = bibliography.keys(spark.createDataFrame(entries, bibliography.SCHEMA))
    docs = spark.createDataFrame([("CHEN20",), ("my_chen20_final",), ("none",)], "stem string")
    assert {r["stem"]: r["matched"] for r in bibliography.join_documents(docs, keyed).collect()} == {"CHEN20": "exact", "my_chen20_final": "contains", "none": None}


def test_recovery_ladder():
    facts = dict.fromkeys(recovery.FACTS, False)
    assert recovery.classify(facts) == "NO_INTENT"
    assert recovery.classify(facts | {"has_intent": True}) == "UNREADABLE_STATE"
    assert recovery.classify(facts | {"has_intent": True, "candidate_stored": True}) == "R5_TO_CHECK_7"
    assert recovery.action("PRE_R5") == ("ROLLED_BACK", "ATOMIC_COMMIT_FAILED", "discard staged")


def test_verification_axes(spark):
    rows = lambda *x: spark.createDataFrame([*x], "chunk_id string, document_id string, embedding array<double>")
    declared = rows(("a", "d", None), ("b", "d", None))
    assert verify.verify(declared, rows(("a", "d", [1.0]), ("b", "d", [1.0])), 1).matches
    bad = verify.verify(declared, rows(("a", "x", [1.0]), ("c", "d", [1.0, 2.0])), 1, observed_space="l2")
    assert (bad.missing, bad.unexpected, bad.differing, bad.wrong_dimension) == (1, 1, 1, 1)
    assert bad.codes == ("BACKEND_STATE_INCONSISTENT", "EMBEDDING_IDENTITY_CHANGED")


def test_manifest_seals_and_replacement(spark, tmp_path):
    from paperloom.functions.canonical import text_fingerprint
    from paperloom.integrity import manifest, replacement
    from paperloom.integrity.codes import Refusal

    chunk = {"chunk_id": "CHK-" + "0" * 32, "document_id": "DOC-1", "study_id": "STU-1", "locator": {"heading_path": ["A"], "ordinal_in_section": 1, "section_category": "other"}, "chunk_text_sha256": text_fingerprint("t"), "character_count": 1}
    empty = dict.fromkeys(manifest.FIELDS)
    payload = empty | {
        "workspace_id": "WSP-1", "run_id": "RUN-1", "created_at": "2026-01-01T00:00:00Z", "status": "SUCCESS", "failures": [], "rejected_documents": [], "visible_chunks": [chunk],
        "documents": [{"document_id": "DOC-1", "study_id": "STU-1", "chunk_ids": [chunk["chunk_id"]]}], "counts": {"visible_chunks": 1}, "parent_artifact_ref": {"artifact_id": "ART-1"},
        "chunker": {"configuration": {"max_chunk_chars": 1200}}, "embedder": {"provider": "mock", "dimension": 2}, "backend": {"kind": "parquet"}, "producer": {"package": "p", "version": "1", "commit": "0" * 40},
    }
    sealed = manifest.validate(manifest.sealed(payload))
    assert sealed["manifest_id"].startswith("IDX-")
    with pytest.raises(Refusal):
        manifest.validate(sealed | {"status": "FAILED"})
    with pytest.raises(Refusal):
        manifest.validate(sealed | {"corpus_fingerprint": "x"})
    store = Store(spark, f"file://{tmp_path}/c")
    rows = spark.createDataFrame([(chunk["chunk_id"], "DOC-1", "STU-1", chunk["chunk_text_sha256"], [1.0, 0.0])], "chunk_id string, document_id string, study_id string, chunk_text_sha256 string, embedding array<double>")
    assert replacement.replace(store, sealed, rows, dimension=2, folder=str(tmp_path)) == "REPLACED"
    assert replacement.replace(store, sealed, rows, dimension=2, folder=str(tmp_path), accepted=sealed) == "REUSED"
    assert store.live_generation == "RUN-1" and replacement.finalize(str(tmp_path), "RUN-1", publication_confirmed=True)
    with replacement.Lock(f"{tmp_path}/.index.lock"), pytest.raises(Refusal) as refused:
        replacement.replace(store, sealed, rows, dimension=2, folder=str(tmp_path))
    assert refused.value.code == "CONFLICT"


def test_journal_counts(spark):
    from paperloom.streaming.journal import counts_by_action

    rows = spark.createDataFrame([("a", "2026-01-01 01:00:00"), ("a", "2026-01-01 02:00:00"), ("b", "2026-01-02 00:00:00")], "action string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["action"], r["n"]) for r in counts_by_action(rows).collect()) == [("a", 2), ("b", 1)]

"""From folders to the index and back: requests, paths, journals, extraction, one run, recovery."""

from __future__ import annotations

import json
import os

import pytest
from paperloom import cli
from paperloom.functions.canonical import chunk_id, text_fingerprint
from paperloom.integrity import manifest, recovery, replacement
from paperloom.integrity.codes import Refusal
from paperloom.operators import chunking, matrices
from paperloom.service import embedders, events, extraction, indexing, paths, requests, searching, workspace
from paperloom.service import matrices as matrix_files
from paperloom.sources import backends, bibliography, files
from paperloom.sources.store import Store
from paperloom.streaming.journal import upsert_stream
from pyspark.sql import functions as F

IDENTITY = {
    "workspace_id": "WSP-1", "study_id": "STU-1", "document_id": "DOC-1", "parent_artifact_id": "ART-1", "parent_artifact_sha256": "sha256:" + "0" * 64,
    "extracted_content_sha256": "sha256:" + "1" * 64, "backend_provider": "mock", "collection": "papers",
}
PAPER = "---\ntitle: On Tests\nauthors: [Ann, Bob]\nyear: 2021\ndataset: D\n---\n# Methodology\nWe measure with care. It works.\n## Results\nAccuracy rises by ten points. More follows.\n"


def test_requests_are_whole_or_refused(tmp_path):
    request = requests.IndexRequest(**IDENTITY)
    assert request.limbs()["study_id"] == "STU-1" and request.report("m")["backend_model"] == "m"
    with pytest.raises(requests.IdentityMissing) as refused:
        requests.IndexRequest(**IDENTITY | {"study_id": " "})
    assert refused.value.missing == ["study_id"]
    with pytest.raises(requests.IdentityMissing):
        requests.resolve("folder", None, None, "WSP-1")
    for field, value, code in (("collection", "x", "COLLECTION_MISMATCH"), ("backend_provider", "x", "BACKEND_IDENTITY_MISMATCH"), ("backend_model", "x", "BACKEND_IDENTITY_MISMATCH")):
        with pytest.raises(Refusal) as refused:
            requests.check_binding(requests.IndexRequest(**IDENTITY | {field: value}), collection="papers", provider="mock", model=None)
        assert refused.value.code == code
    for body in (None, "[1]", "{"):
        path = tmp_path / "m.json"
        path.write_text(body) if body else None
        with pytest.raises(Refusal) as refused:
            requests.read_workspace_manifest(path)
        assert refused.value.code == "WORKSPACE_MANIFEST_UNREADABLE"


@pytest.mark.parametrize(("reference", "fault"), [("a/b.md", None), (".", None), ("/x", "absolute"), ("C:x", "absolute"), ("a/../b", "upwards"), ("..\\b", "upwards"), ("a//b", "redundant"), ("./a", "redundant"), ("", "blank")])
def test_references(spark, reference, fault):
    assert spark.createDataFrame([(reference,)], "r string").select(paths.reference_fault(F.col("r"))).first()[0] == fault
    if fault is None:
        assert paths.check_reference(reference, "x") == reference
    else:
        with pytest.raises(Refusal):
            paths.check_reference(reference, "x")


def test_places_in_a_workspace(tmp_path):
    root = paths.workspace_root(tmp_path)
    with pytest.raises(Refusal) as refused:
        paths.journal_destination(root, None)
    assert refused.value.code == "DEPENDENCY_ERROR"
    with pytest.raises(Refusal):
        paths.journal_destination(root, "audit/journal.jsonl")
    os.symlink("/tmp", tmp_path / "out")
    with pytest.raises(Refusal) as refused:
        paths.within(root, "out/x", "f")
    assert refused.value.code == "PATH_OUTSIDE_WORKSPACE"
    docs = tmp_path / "docs"
    docs.mkdir()
    assert paths.bibliography_of(str(docs)) is None
    (tmp_path / "literature").mkdir()
    (tmp_path / "literature" / "references.bib").write_text("")
    assert paths.bibliography_of(str(docs)).endswith("literature/references.bib")
    (tmp_path / "project.json").write_text("{}")
    assert paths.audit_journal(str(docs)) == str(tmp_path / "audit" / "journal.jsonl")
    for run, body in (("RUN-1", {"manifest_id": "a"}), ("RUN-2", {"manifest_id": "b"})):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "x.json").write_text(json.dumps(body))
        (tmp_path / "runs" / run / "intent-x.json").write_text("{}")
    assert paths.newest_sidecar(str(tmp_path / "runs"))["manifest_id"] == "b" and paths.newest_sidecar(str(tmp_path / "none")) is None


def test_journals(tmp_path):
    journal = tmp_path / "j.jsonl"
    assert events.audit(str(journal), "RAG_QUERY_RETRIEVED", {"query": "q"}, {}) and not events.audit(str(tmp_path / "no" / "j"), "RAG_INDEX_BUILT", {}, {})
    with pytest.raises(Refusal) as refused:
        events.append_report(str(tmp_path / "no" / "j"), {})
    assert refused.value.code == "DEPENDENCY_ERROR"
    parent = {"workspace_id": "WSP-1", "artifact_id": "ART-1", "sha256": "s"}
    make = lambda: events.run_event(parent, "RUN-1", "SUCCESS", complete=True, counts={}, rejected=[], embedder={"provider": "mock"}, configuration={})
    assert make() == make() and make()["action"] == "RAG_INDEX_RUN_BUILT"
    events.append_report(str(journal), make())
    assert json.loads(journal.read_text().splitlines()[1])["event_id"].startswith("AUD-")
    assert [events.run_status(*x) for x in ((1, 0), (1, 1), (0, 1))] == ["SUCCESS", "PARTIAL", "FAILED"]


def test_embedders(spark):
    with pytest.raises(ValueError):
        embedders.embedder("other")
    with pytest.raises(ValueError):
        embedders.embedder("openai")
    calls = embedders.embedder("gemini", api_key="k", client=lambda texts: [[float(len(t)), 1.0] for t in texts])
    got = spark.createDataFrame([("ab",), (None,)], "t string").select(calls.column(F.col("t")).alias("v")).collect()
    assert got[0]["v"] == [2.0, 1.0] and got[1]["v"] is None and calls.dimension == 768 and calls.model == "text-embedding-004"
    mock = embedders.embedder("test")
    assert spark.createDataFrame([("ab",)], "t string").select(mock.column(F.col("t")).alias("v")).first()["v"] == mock.one("ab")
    assert embedders.claim_scorer(mock.one, lambda a, b: 0.5)("x", "x") == pytest.approx(1.0)
    assert embedders.claim_scorer(lambda t: 1 / 0, lambda a, b: 0.5)("x", "x") == 0.5


def test_folder_to_store_to_answer(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "chen20.md").write_text(PAPER)
    (docs / "other.md").write_text("# Limitations\nOnly a few cases were seen.\n")
    (docs / "references.bib").write_text("@article{chen20, title={From the entry}, doi={10.1/X}, year=2020}")
    (tmp_path / "project.json").write_text("{}")
    indexer = indexing.Indexer(spark, f"file://{tmp_path}/index", "papers", embedders.embedder("mock"))
    found = indexer.index_directory(str(docs), requests.IndexRequest(**IDENTITY))
    assert (found["indexed_files"], found["total_chunks"], found["collection_count"]) == (2, 3, 3)
    again = indexer.index_directory(str(docs), manifest=IDENTITY)
    assert again["collection_count"] == 3 and again["identity"]["study_id"] == "STU-1"
    rows = {r["section"]: r for r in indexer.store.live().collect()}
    assert rows["Results"]["title"] == "From the entry" and rows["Results"]["doi"] == "10.1/X" and rows["Results"]["dataset"] == "D"
    assert len((tmp_path / "audit" / "journal.jsonl").read_text().splitlines()) == 2
    best = searching.query(indexer.store, indexer.embedder, rows["Results"]["text"], 2, seeds=["10.1/x"], graph={"10.1/X": 1.0}, journal=str(tmp_path / "audit" / "journal.jsonl"))
    top = best.orderBy(F.desc("hybrid_score")).first()
    assert top["chunk_id"] == rows["Results"]["chunk_id"] and top["hybrid_score"] == 1.4 and top["citation_token"].startswith("[")
    assert searching.ranked_table(best).count() == 2
    empty = Store(spark, f"file://{tmp_path}/none")
    assert searching.query(empty, indexer.embedder, "q").count() == 0
    with pytest.raises(requests.IdentityMissing):
        indexer.index_directory(str(docs), workspace_id="WSP-1")

    protocol = {"protocol_id": "P", "project_slug": "s", "matrix_dimensions": [{"id": "out", "name": "Outcome", "description": "", "target_section_category": "results_empirical"}]}
    made, written = matrix_files.extract_all(indexer.store, protocol, str(tmp_path / "literature"))
    assert made[0]["out"] == "Accuracy rises by ten points" and open(written["md"]).read().splitlines()[-1].startswith("| **STU-1** |")
    told, _ = matrix_files.extract_all(indexer.store, protocol, llm=lambda prompt: {"out": 42})
    assert told[0]["out"] == "42"
    silent, _ = matrix_files.extract_all(indexer.store, protocol, llm=lambda prompt: 1 / 0)
    assert silent == made


def test_chunk_ids_are_the_canonical_ones(spark):
    limbs = {k: IDENTITY[k] for k in ("workspace_id", "study_id", "document_id", "parent_artifact_id", "parent_artifact_sha256", "extracted_content_sha256")}
    odd = ["# A \"quoted\" \\ back\nbody", "# tab\there \x0b and \x1f \\u000B\nbody\x01", "# é 日本 \u2028 /\nx", "plain"]
    rows = spark.createDataFrame([(*limbs.values(), t) for t in odd], ", ".join(f"{k} string" for k in (*limbs, "text")))
    chunker = chunking.Chunker()
    for r in chunking.with_identity(chunking.chunks(rows, chunker), chunker).collect():
        want = chunk_id(r["workspace_id"], limbs, chunking.ALGORITHM, chunker.fingerprint, r["section_hierarchy"], r["paragraph_idx"], r["section_category"], r["chunk_text_sha256"])
        assert r["chunk_id"] == want, r["section_hierarchy"]
    with pytest.raises(Exception, match="IDENTITY_MISSING"):
        chunking.with_identity(chunking.chunks(rows.withColumn("study_id", F.lit(" ")), chunker), chunker).collect()


def test_extraction(spark):
    text = "# The Title\nabstract\nWe write to a.b@c.org in 2019. See 10.1234/abc.\n# Next"
    docs = spark.createDataFrame([(text,), (None,)], "text string")
    plain = extraction.extract(docs).collect()
    assert plain[0]["extraction"]["title"] == "The Title" and "[EMAIL REDACTED]" in plain[0]["extraction"]["abstract"] and plain[0]["pii_redacted"]
    assert plain[0]["confidence"] == 0.5 and plain[1]["confidence"] == 0.0
    llm = extraction.extract(docs, lambda prompt: '```json\n{"title": "Told", "keywords": ["x"], "authors": [{"family_name": "a@b.org"}]}\n```').collect()[0]
    assert llm["extraction"]["title"] == "Told" and llm["extraction"]["authors"][0]["family_name"] == "[EMAIL REDACTED]" and llm["confidence"] == 0.35
    for bad in (lambda prompt: "no json", lambda prompt: 1 / 0):
        assert extraction.extract(docs, bad).first()["extraction"]["title"] == "The Title"
    assert json.loads(extraction.as_json(extraction.extract(docs, source_file="f.md")).first()[0])["source_file"] == "f.md"
    assert extraction.redact_value({"a": ["x@y.org", {"b": 1}]}) == ({"a": ["[EMAIL REDACTED]", {"b": 1}]}, True)
    assert extraction.parse_answer('```json\n{"a": 1}\n```') == {"a": 1}


def test_methodology_and_metadata(spark):
    rows = spark.createDataFrame([("a", "empirical", "F1"), ("b", None, None)], "doc_id string, paradigm string, evaluation_metrics string")
    got = {r["doc_id"]: r["methodology"] for r in chunking.with_methodology(rows).collect()}
    assert got["a"]["evaluation_metrics"] == ["F1"] and got["b"] is None
    listed = rows.withColumn("evaluation_metrics", F.array(F.lit("x"), F.lit("y")))
    assert chunking.with_methodology(listed).where("doc_id = 'a'").first()["methodology"]["evaluation_metrics"] == ["x", "y"]


def workspace_at(tmp_path, bodies, claimed=None):
    docs = tmp_path / "docs"
    docs.mkdir()
    records = []
    for i, body in enumerate(bodies):
        (docs / f"d{i}.md").write_text(body)
        records.append({"document_id": f"DOC-{i}", "study_id": f"STU-{i}", "extracted_path": f"d{i}.md", "extracted_content_sha256": (claimed or {}).get(i) or text_fingerprint(body), "extraction_method": "m"})
    parent = {"artifact_id": "ART-1", "artifact_type": "DOCUMENTS", "sha256": "0" * 64, "workspace_id": "WSP-1", "corpus_fingerprint": "c", "protocol_fingerprint": "p", "documents": records}
    return workspace.WorkspaceRequest("RUN-1", "2026-01-01T00:00:00Z", parent, "docs", "runs.jsonl", "papers")


def test_a_run_over_a_workspace(spark, tmp_path):
    request = workspace_at(tmp_path, ["# Results\nIt works.", "# Methods\nWe did.", " \n"], {1: "sha256:" + "f" * 64})
    got = workspace.index_workspace(spark, request, str(tmp_path), embedders.embedder("mock"))
    assert (got.outcome, got.exit_code, got.complete, got.journaled, got.disposition) == ("PARTIAL", 2, True, True, "REPLACED"), got
    assert {(r["document_id"], r["code"]) for r in got.rejected} == {("DOC-1", workspace.CHANGED), ("DOC-2", workspace.UNUSABLE)}
    sealed = json.loads((tmp_path / got.sidecar_path).read_text())
    assert manifest.validate(sealed)["status"] == "PARTIAL" and len(manifest.rederived_ids(sealed)) == 1
    event = json.loads((tmp_path / "runs.jsonl").read_text())
    assert event["manifest_id"] == got.manifest_id and len(event["rejected_documents"]) == 2
    assert not os.path.exists(tmp_path / ".index" / "RUN-1" / "intent-RUN-1.json")
    again = workspace.index_workspace(spark, request, str(tmp_path), embedders.embedder("mock"), accepted=sealed)
    assert again.disposition == "REUSED" and again.manifest_id == got.manifest_id
    with pytest.raises(Refusal):
        manifest.check_parent_agreement(sealed, request.parent_view | {"sha256": "1"})
    with pytest.raises(Refusal):
        manifest.check_parent_agreement(sealed, request.parent_view | {"documents": []})
    moved = json.loads(json.dumps(sealed))
    moved["visible_chunks"][0]["locator"]["ordinal_in_section"] = 2
    with pytest.raises(Refusal) as refused:
        manifest.rederived_ids(moved)
    assert refused.value.code == "CHUNK_IDENTITY_COLLISION"


def test_refused_runs(spark, tmp_path):
    request = workspace_at(tmp_path, [" \n"])
    mock = embedders.embedder("mock")
    assert workspace.index_workspace(spark, request, str(tmp_path), mock).outcome == "FAILED"
    from dataclasses import replace as but

    assert workspace.index_workspace(spark, but(request, journal_path=None), str(tmp_path), mock).code == "DEPENDENCY_ERROR"
    assert workspace.index_workspace(spark, but(request, docs_path="../x"), str(tmp_path), mock).outcome == "REFUSED"
    lost = but(request, parent_view=request.parent_view | {"documents": [request.parent_view["documents"][0] | {"extracted_path": "no.md"}]})
    assert workspace.index_workspace(spark, lost, str(tmp_path), mock).code == "NOT_FOUND"
    with pytest.raises(Refusal):
        workspace.Result("SUCCESS", False, False)


def test_recovery_acts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c")
    rows = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    store.stage(rows, "RUN-0")
    store.switch("RUN-0")

    def intent(run, **more):
        body = {"run_id": run, "previous_generation": "RUN-0", "candidate_manifest_id": f"IDX-{run}", "parent_artifact_ref": {"artifact_id": "A"}, "chunk_ids": ["a", "b"]} | more
        replacement.write_json(f"{tmp_path}/intent-{run}.json", body | {"seal": recovery.canonical_fingerprint(body)})

    assert recovery.recover(store, str(tmp_path), "RUN-9").state == "PROCEED"
    store.stage(rows, "RUN-1")
    store.stage(rows, "RUN-other")
    intent("RUN-1")
    with replacement.Lock(f"{tmp_path}/.index.lock"):
        assert recovery.recover(store, str(tmp_path), "RUN-1").code == "CONFLICT"
    got = recovery.recover(store, str(tmp_path), "RUN-1", event_durable=True)
    assert (got.row, got.state, got.intent_removed) == ("PRE_R5", "ROLLED_BACK", True) and store.generations() == ["RUN-0", "RUN-other"]
    store.stage(rows, "RUN-2")
    store.switch("RUN-2")
    intent("RUN-2")
    got = recovery.recover(store, str(tmp_path), "RUN-2", event_durable=True)
    assert (got.row, got.state) == ("R5_TO_R6", "ROLLED_FORWARD") and "RUN-0" not in store.generations()
    store.stage(rows.limit(1), "RUN-3")
    store.switch("RUN-3")
    intent("RUN-3", previous_generation="RUN-2")
    got = recovery.recover(store, str(tmp_path), "RUN-3")
    assert (got.row, got.state, got.intent_removed) == ("R5_TO_CHECK_7", "ROLLED_BACK", False) and store.live_generation == "RUN-2"


def test_legacy_stores(spark, tmp_path):
    old = spark.createDataFrame([("chk-1", "x"), ("chk-2", "y")], "chunk_id string, filename string")
    plan = recovery.migration_plan(old, {})
    assert plan["legacy"] and plan["documents"] == 2 and "ordinal_id" in plan["signals"]
    with pytest.raises(Refusal):
        recovery.refuse_authoritative_use(old, {})
    store = Store(spark, f"file://{tmp_path}/c")
    new = spark.createDataFrame([("CHK-" + "0" * 32, "ART-1")], "chunk_id string, parent_artifact_id string")
    assert recovery.commit_migration(plan, lambda: new, store, "RUN-1") == 1
    with pytest.raises(Refusal):
        recovery.commit_migration(plan, lambda: old, store, "RUN-2")
    old.write.parquet(f"{tmp_path}/old/rows")
    (tmp_path / "old" / "metadata.json").write_text('{"embedder": "e"}')
    reader = backends.ParquetLegacyReader(spark, f"file://{tmp_path}/old")
    assert isinstance(reader, backends.LegacyStoreReader) and reader.rows().count() == 2 and reader.metadata() == {"embedder": "e"}
    assert isinstance(store, backends.ReplacementBackend) and isinstance(store, backends.VerifiableBackend) and isinstance(backends.StoreBackend(store), backends.VectorBackend)


def test_documents_keep_their_number_in_the_bibliography_join(spark):
    keyed = spark.createDataFrame([("chen", 1), ("che", 2)], "key string, key_order int")
    docs = spark.createDataFrame([("chen", None), ("chen", None), ("x_chen", "n"), ("x_chen", None), (None, "n")], "stem string, note string")
    got = bibliography.join_documents(docs, keyed)
    assert got.count() == 5 and got.where("matched = 'exact'").count() == 2 and got.where("matched = 'contains' and key = 'chen'").count() == 2


def test_streams_with_new_checkpoints_are_not_dropped(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c")
    for name, value in (("one", "a"), ("two", "b")):
        source = f"{tmp_path}/{name}"
        spark.createDataFrame([(value, 1)], "chunk_id string, ingest_seq long").write.parquet(source)
        stream = spark.readStream.schema("chunk_id string, ingest_seq long").parquet(source)
        for _ in range(2):  # the second start finds nothing new
            upsert_stream(stream, store, f"{tmp_path}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["chunk_id"] for r in store.live().collect()) == ["a", "b"] and len(store.metadata()["streams"]) == 2


def test_graphs_exports_and_times(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}, {"id": "alone"}], "links": [{"source": "a", "target": "b"}]}')
    edges, ranks, nodes = files.citation_graph(spark, f"{tmp_path}/g.json")
    assert edges.count() == 1 and ranks is None and {r["node"] for r in nodes.collect()} == {"a", "b", "alone"}
    assert searching.ranks_of(Store(spark, f"file://{tmp_path}/c"), f"{tmp_path}/g.json").count() == 3
    (tmp_path / "bad.json").write_text("{")
    for name in ("none.json", "bad.json"):
        assert files.citation_graph(spark, f"{tmp_path}/{name}")[2].isEmpty()
    out = matrices.export([{"study_id": "s", "title": "t", "authors": "a", "year": "1", "d": "v"}], [{"id": "d", "name": "D"}], "P", "slug")
    assert out["md"].endswith("| **s** | t | a (1) | v |\n")
    assert manifest.is_utc_time("2026-01-01T00:00:00Z") and not manifest.is_utc_time("2026-99-99T99:99:99Z") and not manifest.is_utc_time("2026-01-01")


def test_leaks_are_refused(spark):
    with pytest.raises(Refusal):
        manifest.check_leaks({"embedder": {"api_key": "x"}})
    with pytest.raises(Refusal):
        manifest.check_leaks({"documents": [{"extracted_path": "/home/x/y"}]})
    manifest.check_leaks({"a": ["plain", 1, None]})


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text(PAPER)
    (tmp_path / "m.json").write_text(json.dumps(IDENTITY))
    code, said = cli.run(spark, ["index", "docs", "--manifest", "m.json", "--json"])
    assert code == 0 and json.loads(said)["total_chunks"] == 2
    for form in cli.RENDER:
        code, said = cli.run(spark, ["query", "accuracy", "--format", form, "--output", f"out/{form}"])
        assert code == 0 and "Accuracy" in said and os.path.exists(f"out/{form}")
    assert cli.run(spark, ["stats"]) == (0, "Chunks: 2")
    code, said = cli.run(spark, ["synthesize", "accuracy", "--output", "out/s.md"])
    assert code == 0 and json.load(open("out/s.claims.json"))
    code, said = cli.run(spark, ["matrix", "--output", "lit"])
    assert code == 0 and "WSP-1" in said and json.load(open("lit/methodology_matrix.json"))[0]["study_id"]
    (tmp_path / "ledger.jsonl").write_text("\n".join(json.dumps({"rq_id": "q", "claim_text": f"alpha beta gamma {i}", "study_id": f"s{i}"}) for i in range(3)))
    code, said = cli.run(spark, ["consensus", "ledger.jsonl", "--output", "out/c.md"])
    assert code == 0 and json.load(open("out/c.json"))["input_claims"] == 3
    code, said = cli.run(spark, ["extract", "docs/a.md", "--output", "out/e.json"])
    assert code == 0 and json.load(open("out/e.json"))["source_file"] == "a.md"
    assert cli.run(spark, ["index", "docs"])[0] == 3 and cli.run(spark, ["index", "nowhere", "--manifest", "m.json"])[0] == 1

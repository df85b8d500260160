"""One run over a workspace: bind, chunk, seal, replace, report; refusals are results, not exceptions."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.canonical import LIMBS, canonical_fingerprint
from ..integrity import manifest as manifests
from ..integrity import recovery, replacement
from ..integrity.codes import MANIFEST_CODES, OUTCOME_EXIT, Refusal
from ..operators import chunking
from ..sources import files
from ..sources.store import Store
from . import events, paths
from .embedders import Embedder

CHANGED, UNUSABLE = "EXTRACTED_CONTENT_CHANGED", "EXTRACTED_TEXT_UNUSABLE"
DETAILS = {
    CHANGED: "the text no longer has the fingerprint that the accepted parent binds, so it is refused until it is asked for again",
    UNUSABLE: "no chunk could be cut from the text, so the document is refused and not counted as accepted",
}
RECORD = "document_id string, study_id string, extracted_path string, extracted_content_sha256 string, extraction_method string"


@dataclass(frozen=True)
class WorkspaceRequest:
    """What a run is asked for; the parent is the accepted artifact that binds every identity."""

    run_id: str
    created_at: str
    parent_view: dict
    docs_path: str
    journal_path: str | None
    collection: str
    chunker_configuration: dict = field(default_factory=dict)
    dimension: int = 384
    producer: dict = field(default_factory=lambda: {"package": "paperloom", "version": "1", "commit": "0" * 40})


@dataclass(frozen=True)
class Result:
    outcome: str
    complete: bool
    journaled: bool
    code: str | None = None
    message: str | None = None
    manifest_id: str | None = None
    sidecar_path: str | None = None
    rejected: tuple[dict, ...] = ()
    counts: dict = field(default_factory=dict)
    disposition: str | None = None

    def __post_init__(self):
        if self.outcome not in OUTCOME_EXIT:
            raise Refusal("VALIDATION_ERROR", "unknown outcome", "outcome")
        if self.complete != (self.outcome in ("SUCCESS", "PARTIAL")) or (self.complete and not self.journaled):
            raise Refusal("VALIDATION_ERROR", "a run is complete if it is published and reported", "complete")
        if (self.code is None) != self.complete:
            raise Refusal("VALIDATION_ERROR", "a run has a code if it did not complete", "code")
        if self.outcome == "PARTIAL" and not self.rejected or self.outcome == "SUCCESS" and self.rejected:
            raise Refusal("VALIDATION_ERROR", "the outcome hides or invents refused documents", "rejected")
        if self.sidecar_path is not None:
            paths.check_returned(self.sidecar_path, "sidecar_path")

    @property
    def exit_code(self) -> int:
        return OUTCOME_EXIT[self.outcome]

    def envelope(self) -> dict:
        return {"outcome": self.outcome, "exit_code": self.exit_code, "code": self.code, "message": self.message, "manifest_id": self.manifest_id, "counts": self.counts, "rejected": list(self.rejected)}


def judged(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``documents`` (document_id, text, extracted_content_sha256, ...) with the ``code`` that refuses each, or null."""
    usable = chunks.select("document_id").distinct().withColumn("_usable", F.lit(True))
    changed = ~text.fingerprint(F.coalesce(F.col("text"), F.lit(""))).eqNullSafe(F.col("extracted_content_sha256"))
    code = F.when(changed, CHANGED).when(F.col("_usable").isNull(), UNUSABLE)
    return documents.join(usable, "document_id", "left").withColumn("code", code).drop("_usable")


def candidate(documents: DataFrame, chunker: chunking.Chunker) -> tuple[DataFrame, DataFrame]:
    """(documents with ``code``, chunk rows with identity and ordinal of those accepted)."""
    unchanged = documents.where(text.fingerprint(F.coalesce(F.col("text"), F.lit(""))).eqNullSafe(F.col("extracted_content_sha256")))
    body = chunking.with_frontmatter(unchanged) if chunker.strip_frontmatter else unchanged
    cut = chunking.ordinals(chunking.chunks(body, chunker).drop("frontmatter"))
    found = chunking.with_identity(cut.withColumn("paragraph_idx", F.col("ordinal_in_section")), chunker)
    return judged(documents, found), found


def build_manifest(request: WorkspaceRequest, ruled: DataFrame, found: DataFrame, embedder: Embedder, chunker: chunking.Chunker) -> dict:
    """The sealed manifest.  It is one document that lists every visible chunk by contract, so its rows come to
    the driver, a few fields each; texts and vectors stay where they are."""
    parent = request.parent_view
    per = found.groupBy("document_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    accepted, rejected = [], []
    for row in ruled.drop("text").join(per, "document_id", "left").orderBy("document_id").toLocalIterator():
        base = {k: row[k] for k in ("document_id", "study_id", "extracted_path")}
        if row["code"]:
            rejected.append(base | {"code": row["code"], "detail": DETAILS[row["code"]]})
        else:
            accepted.append(base | {"chunk_ids": row["chunk_ids"], "detail": None, "extracted_content_sha256": row["extracted_content_sha256"], "extraction_method": row["extraction_method"], "status": "INDEXED"})
    columns = ("chunk_id", "chunk_text_sha256", "character_count", "document_id", "study_id", "section_hierarchy", "ordinal_in_section", "section_category")
    visible = [
        {k: row[k] for k in ("character_count", "chunk_id", "chunk_text_sha256", "document_id", "study_id")}
        | {"locator": {"heading_path": list(row["section_hierarchy"]), "ordinal_in_section": row["ordinal_in_section"], "section_category": row["section_category"]}}
        for row in found.select(*columns).orderBy("chunk_id").toLocalIterator()
    ]
    payload = dict.fromkeys(manifests.FIELDS) | {
        "backend": {"kind": "parquet", "collection": request.collection}, "chunk_identity_algorithm_version": "rag-chunk-identity-v1",
        "chunker": {"algorithm_version": chunking.ALGORITHM, "configuration": chunker.configuration}, "corpus_fingerprint": parent.get("corpus_fingerprint"),
        "counts": {"accepted_documents": len(accepted), "rejected_documents": len(rejected), "visible_chunks": len(visible)}, "created_at": request.created_at, "documents": accepted,
        "embedder": {"provider": embedder.provider, "model": embedder.model, "dimension": request.dimension, "distance": "cosine"}, "failures": [],
        "manifest_identity_algorithm_version": "rag-index-manifest-v1", "manifest_type": "RAG_INDEX", "producer": request.producer,
        "parent_artifact_ref": {"artifact_id": str(parent["artifact_id"]), "artifact_type": parent.get("artifact_type"), "sha256": str(parent["sha256"])},
        "protocol_fingerprint": parent.get("protocol_fingerprint"), "rejected_documents": rejected, "run_id": request.run_id, "schema_version": "1",
        "status": events.run_status(len(accepted), len(rejected)), "visible_chunks": visible, "workspace_id": str(parent["workspace_id"]),
    }
    return manifests.sealed(payload)


def _documents(spark: SparkSession, request: WorkspaceRequest, root: str) -> DataFrame:
    """The parent's records with their identity and the text at their path."""
    parent = request.parent_view
    for name in ("artifact_id", "sha256", "workspace_id", "documents"):
        if not parent.get(name):
            raise Refusal("MISSING_PARENT_ARTIFACT", "the parent does not state it", name)
    folder = paths.documents_folder(root, request.docs_path)
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    for record in parent["documents"]:
        paths.within(folder, str(record["extracted_path"]), "extracted_path")
    records = spark.createDataFrame([tuple(None if record.get(n) is None else str(record[n]) for n in names) for record in parent["documents"]], RECORD)
    found = files.markdown_directory(spark, f"file://{folder}").select(F.col("filename").alias("extracted_path"), "text")
    bound, absent = files.bound_documents(found.withColumnRenamed("extracted_path", "path"), records)
    if (lost := absent.select("document_id").head()) is not None:
        raise Refusal("NOT_FOUND", f"no file for {lost[0]}", "extracted_path")
    fixed = {"workspace_id": str(parent["workspace_id"]), "parent_artifact_id": str(parent["artifact_id"]), "parent_artifact_sha256": str(parent["sha256"])}
    return bound.withColumns({name: F.lit(value) for name, value in fixed.items() if name in (*LIMBS, "workspace_id")})


def index_workspace(spark: SparkSession, request: WorkspaceRequest, root: str, embedder: Embedder, accepted: dict | None = None) -> Result:
    """Run once; a refusal or failure is told by the result and leaves the old index in place."""
    rejected: tuple[dict, ...] = ()
    try:
        root = paths.workspace_root(root)
        journal = paths.journal_destination(root, request.journal_path)
        if accepted is not None:
            manifests.validate(accepted)
        chunker = chunking.Chunker.from_configuration(request.chunker_configuration)
        ruled, found = candidate(_documents(spark, request, root), chunker)
        sealed = build_manifest(request, ruled, found, embedder, chunker)
        manifests.validate(sealed)
        manifests.check_parent_agreement(sealed, request.parent_view)
        rejected = tuple(sealed["rejected_documents"])
        run_folder = os.path.join(root, ".index", request.run_id)
        os.makedirs(run_folder, exist_ok=True)
        store = Store(spark, f"file://{root}/.index/{request.collection}")
        if not sealed["documents"]:
            code = rejected[0]["code"] if rejected else "VALIDATION_ERROR"
            event = events.run_event(request.parent_view, request.run_id, "FAILED", complete=False, counts=sealed["counts"], rejected=list(rejected), embedder=sealed["embedder"], configuration=chunker.configuration, manifest=sealed)
            events.append_report(journal, event)
            return Result("FAILED", False, True, code, "no document was accepted", rejected=rejected, counts=sealed["counts"])
        rows = found.withColumn("embedding", embedder.column(F.col("text")))
        disposition = replacement.replace(store, sealed, rows, dimension=request.dimension, folder=run_folder, accepted=accepted)
    except (Refusal, chunking.ChunkerError) as error:
        failed = error.code in ("DEPENDENCY_ERROR", "BACKEND_STATE_INCONSISTENT", "ATOMIC_COMMIT_FAILED", "INTERNAL_ERROR")
        return Result("FAILED" if failed else "REFUSED", False, False, error.code if error.code in MANIFEST_CODES else "VALIDATION_ERROR", str(error), rejected=rejected)
    outcome = "PARTIAL" if rejected else "SUCCESS"
    sidecar = os.path.join(".index", request.run_id, f"{sealed['manifest_id']}.json")
    if not os.path.exists(os.path.join(root, sidecar)):
        replacement.write_json(os.path.join(root, sidecar), sealed)
    try:
        event = events.run_event(request.parent_view, request.run_id, outcome, complete=True, counts=sealed["counts"], rejected=list(rejected), embedder=sealed["embedder"], configuration=chunker.configuration, manifest=sealed, sidecar=sidecar)
        events.append_report(journal, event)
    except Refusal as error:  # the intent stays for the recovery that owns it
        return Result("FAILED", False, False, error.code, str(error), rejected=rejected, counts=sealed["counts"])
    replacement.finalize(run_folder, request.run_id, publication_confirmed=True)
    return Result(outcome, True, True, None, None, sealed["manifest_id"], sidecar, rejected, sealed["counts"], disposition)


def recover(spark: SparkSession, root: str, collection: str, run_id: str, *, accepted: dict | None = None, accepted_parent: dict | None = None, event_durable: bool = False) -> recovery.Decision:
    """Finish or undo what a crashed run left in a workspace."""
    root = paths.workspace_root(root)
    folder = os.path.join(root, ".index", run_id)
    return recovery.recover(Store(spark, f"file://{root}/.index/{collection}"), folder, run_id, accepted=accepted, accepted_parent=accepted_parent, event_durable=event_durable)


def store_open_result(store: Store, declared: DataFrame, dimension: int) -> dict:
    """Whether a store holds what a manifest declares, as a small report."""
    from ..integrity.verify import verify

    live = store.live()
    if live is None:
        return {"open": False, "codes": ["NOT_FOUND"]}
    found = verify(declared, live, dimension, observed_space=store.metadata().get("hnsw_space"))
    return {"open": found.matches, "codes": list(found.codes), "fingerprint": canonical_fingerprint(json.loads(json.dumps(store.metadata(), sort_keys=True)))}

"""Journals: an audit trail that never stops a query, and run reports that must reach the disk."""

from __future__ import annotations

import datetime
import json
import os
import threading
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.canonical import canonical_bytes, canonical_fingerprint, deterministic_id
from ..integrity.codes import Refusal

# Names in the journals.
AUDIT_ACTIONS = ("RAG_INDEX_BUILT", "RAG_QUERY_RETRIEVED", "SYNTHESIS_GENERATED", "MATRIX_EXTRACTED")
RUN_ACTIONS = {True: "RAG_INDEX_RUN_BUILT", False: "RAG_INDEX_RUN_REJECTED"}
AGENT, EVENT_TYPE, EVENT_VERSION = "paperloom", "index_run_report", "rag-index-run-report-v1"
SEALED = ("chunk_set_fingerprint", "configuration_fingerprint", "corpus_fingerprint", "index_fingerprint", "production_fingerprint", "protocol_fingerprint")
_append = threading.Lock()


def audit(journal: str | None, action: str, given: dict, result: dict) -> bool:
    """Append an event; whether it was written.  What goes wrong is swallowed: a query is worth more than its trace."""
    if action not in AUDIT_ACTIONS:
        raise ValueError(f"unknown action: {action}")
    if journal is None:
        return False
    event = {
        "event_id": f"evt-rag-{time.time_ns() // 1_000_000}", "timestamp": datetime.datetime.now(datetime.UTC).isoformat(), "action": action,
        "agent": AGENT, "input": given, "output": result,
    }
    try:
        with open(journal, "a", encoding="utf-8") as file:
            file.write(json.dumps(event, default=str) + "\n")
    except OSError:
        return False
    return True


def append_report(journal: str, event: dict) -> None:
    """Append one canonical line; returns when it is on the disk, or refuses."""
    try:
        with _append, open(journal, "ab") as file:
            file.write(canonical_bytes(event) + b"\n")
            file.flush()
            os.fsync(file.fileno())
    except OSError as error:
        raise Refusal("DEPENDENCY_ERROR", f"the report could not be written ({type(error).__name__})", "journal_path") from error


def run_event(parent: dict, run_id: str, outcome: str, *, complete: bool, counts: dict, rejected: list[dict], embedder: dict, configuration: dict, manifest: dict | None = None, sidecar: str | None = None) -> dict:
    """The report of a run: deterministic, sealed over itself, without paths of the machine or times."""
    if manifest is not None and manifest["rejected_documents"] and not rejected:
        raise Refusal("VALIDATION_ERROR", "a refused document is not reported", "rejected_documents")
    body = {
        "action": RUN_ACTIONS[complete], "artifact_checksum": None, "configuration": configuration, "counts": counts,
        "embedding_identity": {k: embedder.get(k) for k in ("dimension", "distance_metric", "model", "provider")}, "emitter": AGENT,
        "event_id": deterministic_id("audit_event", str(parent["workspace_id"]), {"mode": "INDEX", "outcome": outcome, "run_id": run_id}, EVENT_VERSION),
        "event_type": EVENT_TYPE, "manifest_id": (manifest or {}).get("manifest_id"), "manifest_path": sidecar,
        "parent_artifact_id": str(parent["artifact_id"]), "parent_artifact_sha256": str(parent["sha256"]),
        "rejected_documents": [{"code": r["code"], "document_id": r["document_id"]} for r in rejected], "run_id": run_id, "workspace_id": str(parent["workspace_id"]),
    }
    body |= {name: (manifest or {}).get(name) for name in SEALED}
    return body | {"artifact_checksum": canonical_fingerprint(body)}


def run_status(accepted: int, rejected: int) -> str:
    return "FAILED" if not accepted else "PARTIAL" if rejected else "SUCCESS"


def run_status_column(accepted: Column, rejected: Column) -> Column:
    """The same over counts of many runs."""
    return F.when(F.coalesce(accepted, F.lit(0)) == 0, "FAILED").when(F.coalesce(rejected, F.lit(0)) > 0, "PARTIAL").otherwise("SUCCESS")

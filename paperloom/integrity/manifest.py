"""Self-verifying index manifest: fingerprints, seals and validation.

The scalar parts of a manifest are one small document and are checked on the
driver; ``verify`` checks its row sets as tables.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re

from ..functions.canonical import canonical_bytes, canonical_fingerprint, chunk_id, validate_identifier
from .codes import MANIFEST_CODES, STATUSES, Refusal
from .verify import leaks_plainly, pairs

# The fields of a manifest.
FIELDS = (
    "artifact_checksum", "backend", "chunk_identity_algorithm_version", "chunk_set_fingerprint", "chunker", "configuration_fingerprint",
    "corpus_fingerprint", "counts", "created_at", "documents", "embedder", "failures", "index_fingerprint", "manifest_id",
    "manifest_identity_algorithm_version", "manifest_type", "parent_artifact_ref", "parent_lineage_sha256", "producer",
    "production_fingerprint", "protocol_fingerprint", "rejected_documents", "run_id", "schema_version", "status", "visible_chunks", "workspace_id",
)
MOST_DETAIL = 500
_SELF = "configuration_fingerprint"
_TIME = re.compile(r"(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:[Zz]|[+-]00:00)")


def is_utc_time(value) -> bool:
    """Whether a value is an RFC 3339 time in UTC that there is."""
    found = _TIME.fullmatch(value) if isinstance(value, str) else None
    if found is None:
        return False
    try:
        datetime.datetime.fromisoformat(f"{found[1]}T{found[2]}")
    except ValueError:
        return False
    return True


def _without(value: dict, *keys: str) -> dict:
    return {k: x for k, x in value.items() if k not in keys}


def chunk_set_fingerprint(chunks: list[dict]) -> str:
    return canonical_fingerprint({"visible_chunks": chunks}, ("/visible_chunks",))


def _index_payload(payload: dict) -> dict:
    return _without(payload, "run_id", "created_at", "production_fingerprint") | dict.fromkeys(("artifact_checksum", "index_fingerprint", "manifest_id"))


def sealed(payload: dict) -> dict:
    """A copy with all fingerprints computed, each over those before it."""
    out = json.loads(json.dumps(payload))
    out["parent_lineage_sha256"] = canonical_fingerprint(out["parent_artifact_ref"])
    out["chunker"][_SELF] = canonical_fingerprint(out["chunker"]["configuration"])
    for part in ("embedder", "backend"):
        out[part][_SELF] = canonical_fingerprint(_without(out[part], _SELF))
    out[_SELF] = canonical_fingerprint({k: out[k] for k in ("backend", "chunker", "embedder")})
    out["chunk_set_fingerprint"] = chunk_set_fingerprint(out["visible_chunks"])
    base = _index_payload(out)
    out["index_fingerprint"] = canonical_fingerprint(base)
    out["manifest_id"] = "IDX-" + hashlib.sha256(canonical_bytes(base | {"index_fingerprint": out["index_fingerprint"]})).hexdigest()[:32]
    producer = {k: out["producer"][k] for k in ("package", "version", "commit")}
    out["production_fingerprint"] = canonical_fingerprint({"producer": producer, "index_fingerprint": out["index_fingerprint"]})
    out["artifact_checksum"] = canonical_fingerprint(out | {"artifact_checksum": None})
    return out


def projection(payload: dict) -> dict:
    """What two runs over the same input agree on."""
    return _without(payload, "run_id", "created_at", "artifact_checksum")


def _need(holds: bool, code: str, message: str, field: str) -> None:
    if not holds:
        raise Refusal(code, message, field)


def validate(payload: dict) -> dict:
    """The payload, if it keeps every rule; otherwise a refusal that names code and field."""
    for name in FIELDS:
        _need(name in payload, "VALIDATION_ERROR", "a field is missing", name)
    for name in payload:
        _need(name in FIELDS, "VALIDATION_ERROR", "a field is unknown", name)
    for kind, name in (("workspace", "workspace_id"), ("run", "run_id")):
        try:
            validate_identifier(kind, payload[name])
        except (TypeError, ValueError) as error:
            raise Refusal("VALIDATION_ERROR", str(error), name) from error
    _need(is_utc_time(payload["created_at"]), "VALIDATION_ERROR", "not a UTC time", "created_at")
    documents, rejected, chunks, failures = (payload[k] for k in ("documents", "rejected_documents", "visible_chunks", "failures"))
    counts = {"accepted_documents": len(documents), "rejected_documents": len(rejected), "visible_chunks": len(chunks)}
    for name, n in counts.items():
        _need(payload["counts"].get(name, n) == n, "VALIDATION_ERROR", f"says {payload['counts'].get(name)}, there are {n}", f"counts.{name}")
    status = payload["status"]
    _need(status in STATUSES, "VALIDATION_ERROR", "unknown status", "status")
    fits = {
        "SUCCESS": documents and not rejected and not failures, "PARTIAL": documents and (rejected or failures), "FAILED": not documents,
    }.get(status, not (documents and not rejected and not failures))
    _need(bool(fits), "VALIDATION_ERROR", "does not fit what was accepted and rejected", "status")
    for rows, key, where in ((documents, "document_id", "documents"), (rejected, "document_id", "rejected_documents"), (chunks, "chunk_id", "visible_chunks")):
        ids = [r[key] for r in rows]
        _need(ids == sorted(ids), "VALIDATION_ERROR", "is not sorted", where)
        _need(len(ids) == len(set(ids)), "CHUNK_IDENTITY_COLLISION" if key == "chunk_id" else "VALIDATION_ERROR", "an id occurs twice", where)
    places = [(c["document_id"], tuple(c["locator"]["heading_path"]), c["locator"]["ordinal_in_section"]) for c in chunks]
    _need(len(places) == len(set(places)), "LOCATOR_NOT_UNIQUE", "two chunks have one place", "visible_chunks")
    owners = {d["document_id"]: d for d in documents}
    for c in chunks:
        owner = owners.get(c["document_id"])
        _need(owner is not None and owner["study_id"] == c["study_id"] and c["chunk_id"] in owner["chunk_ids"], "VALIDATION_ERROR", "a chunk has no owner", c["chunk_id"])
    for r in rejected:
        _need(r["code"] in MANIFEST_CODES, "VALIDATION_ERROR", "unknown code", "rejected_documents")
        _need(len(r.get("detail") or "") <= MOST_DETAIL, "VALIDATION_ERROR", "a detail is too long", "rejected_documents")
    check_leaks({k: x for k, x in payload.items() if k != "visible_chunks"})
    check_backend(payload["backend"])
    if all("extracted_content_sha256" in d for d in documents):
        rederived_ids(payload)
    again = sealed(payload)
    for name in ("parent_lineage_sha256", _SELF, "chunk_set_fingerprint", "index_fingerprint", "manifest_id", "production_fingerprint", "artifact_checksum"):
        _need(payload[name] == again[name], "VALIDATION_ERROR", "does not match what it covers", name)
    return payload


def rederived_ids(payload: dict) -> dict[str, str]:
    """Every visible chunk id, minted again from what it covers; a difference is refused."""
    owners = {d["document_id"]: d for d in payload["documents"]}
    out = {}
    for chunk in payload["visible_chunks"]:
        owner = owners.get(chunk["document_id"])
        _need(owner is not None, "CHUNK_IDENTITY_COLLISION", "has no accepted document", "visible_chunks.chunk_id")
        limbs = {
            "parent_artifact_id": payload["parent_artifact_ref"]["artifact_id"], "parent_artifact_sha256": payload["parent_artifact_ref"]["sha256"], "study_id": owner["study_id"],
            "document_id": owner["document_id"], "extracted_content_sha256": owner["extracted_content_sha256"],
        }
        place = chunk["locator"]
        again = chunk_id(payload["workspace_id"], limbs, payload["chunker"]["algorithm_version"], payload["chunker"][_SELF], place["heading_path"], place["ordinal_in_section"], place["section_category"], chunk["chunk_text_sha256"])
        _need(again == chunk["chunk_id"], "CHUNK_IDENTITY_COLLISION", f"comes out as {again}", chunk["chunk_id"])
        out[chunk["chunk_id"]] = again
    return out


def check_leaks(payload: dict) -> None:
    """No key may look like a secret's, and no value like a secret or a path of the machine."""
    for path, key, value in pairs(payload):
        _need(not leaks_plainly(key, value), "VALIDATION_ERROR", "looks like a secret or a path of the machine", path)


def check_backend(backend: dict, kinds: tuple[str, ...] = ("parquet", "chroma", "numpy")) -> None:
    """A backend is named by its kind and a collection of plain characters."""
    _need(backend.get("kind") in kinds, "UNSUPPORTED_CAPABILITY", f"unknown kind: {backend.get('kind')}", "backend.kind")
    name = backend.get("collection")
    _need(name is None or bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", str(name))), "VALIDATION_ERROR", "is not a plain name", "backend.collection")


def check_parent_agreement(payload: dict, parent: dict) -> None:
    """The parent that a manifest names is the accepted one, and every document is bound as the parent binds it."""
    ref = payload["parent_artifact_ref"]
    for mine, theirs in (("artifact_id", "artifact_id"), ("sha256", "sha256")):
        _need(ref.get(mine) is not None and str(ref[mine]) == str(parent.get(theirs)), "PARENT_HASH_MISMATCH", "is not the accepted parent's", f"parent_artifact_ref.{mine}")
    _need(payload["workspace_id"] == str(parent.get("workspace_id")), "WORKSPACE_NAMESPACE_MISMATCH", "is another workspace than the parent's", "workspace_id")
    for name, code in (("corpus_fingerprint", "CORPUS_FINGERPRINT_MISMATCH"), ("protocol_fingerprint", "PROTOCOL_FINGERPRINT_MISMATCH")):
        _need(payload[name] == parent.get(name), code, "is not the parent's", name)
    records = {str(r["document_id"]): r for r in parent.get("documents") or ()}
    for where, compared in (("documents", ("extracted_path", "extracted_content_sha256", "extraction_method")), ("rejected_documents", ())):
        for i, document in enumerate(payload[where]):
            record = records.get(document["document_id"])
            _need(record is not None, "VALIDATION_ERROR", "the parent has no such document", f"{where}.{i}.document_id")
            _need(document["study_id"] == record.get("study_id"), "VALIDATION_ERROR", "the parent binds another study", f"{where}.{i}.study_id")
            for name in compared:
                _need(record.get(name) is None or record[name] == document[name], "VALIDATION_ERROR", "the parent binds another value", f"{where}.{i}.{name}")

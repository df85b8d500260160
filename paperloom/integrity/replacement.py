"""Atomic replacement of an index: stage, verify, switch, clean up.

Readers see the old generation until the pointer moves, and the new one after.
Each step that fails leaves the old generation live.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_fingerprint
from ..sources.store import Store
from .codes import Refusal
from .manifest import projection, validate
from .verify import compare_sets, verify

IDENTITY = ("provider", "model", "revision", "dimension", "normalization", "distance")


class Lock:
    """Exclusive file of a workspace; it never expires, a person removes a stale one."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self):
        try:
            os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError as error:
            raise Refusal("CONFLICT", "the workspace is locked", self.path) from error
        return self

    def __exit__(self, *_):
        os.unlink(self.path)


def write_json(path: str, value: dict) -> None:
    """Replace a JSON file in one step."""
    with open(f"{path}.partial", "w", encoding="utf-8") as file:
        json.dump(value, file, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        file.flush()
        os.fsync(file.fileno())
    os.replace(f"{path}.partial", path)


def same_request(manifest: dict, accepted: dict | None) -> bool:
    """Whether an accepted manifest already is this one; a clash of ids is refused."""
    if accepted is None:
        return False
    same = canonical_fingerprint(projection(manifest)) == canonical_fingerprint(projection(accepted))
    if manifest["manifest_id"] == accepted["manifest_id"] and not same:
        raise Refusal("IDEMPOTENCY_CONFLICT", "one id, two contents", "manifest_id")
    if manifest["index_fingerprint"] == accepted["index_fingerprint"] and manifest["manifest_id"] != accepted["manifest_id"]:
        raise Refusal("IDEMPOTENCY_CONFLICT", "one content, two ids", "index_fingerprint")
    return same


def check_embedding_identity(manifest: dict, accepted: dict | None) -> None:
    for name in IDENTITY if accepted else ():
        if manifest["embedder"].get(name) != accepted["embedder"].get(name):
            raise Refusal("EMBEDDING_IDENTITY_CHANGED", "the collection holds other vectors", f"embedder.{name}")


def replace(store: Store, manifest: dict, candidate: DataFrame, *, dimension: int, folder: str, accepted: dict | None = None) -> str:
    """Make ``candidate`` (chunk rows with embeddings) the live generation; REPLACED or REUSED."""
    validate(manifest)
    spark = store.spark
    with Lock(f"{folder}/.index.lock"):
        check_embedding_identity(manifest, accepted)
        if same_request(manifest, accepted):
            return "REUSED"
        declared = spark.createDataFrame([(c["chunk_id"], c["document_id"], c["study_id"], c["chunk_text_sha256"]) for c in manifest["visible_chunks"]], "chunk_id string, document_id string, study_id string, chunk_text_sha256 string")
        if not compare_sets(declared, candidate, "chunk_id").where("state <> 'both'").isEmpty():
            raise Refusal("VALIDATION_ERROR", "the candidate is not the declared set", "visible_chunks")
        run, intent = manifest["run_id"], f"{folder}/intent-{manifest['run_id']}.json"
        previous = store.live_generation
        store.stage(candidate, run)
        if not compare_sets(declared, store.generation(run), "chunk_id").where("state <> 'both'").isEmpty():
            raise Refusal("BACKEND_STATE_INCONSISTENT", "what was staged is not the declared set", "visible_chunks")
        if not store.generation(run).where(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension).isEmpty():
            raise Refusal("BACKEND_STATE_INCONSISTENT", "a vector has another dimension", "embedding")
        seal = {"run_id": run, "previous_generation": previous, "candidate_manifest_id": manifest["manifest_id"], "parent_artifact_ref": manifest["parent_artifact_ref"], "chunk_ids": sorted(c["chunk_id"] for c in manifest["visible_chunks"])}
        write_json(intent, seal | {"seal": canonical_fingerprint(seal)})
        store.switch(run, hnsw_space="cosine")
        if not verify(declared, store.live(), dimension, observed_space=store.metadata().get("hnsw_space")).matches:
            store.switch(previous)  # none, where this was the first index
            raise Refusal("BACKEND_STATE_INCONSISTENT", "the live rows are not the declared set", "visible_chunks")
        store.remove_obsolete([previous] if previous else [])
        write_json(f"{folder}/{manifest['manifest_id']}.json", manifest)
    return "REPLACED"


def finalize(folder: str, run_id: str, *, publication_confirmed: bool) -> bool:
    """Remove the intent once the outcome was published, after checking its seal."""
    path = f"{folder}/intent-{run_id}.json"
    if not publication_confirmed or not os.path.exists(path):
        return False
    with open(path, encoding="utf-8") as file:
        value = json.load(file)
    if value.pop("seal", None) != canonical_fingerprint(value):
        raise Refusal("BACKEND_STATE_INCONSISTENT", "the intent was altered", "seal")
    os.unlink(path)
    return True

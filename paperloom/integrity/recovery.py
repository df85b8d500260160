"""What a crash left behind: classification of the state and of legacy rows, and setting both right."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.canonical import canonical_fingerprint
from ..sources.store import Store
from .codes import RECOVERY_ROWS, Refusal

ENFORCEABLE_SCHEMAS = ("chroma-2",)  # fixed value
LEGACY_SIGNALS = ("legacy_id", "ordinal_id", "no_parent", "no_embedder", "unenforceable_schema")
FACTS = ("has_intent", "parent_changed", "candidate_accepted", "live_is_previous", "candidate_stored", "previous_stored", "candidate_within_live")


def _ladder(facts: dict):
    """(condition, row) in order; the first that holds decides."""
    f = facts
    return (
        (not f["has_intent"] if isinstance(f["has_intent"], bool) else ~f["has_intent"], "NO_INTENT"),
        (f["parent_changed"], "OWNERSHIP"),
        (f["candidate_accepted"], "POST_CHECK_7"),
        (f["live_is_previous"], "PRE_R5"),
        (f["candidate_stored"] & f["previous_stored"] & f["candidate_within_live"], "R5_TO_R6"),
        (f["candidate_stored"], "R5_TO_CHECK_7"),
    )


def classify(facts: dict[str, bool]) -> str:
    return next((row for holds, row in _ladder(facts) if holds), RECOVERY_ROWS[-1])


def classify_column(facts: dict[str, Column]) -> Column:
    """The same over columns, for many states at once."""
    (holds, row), *more = _ladder(facts)
    out = F.when(holds, row)
    for holds, row in more:
        out = out.when(holds, row)
    return out.otherwise(RECOVERY_ROWS[-1])


def action(row: str, *, lock_free: bool = True, live_is_candidate: bool = False, previous_complete: bool = True) -> tuple[str, str | None, str]:
    """(state, code, what to do) for a row."""
    if row == "NO_INTENT":
        return "PROCEED", None, "nothing"
    if row == "UNREADABLE_STATE":
        return "REFUSED", "BACKEND_STATE_INCONSISTENT", "nothing"
    if not lock_free:
        return "REFUSED", "CONFLICT", "nothing"
    if row == "OWNERSHIP":
        return "ABANDONED", "CONFLICT", "discard staged"
    if row == "POST_CHECK_7":
        return "ROLLED_FORWARD", None, "report event"
    if row == "PRE_R5":
        return "ROLLED_BACK", "ATOMIC_COMMIT_FAILED", "discard staged"
    if row == "R5_TO_R6":
        return "ROLLED_FORWARD", None, "remove obsolete"
    if live_is_candidate:
        return "ROLLED_FORWARD", None, "report event"
    if not previous_complete:
        return "REFUSED", "BACKEND_STATE_INCONSISTENT", "nothing"
    return "ROLLED_BACK", "ATOMIC_COMMIT_FAILED", "restore pointer"


def legacy_signals(rows: DataFrame, lineage_supplied: bool = False) -> DataFrame:
    """Adds a flag for each row-level sign of a store from before content-addressed ids.

    The two signs of absence do not count where a manifest supplies the lineage.
    """
    column = lambda *names: F.coalesce(*(text.given(F.col(n)) for n in names if n in rows.columns), F.lit(None).cast("string"))
    chunk_id = F.coalesce(F.col("chunk_id"), F.lit(""))
    ordinal = F.col("ordinal_in_section").cast("string") if "ordinal_in_section" in rows.columns else chunk_id
    absent = lambda *names: F.lit(False) if lineage_supplied else column(*names).isNull()
    return rows.withColumns({
        "legacy_id": chunk_id.rlike(r"^chk-[0-9a-z]+\z"), "ordinal_id": F.coalesce(ordinal.rlike(r"^chk-\d+\z"), F.lit(False)),
        "no_parent": absent("parent_artifact_ref", "document_manifest_id", "parent_artifact_id"), "no_embedder": absent("embedding_identity", "embedder"),
    })


def is_legacy(rows: DataFrame, metadata: dict, schema_version: str | None = None, lineage_supplied: bool = False) -> tuple[str, ...]:
    """The signs that a store shows, sorted; none for a current store."""
    flags = LEGACY_SIGNALS[:4]
    seen = legacy_signals(rows, lineage_supplied).agg(*(F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags)).first()
    found = {f for f in flags if seen[f]}
    if not lineage_supplied and not (metadata.get("embedding_identity") or metadata.get("embedder")):
        found.add("no_embedder")
    declared = schema_version if schema_version is not None else metadata.get("storage_schema_version")
    if declared and str(declared) not in ENFORCEABLE_SCHEMAS:
        found.add("unenforceable_schema")
    return tuple(sorted(found))


@dataclass(frozen=True)
class Decision:
    """What recovery found and did."""

    run_id: str
    row: str
    state: str
    code: str | None
    did: str
    intent_removed: bool = False
    removed_generations: int = 0


def inspect(store: Store, folder: str, run_id: str, accepted: dict | None = None, accepted_parent: dict | None = None) -> tuple[dict[str, bool], dict | None]:
    """(facts, intent) of a run: from its sealed intent, the pointer and the generations on disk."""
    path = os.path.join(folder, f"intent-{run_id}.json")
    facts = dict.fromkeys(FACTS, False)
    if not os.path.exists(path):
        return facts, None
    with open(path, encoding="utf-8") as file:
        intent = json.load(file)
    body = {k: x for k, x in intent.items() if k != "seal"}
    if intent.get("seal") != canonical_fingerprint(body):
        raise Refusal("BACKEND_STATE_INCONSISTENT", "the intent was altered", "seal")
    live, stored, previous = store.live_generation, store.generations(), intent.get("previous_generation")
    whole = is_complete(store, run_id, intent) if run_id in stored else False
    facts |= {
        "has_intent": True,
        "parent_changed": accepted_parent is not None and accepted_parent != intent.get("parent_artifact_ref"),
        "candidate_accepted": bool(accepted) and accepted.get("manifest_id") == intent.get("candidate_manifest_id"),
        "live_is_previous": live == previous,
        "candidate_stored": run_id in stored,
        "previous_stored": bool(previous) and previous in stored,
        "candidate_within_live": live == run_id and whole,
    }
    return facts, intent


def is_complete(store: Store, generation: str, intent: dict) -> bool:
    """Whether a stored generation holds every chunk that its intent declares; declared ids without a row are what a crash lost."""
    declared = intent.get("chunk_ids")
    if declared is None:
        return True
    ids = store.spark.createDataFrame([(x,) for x in declared], "chunk_id string")
    return ids.join(store.generation(generation).select("chunk_id"), "chunk_id", "left_anti").isEmpty()


def recover(store: Store, folder: str, run_id: str, *, accepted: dict | None = None, accepted_parent: dict | None = None, event_durable: bool = False) -> Decision:
    """Decide from the facts, then act under the workspace's lock.

    A lock that another holds is a refusal, however old it is.  The intent goes only once
    the caller has put the event of the outcome on disk.
    """
    from .replacement import Lock

    facts, intent = inspect(store, folder, run_id, accepted, accepted_parent)
    row = classify(facts)
    if row in ("NO_INTENT", "UNREADABLE_STATE"):
        state, code, did = action(row)
        return Decision(run_id, row, state, code, did)
    lock = Lock(os.path.join(folder, ".index.lock"))
    try:
        lock.__enter__()
    except Refusal:
        state, code, did = action(row, lock_free=False)
        return Decision(run_id, row, state, code, did)
    try:
        previous, live = intent.get("previous_generation"), store.live_generation
        whole = bool(previous) and previous in store.generations()
        state, code, did = action(row, live_is_candidate=live == run_id and is_complete(store, run_id, intent), previous_complete=whole)
        removed = 0
        if did == "discard staged":
            removed = store.remove_obsolete([run_id])
        elif did == "remove obsolete":
            removed = store.remove_obsolete([previous])
        elif did == "restore pointer":
            store.switch(previous)
            removed = store.remove_obsolete([run_id])
        gone = event_durable and state != "REFUSED"
        if gone:
            os.unlink(os.path.join(folder, f"intent-{run_id}.json"))
        return Decision(run_id, row, state, code, did, gone, removed)
    finally:
        lock.__exit__()


def migration_plan(rows: DataFrame, metadata: dict, schema_version: str | None = None, lineage_supplied: bool = False) -> dict:
    """What a move off a legacy store would do; nothing is written."""
    signals = is_legacy(rows, metadata, schema_version, lineage_supplied)
    documents = text.first_given(*(F.col(n).cast("string") for n in ("document_id", "doi", "filename") if n in rows.columns), F.lit("DOC"))
    found = rows.agg(F.count("*").alias("rows"), F.count_distinct(documents).alias("documents")).first()
    return {"signals": list(signals), "legacy": bool(signals), "rows": found["rows"], "documents": found["documents"], "action": "re-index" if signals else "none"}


def refuse_authoritative_use(rows: DataFrame, metadata: dict, schema_version: str | None = None) -> None:
    """A legacy store may be read, but nothing may rest on it."""
    if signals := is_legacy(rows, metadata, schema_version):
        raise Refusal("LEGACY_STORE_READ_ONLY", f"shows {', '.join(signals)}", "store")


def commit_migration(plan: dict, reindex: Callable[[], DataFrame], store: Store, generation: str) -> int:
    """Carry out a plan by indexing anew from the sources; the legacy rows are never rewritten.  The rows written."""
    if not plan["legacy"]:
        return 0
    rows = reindex()
    if not legacy_signals(rows).where(" or ".join(("legacy_id", "ordinal_id"))).isEmpty():
        raise Refusal("LEGACY_STORE_READ_ONLY", "the new rows carry legacy ids", "chunk_id")
    store.stage(rows, generation)
    store.switch(generation)
    return store.count()

"""Closed code vocabularies, and the typed refusal that carries a code."""

from __future__ import annotations

# Names that other tools match on.

ERROR_CODES = (
    "VALIDATION_ERROR", "NOT_FOUND", "PATH_OUTSIDE_WORKSPACE", "SCHEMA_VERSION_UNSUPPORTED", "PROTOCOL_FINGERPRINT_MISMATCH",
    "CORPUS_FINGERPRINT_MISMATCH", "DEPENDENCY_ERROR", "NETWORK_ERROR", "RATE_LIMITED", "CONFLICT", "IDEMPOTENCY_CONFLICT",
    "ATOMIC_COMMIT_FAILED", "INTERNAL_ERROR",
)
SIDECAR_CODES = (
    "WORKSPACE_NAMESPACE_MISMATCH", "CHUNK_IDENTITY_COLLISION", "LOCATOR_NOT_UNIQUE", "EXTRACTED_TEXT_UNUSABLE", "EXTRACTED_CONTENT_CHANGED",
    "CONFIGURATION_INEFFECTIVE", "EMBEDDING_IDENTITY_CHANGED", "BACKEND_STATE_INCONSISTENT", "LEGACY_STORE_READ_ONLY", "UNSUPPORTED_CAPABILITY",
)
GATE_CODES = ("UNSUPPORTED_ARTIFACT_TYPE", "MISSING_PARENT_ARTIFACT", "PARENT_HASH_MISMATCH", "REQUIRED_PARENT_TYPE_MISSING")
MANIFEST_CODES = frozenset(ERROR_CODES + SIDECAR_CODES)
STATUSES = ("SUCCESS", "PARTIAL", "FAILED", "ERROR", "CANCELLED")
RECOVERY_ROWS = ("NO_INTENT", "OWNERSHIP", "POST_CHECK_7", "PRE_R5", "R5_TO_R6", "R5_TO_CHECK_7", "UNREADABLE_STATE")
OUTCOME_EXIT = {"SUCCESS": 0, "PARTIAL": 2, "REFUSED": 3, "FAILED": 4}


class Refusal(ValueError):
    """A refusal with a code of a closed vocabulary and the field that it is about."""

    def __init__(self, code: str, message: str, field: str | None = None):
        super().__init__(f"{code}: {message}" + (f" ({field})" if field else ""))
        self.code, self.field = code, field

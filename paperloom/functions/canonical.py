"""Canonical JSON, fingerprints and deterministic identifiers.

Canonical bytes: keys sorted, no spaces, characters as they are, whole floats as
integers; arrays named by a JSON pointer count as sets and are sorted by their
own canonical form.  NaN, infinities and keys that are not strings are refused.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

from . import vocabulary as v

_SUFFIX = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _plain(value, where: str, sets: frozenset[str]):
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"number at {where or '/'} is not finite")
        return int(value) if value.is_integer() else value
    if isinstance(value, dict):
        if not all(isinstance(key, str) for key in value):
            raise TypeError(f"object at {where or '/'} has a key that is not a string")
        escaped = lambda key: key.replace("~", "~0").replace("/", "~1")
        return {key: _plain(item, f"{where}/{escaped(key)}", sets) for key, item in value.items()}
    if isinstance(value, (list, tuple)):
        items = [_plain(item, f"{where}/{i}", sets) for i, item in enumerate(value)]
        return sorted(items, key=lambda item: _dump(item).encode()) if where in sets else items
    raise TypeError(f"value at {where or '/'} has no canonical form: {type(value).__name__}")


def canonical_bytes(value, set_like: tuple[str, ...] = ()) -> bytes:
    return _dump(_plain(value, "", frozenset(set_like))).encode()


def canonical_fingerprint(value, set_like: tuple[str, ...] = ()) -> str:
    return "sha256:" + hashlib.sha256(canonical_bytes(value, set_like)).hexdigest()


def text_fingerprint(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def deterministic_id(kind: str, namespace: str, value, version: str = "v1") -> str:
    """Prefix of the kind and 32 hex digits over kind, namespace, input and version."""
    if kind not in v.ID_PREFIXES:
        raise ValueError(f"no such kind of identifier: {kind}")
    whole = {"algorithm_version": version, "kind": kind, "workspace_namespace": namespace, "input": value}
    return v.ID_PREFIXES[kind][0] + hashlib.sha256(canonical_bytes(whole)).hexdigest()[:32]


def validate_identifier(kind: str, value: str) -> str:
    """The value, if it has a prefix of its kind and an opaque suffix."""
    if kind not in v.ID_PREFIXES:
        raise ValueError(f"no such kind of identifier: {kind}")
    if not isinstance(value, str):
        raise TypeError(f"{kind}_id must be a string")
    for prefix in v.ID_PREFIXES[kind]:
        if value.startswith(prefix):
            if _SUFFIX.fullmatch(value[len(prefix) :]):
                return value
            raise ValueError(f"{kind}_id has an invalid suffix")
    raise ValueError(f"{kind}_id must start with one of: {', '.join(v.ID_PREFIXES[kind])}")


LIMBS = ("parent_artifact_id", "parent_artifact_sha256", "study_id", "document_id", "extracted_content_sha256")


def chunk_id(namespace: str, limbs: dict[str, str], algorithm: str, configuration: str, heading_path, ordinal: int, category: str, text_sha256: str) -> str:
    """Content-addressed identity of one chunk."""
    value = {limb: limbs[limb] for limb in LIMBS} | {
        "chunker_algorithm_version": algorithm,
        "chunker_configuration_fingerprint": configuration,
        "locator": {"heading_path": list(heading_path), "ordinal_in_section": int(ordinal), "section_category": category},
        "chunk_text_sha256": text_sha256,
    }
    return deterministic_id("chunk", namespace, value, v.CHUNK_ID_VERSION)

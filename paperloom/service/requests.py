"""Identity of what is indexed: stated in full by a request or a manifest, never inferred."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from ..functions.canonical import LIMBS
from ..integrity.codes import Refusal

#: What every request must state; the first six bind chunk ids.
IDENTITY = ("workspace_id", *(limb for limb in LIMBS if limb != "workspace_id"))
REQUIRED = (*IDENTITY, "backend_provider", "collection")
OPTIONAL = ("backend_model", "run_id")


def present(value) -> bool:
    """Whether a value is given: zero counts, blanks do not."""
    return value is not None and bool(str(value).strip())


class IdentityMissing(Refusal):
    def __init__(self, scope: str, missing: list[str]):
        super().__init__("IDENTITY_MISSING", f"{scope} does not state {', '.join(missing)}; a request or a workspace manifest has to, and nothing is inferred", missing[0])
        self.scope, self.missing = scope, missing


@dataclass(frozen=True)
class IndexRequest:
    """All or nothing: a request that lacks a required field cannot be made."""

    workspace_id: str | None = None
    study_id: str | None = None
    document_id: str | None = None
    parent_artifact_id: str | None = None
    parent_artifact_sha256: str | None = None
    extracted_content_sha256: str | None = None
    backend_provider: str | None = None
    backend_model: str | None = None
    collection: str | None = None
    run_id: str | None = None
    scope: str = "the request"

    def __post_init__(self):
        if missing := self.missing():
            raise IdentityMissing(self.scope, missing)

    def missing(self) -> list[str]:
        return [name for name in REQUIRED if not present(getattr(self, name, None))]

    @classmethod
    def of_manifest(cls, manifest: Mapping, scope: str) -> IndexRequest:
        """The fields of a manifest that a request has; all others are left alone."""
        known = {f.name for f in fields(cls)} - {"scope"}
        return cls(scope=scope, **{name: manifest[name] for name in (*REQUIRED, *OPTIONAL) if name in manifest and name in known})

    def limbs(self) -> dict[str, str]:
        """The identity, checked again: an object that was not made by the constructor is refused here."""
        if missing := self.missing():
            raise IdentityMissing(getattr(self, "scope", "the request"), missing)
        return {name: str(getattr(self, name)) for name in IDENTITY}

    def report(self, bound_model: str | None = None) -> dict:
        shown = ("workspace_id", "study_id", "document_id", "parent_artifact_id", "backend_provider", "backend_model", "collection", "run_id")
        out = {name: getattr(self, name) for name in shown}
        return out | {"backend_model": out["backend_model"] if out["backend_model"] is not None else bound_model}


def check_binding(request: IndexRequest, *, collection: str, provider: str | None, model: str | None) -> None:
    """Refuse a request that names another collection, provider or model than those bound."""
    if request.collection != collection:
        raise Refusal("COLLECTION_MISMATCH", f"the request names {request.collection!r}, the index is {collection!r}", "collection")
    if request.backend_provider != provider:
        raise Refusal("BACKEND_IDENTITY_MISMATCH", f"the request names {request.backend_provider!r}, the index has {provider!r}", "backend_provider")
    if request.backend_model is not None and request.backend_model != model:
        raise Refusal("BACKEND_IDENTITY_MISMATCH", f"the request names {request.backend_model!r}, the index has {model!r}", "backend_model")


def read_workspace_manifest(value) -> dict:
    """A mapping, or the JSON object in a file; a file that cannot be read is a refusal of its own kind."""
    if isinstance(value, Mapping):
        return dict(value)
    return read_object(value, "WORKSPACE_MANIFEST_UNREADABLE")


def read_object(path, code: str) -> dict:
    """The JSON object in a file of the driver."""
    try:
        with open(os.fspath(path), encoding="utf-8") as file:
            found = json.load(file)
    except FileNotFoundError as error:
        raise Refusal(code, "there is no such file", str(path)) from error
    except (json.JSONDecodeError, UnicodeDecodeError) as error:
        raise Refusal(code, f"not JSON: {error}", str(path)) from error
    except OSError as error:
        raise Refusal(code, f"cannot be read: {type(error).__name__}", str(path)) from error
    if not isinstance(found, dict):
        raise Refusal(code, f"holds a {type(found).__name__}, not an object", str(path))
    return found


def resolve(folder: str, request: IndexRequest | None, manifest=None, workspace_id: str | None = None) -> IndexRequest:
    """The identity of a folder: the request, else the manifest; the two are never mixed, and a
    workspace alone is not one."""
    if request is not None:
        return request
    if manifest is not None:
        return IndexRequest.of_manifest(read_workspace_manifest(manifest), folder)
    raise IdentityMissing(folder, [name for name in REQUIRED if not (name == "workspace_id" and present(workspace_id))])


def missing_limbs(names: tuple[str, ...] = IDENTITY) -> Column:
    """The same for rows: the names of the identity columns that are null or blank."""
    return F.filter(F.array(*(F.when(~text.is_present(F.col(name).cast("string")), F.lit(name)) for name in names)), lambda x: x.isNotNull())

"""Where things are: shapes of references, containment in a workspace, and files that are looked for."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..integrity.codes import Refusal
from .requests import read_object

# Shapes of absolute references and of steps upwards.
ABSOLUTE = r"^(?:[A-Za-z]:|[\\/])"
UPWARDS = r"(?:^|[\\/])\.\.(?:[\\/]|$)"
REDUNDANT = r"(?:^|[\\/])\.?(?:[\\/]|$)"
LEVELS = 5
_BIBLIOGRAPHIES = ("references.bib", "../literature/references.bib", "literature/references.bib")
_JOURNAL = os.path.join("audit", "journal.jsonl")


def reference_fault(value: Column) -> Column:
    """What is wrong with a workspace-relative reference; null if nothing is."""
    return (
        F.when(value.isNull() | (F.trim(value) == ""), "blank").when(value.rlike(ABSOLUTE), "absolute").when(value.rlike(UPWARDS), "upwards")
        .when((value != ".") & value.rlike(REDUNDANT), "redundant")
    )


def check_reference(value: str, field: str, code: str = "VALIDATION_ERROR") -> str:
    """The same for one reference on the driver."""
    if not isinstance(value, str) or not value.strip():
        raise Refusal(code, "is not stated", field)
    for pattern, fault in ((ABSOLUTE, "is absolute"), (UPWARDS, "leads upwards")):
        if re.search(pattern, value):
            raise Refusal(code, fault, field)
    if value != "." and re.search(REDUNDANT, value):
        raise Refusal(code, "has an empty or '.' step", field)
    return value


def check_returned(value: str, field: str) -> str:
    """A reference that goes out must lie within the workspace."""
    if re.search(ABSOLUTE, value) or re.search(UPWARDS, value):
        raise Refusal("PATH_OUTSIDE_WORKSPACE", "is not relative to the workspace", field)
    return value


def workspace_root(path) -> str:
    root = os.path.realpath(os.fspath(path))
    if not os.path.isdir(root):
        raise Refusal("VALIDATION_ERROR", "is not a folder", "workspace_root")
    return root


def within(root: str, reference: str, field: str) -> str:
    """The real path of a reference, which links may not lead out of the workspace."""
    at = os.path.realpath(os.path.join(root, check_reference(reference, field)))
    if at != root and os.path.commonpath([root, at]) != root:
        raise Refusal("PATH_OUTSIDE_WORKSPACE", "leads out of the workspace", field)
    return at


def journal_destination(root: str, reference: str | None) -> str:
    """Where a run reports: stated, inside the workspace, and not the workspace's own ledger."""
    if reference is None or not str(reference).strip():
        raise Refusal("DEPENDENCY_ERROR", "no destination is stated, and none is looked for", "journal_path")
    at = within(root, str(reference), "journal_path")
    if at == os.path.realpath(os.path.join(root, _JOURNAL)):
        raise Refusal("VALIDATION_ERROR", "is the ledger of the workspace, which others write", "journal_path")
    return at


def documents_folder(root: str, reference: str) -> str:
    at = within(root, reference, "docs_path")
    if not os.path.isdir(at):
        raise Refusal("VALIDATION_ERROR", "is not a folder", "docs_path")
    return at


def bibliography_of(folder: str) -> str | None:
    """The first bibliography found in, beside or below a folder of documents."""
    tried = (os.path.normpath(os.path.join(folder, name)) for name in _BIBLIOGRAPHIES)
    return next((path for path in tried if os.path.exists(path)), None)


def audit_journal(start: str) -> str | None:
    """The ledger of the workspace that a folder is in, ``LEVELS`` levels up at most."""
    at = os.path.realpath(start)
    for _ in range(LEVELS):
        if any(os.path.exists(os.path.join(at, mark)) for mark in ("audit", "protocol.json", "project.json")):
            os.makedirs(os.path.join(at, "audit"), exist_ok=True)
            return os.path.join(at, _JOURNAL)
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return None


def newest_sidecar(folder: str, wanted: Callable[[dict], bool] = lambda value: "manifest_id" in value) -> dict | None:
    """The manifest in the run folder of greatest name that holds one; intents are passed over."""
    runs = sorted((e.path for e in os.scandir(folder) if e.is_dir()), reverse=True) if os.path.isdir(folder) else []
    for run in runs:
        for name in sorted(os.listdir(run)):
            if name.endswith(".json") and not name.startswith("intent"):
                value = read_object(os.path.join(run, name), "VALIDATION_ERROR")
                if wanted(value):
                    return value
    return None


def parent_view(path: str) -> dict:
    """The accepted parent as a JSON object."""
    return read_object(path, "VALIDATION_ERROR")

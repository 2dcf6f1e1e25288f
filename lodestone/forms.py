"""Form metadata: what a form shows of each field for an operation, and why.

A profile lists fields, as names or {field, mode: auto | hidden | read_only | editable}.
A field's state is the strictest that the domain, its write contract and the profile ask
for: hidden, read_only or editable."""

from __future__ import annotations

from typing import Any

from .domain import Domain
from .errors import require
from .types import category

CODE = "invalid_field_policy"
OPERATIONS = ("view", "insert", "update", "upsert")
MODES = ("auto", "hidden", "read_only", "editable")
EDITORS = {"boolean": "checkbox", "integer": "number", "decimal": "number", "date": "date", "datetime": "datetime", "json": "code"}


def _barriers(domain: Domain, operation: str, path: str, mode: str) -> list[tuple[str, str]]:
    """(state, reason) of all that keeps a field from being edited, the strictest first."""
    found = domain.resolve(path)
    writes = domain.writes
    checks = [
        (not domain.is_public(path), "hidden", "field_not_public"),
        (mode == "hidden", "hidden", "profile_hidden"),
        (operation == "view", "read_only", "view_only"),
        (mode == "read_only", "read_only", "profile_read_only"),
        (bool(found.associations), "read_only", "related_field"),
        (found.column.computed is not None, "read_only", "computed_field"),
        (operation not in writes.get("operations", ()), "read_only", "operation_not_declared"),
        (path not in writes.get("fields", ()), "read_only", "field_not_writable"),
    ]
    return [(state, reason) for holds, state, reason in checks if holds]


def field_states(domain: Domain, profile: list[Any], operation: str = "update") -> list[dict[str, Any]]:
    """{field, label, type, editor, state, reason} of each entry of a profile."""
    require(operation in OPERATIONS, CODE, "operation: view, insert, update or upsert", operation=operation)
    require(isinstance(profile, list), CODE, "profile: expected a list of fields")
    out: list[dict[str, Any]] = []
    for entry in profile:
        spec = {"field": entry} if isinstance(entry, str) else entry
        require(isinstance(spec, dict) and spec.keys() <= {"field", "mode"}, CODE, "profile: an entry is a field or {field, mode}")
        path, mode = spec.get("field"), spec.get("mode", "auto")
        require(mode in MODES, CODE, "mode: auto, hidden, read_only or editable", mode=str(mode))
        require(path not in [o["field"] for o in out], CODE, "profile: a field stands there twice", field=str(path))
        barriers = _barriers(domain, operation, path, mode)
        state, reason = barriers[0] if barriers else ("editable", None)
        column = domain.resolve(path).column
        shown = {"label": column.label or column.name.replace("_", " "), "type": column.type, "editor": EDITORS.get(category(column.type), "text")}
        out.append({"field": path, "state": state, "reason": reason} | (shown if state != "hidden" else dict.fromkeys(shown)))
    return out

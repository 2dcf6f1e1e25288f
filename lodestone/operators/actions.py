"""Actions: named changes of one row that a domain declares, with preconditions.

    actions: {name: {set: {field: value | ['param', name] | mutation}, when: filter,
              parameters: {name: {type, default?}}, grant: true}}

An action is an update of the row with a given key under its precondition, so the check
and the change are one pass over the table. An action that asks for a grant takes one
made for it and the row, once."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field
from typing import Any

from .. import expr as E
from ..errors import SelectError, require
from ..library import cast_parameters
from .writes import Writer, Written


@dataclass(frozen=True)
class Grant:
    """The right to run one action on one row, once."""

    action: str
    key: Any
    token: str = field(default_factory=lambda: secrets.token_hex(16))


class Actions:
    """The actions of a writer's domain. ``table`` moves on with every run."""

    def __init__(self, writer: Writer):
        self.writer, self.domain = writer, writer.domain
        self.declared: dict[str, dict[str, Any]] = self.domain.document.get("actions", {})
        self._used: set[str] = set()

    def available(self, key: Any) -> list[str]:
        """The actions whose preconditions hold for a row now."""
        row = E.eq(self.domain.primary_key, key)
        return [name for name, spec in self.declared.items() if not self.writer.table.where(self.writer._matching(self._of_row(row, spec))).isEmpty()]

    @staticmethod
    def _of_row(row: E.Node, spec: dict[str, Any]) -> E.Node:
        return E.all_([row, E.parse_filter(spec["when"])]) if "when" in spec else row

    def _assignments(self, spec: dict[str, Any], parameters: dict[str, Any]) -> dict[str, Any]:
        try:
            values = cast_parameters(spec.get("parameters", {}), parameters, self.writer.engine.limits)
        except SelectError as e:
            raise SelectError("invalid_action_intent", e.message, e.details) from e
        named = lambda v: values[v[1]] if isinstance(v, (list, tuple)) and len(v) == 2 and v[0] == "param" else v
        return {f: named(v) for f, v in spec["set"].items()}

    def run(self, name: str, key: Any, parameters: dict[str, Any] | None = None, grant: Grant | None = None) -> Written:
        require(name in self.declared, "unknown_action", "the domain declares no such action", action=name)
        spec = self.declared[name]
        if spec.get("grant"):
            require(grant is not None and (grant.action, grant.key) == (name, key), "grant_required", "this action needs a grant for it and the row", action=name)
            require(grant.token not in self._used, "grant_used", "a grant is good for one run", action=name)
        assignments = self._assignments(spec, parameters or {})
        row = E.eq(self.domain.primary_key, key)
        try:
            made = self.writer.update(assignments, self._of_row(row, spec), expected_count=1)
        except SelectError as e:
            if e.code != "cardinality_mismatch":
                raise
            there = not self.writer.table.where(self.writer._matching(row)).isEmpty()
            raise SelectError("action_precondition_failed" if there else "action_target_missing", "the row isn't in the state that the action starts from" if there else "no row has this key", {"action": name}) from e
        if grant is not None:
            self._used.add(grant.token)
        self.writer.table = made.table
        return made

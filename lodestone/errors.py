"""The one exception of the semantic layer."""

from __future__ import annotations

from typing import Any


class SelectError(Exception):
    """A refusal with a stable ``code``, a message and plain ``details``."""

    def __init__(self, code: str, message: str, details: dict[str, Any] | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details or {}


def require(condition: object, code: str, message: str, **details: Any) -> None:
    if not condition:
        raise SelectError(code, message, details)

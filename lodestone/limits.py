"""Named ceilings for requests and results."""

from __future__ import annotations

from .errors import require

#: The 29 ceilings and their defaults.
DEFAULTS = {
    "max_fields": 100,
    "max_filter_values": 100,
    "max_parameter_bytes": 65_536,
    "max_value_bytes": 4_096,
    "max_action_targets": 1_000,
    "max_collection_rows": 100,
    "max_total_collection_rows": 10_000,
    "max_response_bytes": 16_777_216,
    "max_file_bytes": 16_777_216,
    "max_total_decoded_bytes": 33_554_432,
    "max_total_cells": 1_000_000,
    "max_state_bytes": 131_072,
    "max_bucket_ranges": 100,
    "max_bucket_bytes": 16_384,
    "max_numeric_digits": 15,
    "max_generated_selections": 256,
    "max_generated_parameters": 1_000,
    "max_expression_nodes": 10_000,
    "max_expression_depth": 64,
    "max_expression_arity": 1_000,
    "max_json_path_segments": 64,
    "max_rule_numeric_digits": 1_024,
    "max_rule_work": 2_000_000,
    "max_regex_states": 4_096,
    "max_import_preview_bytes": 16_777_216,
    "max_result_cell_bytes": 65_536,
    "max_response_temp_bytes": 33_554_432,
    "max_response_nodes": 100_000,
    "max_response_depth": 32,
}


class Limits:
    """The defaults with some of them replaced by other positive integers."""

    def __init__(self, **overrides: int):
        for name, value in overrides.items():
            require(name in DEFAULTS, "invalid_limits", "no ceiling has this name", limit=name)
            require(isinstance(value, int) and value > 0, "invalid_limits", "a ceiling is a whole number from 1", limit=name)
        self._values = DEFAULTS | overrides

    def get(self, name: str) -> int:
        require(name in self._values, "invalid_limits", "no ceiling has this name", limit=name)
        return self._values[name]

    def check(self, name: str, amount: int, code: str, label: str) -> int:
        require(amount <= self.get(name), code, f"{label}: more than {name}", limit=name, maximum=self.get(name))
        return amount

    def check_bytes(self, name: str, value: object, code: str, label: str) -> int:
        return self.check(name, len(str(value).encode("utf-8")), code, label)

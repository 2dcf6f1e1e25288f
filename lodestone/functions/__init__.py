"""Part of the semantic layer: functions."""

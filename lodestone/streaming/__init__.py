"""Part of the semantic layer: streaming."""

"""Part of the semantic layer: sources."""

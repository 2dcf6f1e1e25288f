"""Part of the semantic layer: plans."""

"""Part of the semantic layer: operators."""

"""Column functions: text normalization and vector arithmetic."""

"""Column expressions and small array helpers."""

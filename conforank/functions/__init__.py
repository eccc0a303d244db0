"""Column expressions and Arrow helpers."""

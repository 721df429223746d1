"""Column expressions and fixed values."""

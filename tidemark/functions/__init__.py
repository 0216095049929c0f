"""Column expressions and small aggregates."""

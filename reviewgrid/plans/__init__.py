"""Composed plans and the registry of named queries (with their DuckDB oracles)."""

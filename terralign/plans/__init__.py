"""Registered queries, their DuckDB statements and stand-in tables."""

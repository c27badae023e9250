"""Queries over the tables, each with its DuckDB counterpart."""

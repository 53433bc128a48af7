"""Operators bound to the driver's tables, each beside its DuckDB statement."""

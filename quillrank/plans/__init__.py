"""The query catalogue: each query with its SQL for DuckDB."""

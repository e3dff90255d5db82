"""Metric sources: in-memory, long tables, wide Parquet files."""

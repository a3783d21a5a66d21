"""Readers and writers beside plain Parquet."""

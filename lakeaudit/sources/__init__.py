"""Scans, typed CSV/Parquet reads and writes, and the file inventory."""

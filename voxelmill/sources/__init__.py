"""Scans: Parquet tables, fixed-width structure files, lists, CSV and JSON."""

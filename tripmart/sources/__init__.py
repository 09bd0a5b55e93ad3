"""Parquet sources, the audit log, the raw table and the ingestion of files into it."""

"""Linked-document analytics on Spark: ranked retrieval, entity resolution, ingest, lint and dedup."""

__version__ = "0.1.0"

"""All registered queries with their oracles."""

from foliograph.catalog import conversation, graphs, ingestion, merging, parsing, resolution, search  # noqa: F401
from foliograph.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries and their SQL twins."""

from . import fileset_queries, manifest_queries, metric_queries, publication_queries, queries, release_queries, scan_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

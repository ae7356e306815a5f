"""Registered queries: every operator applied to the tables, and its SQL."""

from . import chunking, dialogue, filtered, filters, inverted, matching, metrics, rerank, search, text, verify
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chunking", "dialogue", "filtered", "filters", "inverted", "matching", "metrics", "rerank", "search", "text", "verify"]

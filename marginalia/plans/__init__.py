"""Registered queries with their SQL counterparts."""

from . import layout, relational, sources, text, strokes, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

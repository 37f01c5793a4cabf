"""Joins, aggregates, rankings and layout operators over the corpus tables."""

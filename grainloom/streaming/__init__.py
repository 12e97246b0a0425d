"""Incremental landing and scoring."""

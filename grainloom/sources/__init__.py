"""Readers of landed files and keyed writers of tables."""

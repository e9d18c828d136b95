"""Lodestack: full-text search and document analytics as Spark DataFrame plans."""

"""Spark engine for document corpora and item banks."""

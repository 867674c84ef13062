"""Retrieval evaluation and corpus processing as Spark jobs."""

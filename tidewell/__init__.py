"""Retrieval and text analytics as PySpark jobs."""

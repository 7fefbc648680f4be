"""Traceability analytics as Spark DataFrame jobs."""
